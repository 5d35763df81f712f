"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's documents. All but the last return the columns of documents, extra columns
included whatever they are called: a stage keeps a row's own columns in one struct, `_doc`.

Rows are told apart by their place in the files they come from (a frame that reads no files is
written first), so null and repeated ids neither lose nor double a row. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utxolens.llm import pii, quality
from utxolens.llm.common import keep, table
from utxolens.llm.mixing import mix_sources
from utxolens.llm.packing import pack_documents
from utxolens.llm.simhash import similar_texts
from utxolens.session import prepare

#: Documents score at least this much, personal data of these kinds is replaced (a web address alone is none).
QUALITY, KINDS = 0.3, ("email", "ip", "card", "phone", "account")


def identified(docs: DataFrame) -> DataFrame:
    """_doc: a row's columns; _row: (hash of the file's path, place in the file), the same whenever the row is read."""

    def placed(d: DataFrame) -> DataFrame:
        at = d.metadataColumn("_metadata")
        own = F.struct(*[F.col(f"`{c}`") for c in d.columns])
        return d.select(own.alias("_doc"), F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("at")).alias("_row"))

    try:
        return placed(docs)
    except AnalysisException:
        return placed(keep(docs, "documents"))


def with_text(docs: DataFrame, rows: DataFrame, text: Column) -> DataFrame:
    """The rows' columns with another text and its n_chars."""
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast(kind) if kind else None}
    return rows.withColumn("_text", text).select(*[(new[c] if c in new else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null and empty texts are scored like any other, without labels all stay."""
    score = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score_column(score, F.col("text")) >= QUALITY)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: its smallest id's, null ids last, then by its place.

    Groups connect texts whose five-word shingles have a Jaccard similarity of 0.8 or more and whose fingerprints are
    near, copies included; null, empty and blank texts are one group. Every text is dealt out once to be
    compared and once to be kept, at every size of the input.
    """
    rows = identified(docs)
    first = F.struct(F.col("_doc.doc_id").isNull().alias("none"), F.coalesce(F.col("_doc.doc_id").cast("long"), F.lit(0)).alias("id"), "_row.file", "_row.at")
    rows = rows.select("_doc", first.alias("_row"), F.col("_doc.text").alias("_text"))
    groups = similar_texts(rows, "_row", "_text", words=5, similarity=0.8)
    stay = keep(groups.where("node = root").select(F.col("node").alias("_row")), "stay")
    return rows.join(stay.hint("merge"), "_row").select("_doc.*")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; null stays null, empty stays empty, no row goes."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    return with_text(docs, rows, pii.redacted(F.col("_doc.text"), KINDS))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares, better documents likelier: a document comes once for each epoch, the last one of a source cut to the words it gives.

    The weight of a document is its quality score. Documents that take no words go, null and empty texts among them. Ids
    are those of the documents; a repeated document repeats its id.
    """
    score = quality.train(docs, table(spark, sf_dir, "labels"))
    rows = identified(docs)
    plain = rows.select("_doc.doc_id", "_doc.text", "_doc.source", "_row")
    plan = mix_sources(plain, carry=("_row",), weight=lambda text, size: F.greatest(F.round(quality.score_column(score, text), 3), F.lit(0.001)))
    taken = keep(plan.where("taken > 0").select("_row", F.col("size").alias("_size"), F.col("taken").alias("_taken")), "taken")
    copies = F.explode(F.expr("sequence(0L, (_taken - 1) div _size)"))
    rows = rows.join(taken.hint("merge"), "_row").withColumn("_copy", copies).withColumn("_words", F.least("_size", F.col("_taken") - F.col("_copy") * F.col("_size")))
    first = F.expr(r"array_join(slice(regexp_extract_all(_doc.text, '[ \\t-\\r]*[^ \\t-\\r]+', 0), 1, cast(_words as int)), '')")
    return with_text(docs, rows, F.when(F.col("_words") < F.col("_size"), first).otherwise(F.col("_doc.text")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents that are left, with their ids; see pack_documents for its defined results."""
    return pack_documents(docs, with_ids=True)


STAGES = [("quality", quality_stage), ("near_duplicates", dedup_stage), ("personal_data", pii_stage), ("mixing", mix_stage), ("packing", packing_stage)]

#: A trained classifier and byte-level ids are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents."""
    docs = table(prepare(spark), sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs, name)
    return docs
