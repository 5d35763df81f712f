"""Embedding near-duplicates and nearest neighbours.

Near-duplicates: vectors are turned onto their principal axes, so a few leading dimensions hold most
of a product. A tile of pairs adds dimensions in that order; what is left of a product is at most the
product of the suffix norms, and a pair whose bound falls below the threshold is dropped. Vectors
within the threshold differ little on the first axis, so only equal or adjacent slabs of it
meet; a slab of any size is dealt out as pairs of blocks. Exact copies are one node with a count.

Nearest neighbours: see nearest().

Defined results: a vector that is null, zero, or holds null or non-finite components, and a row whose
id (or label, for near-duplicates) is null, takes no part: no links, its own component, kept. Only
vectors of equal length are compared. Rows that repeat an id with the same vector count as copies;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, sqrt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, forget, keep, matrix, shuffle_tasks, sorted_groups, spanning_forest, table

_UNUSABLE = "embedding is null or size(embedding) = 0 or exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) or not exists(embedding, x -> x <> 0)"


def _principal_axes(vectors: DataFrame) -> dict:
    """For each dimension the axes of the unit vectors' second moment, strongest first, over all rows."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        total = {}
        for b in batches:
            dims = b.column("dim").to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                x = matrix(b.column("embedding").filter(pa.array(dims == d)), int(d))
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                total[int(d)] = total.get(int(d), 0) + x.T @ x
        for d, m in total.items():
            i, j = np.indices((d, d))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d)), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(m.ravel())], ["dim", "i", "j", "v"])

    sums = vectors.select("dim", "embedding").mapInArrow(run, "dim long, i long, j long, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v"))
    out = {}
    for r in sums.collect():  # dim x dim numbers for each dimension there is
        out.setdefault(r.dim, np.zeros((r.dim, r.dim)))[r.i, r.j] = r.v
    return {d: np.linalg.eigh(m)[1][:, ::-1].copy() for d, m in out.items()}


def tile_pairs(x, y, same: bool, threshold: float, axes, rows: int = 512):
    """(i, j) of rows of x and y (both original vectors) with cosine >= threshold; i < j where they are the same tile.

    x is taken some rows at a time, so memory follows `rows` and not the tile.
    """
    import numpy as np

    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    p, q = (x / nx[:, None]) @ axes, (y / ny[:, None]) @ axes
    d = p.shape[1]
    floor, step = threshold - 1e-9, max(4, d // 8)
    ends = list(range(step, d, step)) + [d]
    rest = lambda m: {k: np.sqrt(np.maximum(0, (m[:, k:] ** 2).sum(1))) for k in ends}
    rest_p, rest_q, out = rest(p), rest(q), []
    for a in range(0, len(p), rows):
        part, first = p[a : a + rows], a if same else 0  # the same tile: nothing left of its own rows
        total = np.zeros((len(part), len(q) - first))
        for done, k in zip([0, *ends], ends):
            total += part[:, done:k] @ q[first:, done:k].T
            alive = total + rest_p[k][a : a + rows, None] * rest_q[k][None, first:] >= floor
            if k == d or alive.mean() < 0.05:
                break
        i, j = np.nonzero(alive)
        value, i, j = total[i, j], i + a, j + first
        if same:
            i, j, value = i[i < j], j[i < j], value[i < j]
        while k < d and len(i):
            done, k = k, ends[ends.index(k) + 1]
            value = value + np.einsum("nd,nd->n", p[i, done:k], q[j, done:k])
            good = value + rest_p[k][i] * rest_q[k][j] >= floor
            i, j, value = i[good], j[good], value[good]
        for c in range(0, len(i), 1 << 16):  # the decision is made on the original vectors
            u, v = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
            ok = np.einsum("nd,nd->n", x[u], y[v]) / (nx[u] * ny[v]) >= threshold
            out.append((u[ok], v[ok]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, threshold: float = 0.93, block: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    A vector is sent once to each block of its own slab and of the two beside it, so large blocks keep copies few; a tile's
    memory does not follow its size squared.
    """
    import numpy as np

    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("string").alias("label"))
    bad = F.expr(f"label is null or vec_id is null or {_UNUSABLE}")
    # Two hashes name a labelled vector; together with its smallest id they are a node, whose order is that of ids.
    rows = rows.withColumn("h", F.when(~bad, F.struct(F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit("b"), "embedding", "label").alias("h2"))))
    classes = rows.where("h is not null").groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("h").alias("h"))
    classes = keep(classes.select("label", "embedding", "first", "copies", "h.h1", "h.h2", F.size("embedding").cast("long").alias("dim")), "classes")
    axes, width = _principal_axes(classes), sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9

    def slabs(batches):
        import pyarrow as pa

        for b in batches:
            dims, cell = b.column("dim").to_numpy(zero_copy_only=False), np.zeros(b.num_rows, np.int64)
            for d in np.unique(dims):
                x = matrix(b.column("embedding").filter(pa.array(dims == d)), int(d))
                cell[dims == d] = np.floor(x @ axes[int(d)][:, 0] / np.linalg.norm(x, axis=1) / width)
            yield b.append_column("cell", pa.array(cell))

    columns = ["label", "embedding", "first", "copies", "h1", "h2", "dim"]
    placed = classes.select(columns).mapInArrow(slabs, "label string, embedding array<double>, first long, copies long, h1 long, h2 long, dim long, cell long")
    placed = keep(placed.withColumn("slab", F.xxhash64("label", "dim")), "slabs")
    counts = placed.groupBy("slab", "dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("own"))
    along = Window.partitionBy("slab", "dim").orderBy("cell")
    beside = lambda f, step: F.when(f("cell").over(along) == F.col("cell") + step, f("own").over(along)).otherwise(0)
    counts = counts.withColumns({"below": beside(F.lag, -1), "above": beside(F.lead, 1)})
    dealt = placed.join(counts, ["slab", "dim", "cell"]).withColumn("blk", F.pmod(F.col("h2"), F.col("own")).cast("int"))
    meet = F.expr("""concat(
        transform(sequence(0, own - 1), j -> named_struct('c', cell, 'cross', 0, 'x', least(blk, j), 'y', greatest(blk, j), 'right', if(j < blk, 1, 0))),
        if(above = 0, array(), transform(sequence(0, above - 1), j -> named_struct('c', cell, 'cross', 1, 'x', blk, 'y', j, 'right', 0))),
        if(below = 0, array(), transform(sequence(0, below - 1), j -> named_struct('c', cell - 1, 'cross', 1, 'x', j, 'y', blk, 'right', 1))))""")
    keys = ["slab", "dim", "c", "cross", "x", "y"]
    tiles = dealt.withColumn("t", F.explode(meet)).select("slab", "dim", "t.*", "label", "first", "h1", "h2", "copies", "embedding")

    def compare(batches):
        import pyarrow as pa

        for g in sorted_groups(batches, keys):
            d, right = g["dim"][0].as_py(), g["right"].to_numpy().astype(bool)
            x, copies, label = matrix(g["embedding"], d), g["copies"].to_numpy(), np.array(g["label"].to_pylist())
            one = not g["cross"][0].as_py() and g["x"][0].as_py() == g["y"][0].as_py()
            left, other = (np.arange(len(x)),) * 2 if one else (np.flatnonzero(~right), np.flatnonzero(right))
            if len(left) == 0 or len(other) == 0:
                continue
            i, j = tile_pairs(x[left], x[other], one, threshold, axes[d])
            i, j = left[i], other[j]
            i, j = i[label[i] == label[j]], j[label[i] == label[j]]
            links = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
            moved, root = spanning_forest(len(x), i, j)
            some = np.flatnonzero(links)
            names = [g[c].to_numpy() for c in ("first", "h1", "h2")]
            a, b = np.concatenate((some, moved)), np.concatenate((some, root))
            n = np.concatenate((links[some], np.zeros(len(moved)))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(v[at]) for at in (a, b) for v in names] + [pa.array(n)], [f"{s}{k}" for s in "ab" for k in range(3)] + ["n"])

    shown = tiles.repartition(shuffle_tasks(df.sparkSession), *keys).sortWithinPartitions(*keys)
    found = keep(shown.mapInArrow(compare, ", ".join(f"{s}{k} long" for s in "ab" for k in range(3)) + ", n long"), "links")
    node = lambda *c: F.struct(*[F.col(x).alias(y) for x, y in zip(c, ("first", "h1", "h2"))])
    linked = found.where("n > 0").groupBy(node("a0", "a1", "a2").alias("node")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("n = 0").select(node("a0", "a1", "a2").alias("a"), node("b0", "b1", "b2").alias("b")))
    info = classes.select(node("first", "h1", "h2").alias("node"), "copies").join(linked, "node", "left").join(roots, "node", "left")
    info = info.select(F.struct("node.h1", "node.h2").alias("h"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root.first", "node.first").alias("component_id"))
    forget(placed)
    out = rows.select("vec_id", "h").join(info, "h", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


# ---- nearest neighbours -------------------------------------------------------------------------

_PARTS, _PART_BITS = 32, 8


def fit_codes(sample, seed: int = 7, rounds: int = 30):
    """(mean, projection) of 256 rotated sign bits: principal axes turned until signs lose least (ITQ), from several starts."""
    import numpy as np

    rng, bits = np.random.default_rng(seed), _PARTS * _PART_BITS
    mean = sample.mean(0)
    _, _, vt = np.linalg.svd(sample - mean, full_matrices=False)
    projections = []
    while sum(p.shape[1] for p in projections) < bits:  # short vectors are turned more than once
        v = vt[: min(bits, len(vt))].T
        z = (sample - mean) @ v
        turn = np.linalg.qr(rng.normal(size=(z.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(z @ turn > 0, 1.0, -1.0).T @ z)
            turn = (u @ w).T
        projections.append(v @ turn)
    return mean, np.hstack(projections)[:, :bits]


def codes(x, model):
    """Codes as rows of bytes, one for each substring."""
    import numpy as np

    mean, projection = model
    return np.packbits((x - mean) @ projection > 0, axis=1)


def distances(a, b):
    import numpy as np

    p, q = (np.ascontiguousarray(c).view(np.uint64) for c in (a, b))
    return sum(np.bitwise_count(p[:, w, None] ^ q[None, :, w]).astype(np.int32) for w in range(p.shape[1]))


def fit_radius(sample, model, k: int, share: float) -> int:
    """The Hamming radius that holds `share` of the sample's true neighbours; more rows bring neighbours nearer."""
    import numpy as np

    queries = np.arange(0, len(sample), max(1, len(sample) // 256))
    score = sample[queries] @ sample.T
    score[np.arange(len(queries)), queries] = -np.inf
    best = np.argsort(-score, axis=1)[:, : min(k, max(1, len(sample) - 1))]
    code = codes(sample, model)
    return int(np.quantile(np.take_along_axis(distances(code[queries], code), best, 1), share))


class MultiIndex:
    """Codes of some vectors, each substring with its own bucket table."""

    def __init__(self, ids, x, model):
        import numpy as np

        self.ids, self.x, self.code = ids, x, codes(x, model)
        self.order = [np.argsort(self.code[:, s], kind="stable") for s in range(_PARTS)]
        self.first = [np.searchsorted(self.code[o, s], np.arange((1 << _PART_BITS) + 1)) for s, o in enumerate(self.order)]
        self.flips = [np.flatnonzero(np.bitwise_count(np.arange(1 << _PART_BITS, dtype=np.uint8)) <= r) for r in range(_PART_BITS + 1)]
        self.words = self.code.view(np.uint64)

    def within(self, code, radius: int):
        """Every row whose code differs from `code` in at most radius bits.

        Substring budgets r_s with sum(r_s + 1) = radius + 1: one substring must keep within its own.
        """
        import numpy as np

        budget, more = divmod(radius + 1, _PARTS)
        seen = np.zeros(len(self.ids), bool)
        for s in range(_PARTS):
            r = min(_PART_BITS, budget - 1 + (s < more))
            if r >= 0:
                first, order, values = self.first[s], self.order[s], code[s] ^ self.flips[r]
                seen[np.concatenate([order[a:b] for a, b in zip(first[values], first[values + 1])])] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.words[rows] ^ code.view(np.uint64)).sum(1, dtype=np.int64) <= radius]

    def search(self, query_id, q, code, radius: int, k: int):
        """The k best inner products within the radius, which widens while it holds fewer than k others."""
        import numpy as np

        bits = _PARTS * _PART_BITS
        while True:
            rows = self.within(code, radius)
            rows = rows[self.ids[rows] != query_id]
            if len(rows) >= k or radius >= bits:
                break
            radius = min(bits, radius + _PARTS)
        score = (self.x[rows] * q).sum(1)  # row by row, so that equal vectors have equal scores wherever they stand
        if len(rows) > k:
            cut = score >= np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[cut], score[cut]
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best]


def nearest(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 20, sample: int = 4096, share: float = 0.97, shard: int = 1 << 14) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products with vectors of its length, by multi-index hashing.

    Codes and radius are fitted on `sample` vectors, taken by the order of a hash of their ids. All
    vectors lie in shards of about `shard` rows, each with its own substring tables; blocks of
    queries visit every shard, each gives its k best after reranking on floats, and those are merged.
    Of equal vectors only the k + 1 smallest ids can be results, so further copies stay out. A query id that repeats asks
    with its smallest vector.
    """
    import numpy as np

    spark = df.sparkSession
    use = lambda t: t.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).where(F.expr(f"not (vec_id is null or {_UNUSABLE})"))
    base, asked = use(df), use(queries)
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    base = keep(base.distinct().withColumn("rn", first).where(F.col("rn") <= k + 1).drop("rn"), "vectors")
    lengths = sorted(r[0] for r in base.select(F.size("embedding")).distinct().collect())
    if len(lengths) > 1:  # each length has its own codes and radius
        of = lambda t, n: t.where(F.size(vector_col) == n)
        return reduce(DataFrame.unionByName, [nearest(of(df, n), of(queries, n), id_col, vector_col, k=k, sample=sample, share=share, shard=shard) for n in lengths])
    n = base.count()
    picked = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], empty)
    dim = len(picked[0].embedding)
    few = np.array([r.embedding for r in picked if len(r.embedding) == dim])
    model = fit_codes(few)
    radius = fit_radius(few, model, k, share)
    shards = max(ceil(n / shard), min(8, ceil(n / 256)))
    # The number of query blocks keeps a block about as large as a shard.
    asked = asked.where(F.size("embedding") == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = F.lit(max(1, ceil(n / shard / 16)))
    side = lambda t, kind: t.select(F.lit(kind).alias("kind"), "vec_id", "embedding", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards) if kind == 0 else blocks).cast("int").alias("own"))
    held = side(base.where(F.size("embedding") == dim), 0).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).selectExpr("own as shard", "other as block", "kind", "vec_id", "embedding")
    ask = side(asked, 1).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).selectExpr("other as shard", "own as block", "kind", "vec_id", "embedding")

    def run(batches):
        import pyarrow as pa

        index, at = None, None
        rows = sorted_groups(batches, ["shard", "block", "kind"])
        for g in rows:
            ids, x, where = g["vec_id"].to_numpy(), matrix(g["embedding"], dim), (g["shard"][0].as_py(), g["block"][0].as_py())
            if g["kind"][0].as_py() == 0:
                index, at = MultiIndex(ids, x, model), where
                continue
            if at != where:
                continue
            code = codes(x, model)
            got = [(i, *index.search(i, q, c, radius, k)) for i, q, c in zip(ids, x, code)]
            who = np.repeat([g_[0] for g_ in got], [len(g_[1]) for g_ in got])
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(np.concatenate([g_[1] for g_ in got]), pa.int64()), pa.array(np.concatenate([g_[2] for g_ in got]), pa.float64())], ["query_id", "vec_id", "score"])

    keys = ["shard", "block"]
    found = held.unionByName(ask).repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(run, "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
