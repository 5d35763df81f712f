"""SimHash near-duplicates, linked through pigeonring-filtered candidates.

A fingerprint is cut into r + 1 segments on a ring. If two fingerprints differ in at most r bits, some
start has every chain of l consecutive segments differ in at most floor(l * r / (r + 1)) = l - 1 bits.
So the start segment is equal and the next one differs in one bit at most, hence one half of the next
is equal too: 2 * (r + 1) exact keys (start, half) find every pair. Pairs that share a key go on along
the chain from their key's start, one segment at a time, and leave it where its budget is exceeded;
who holds the whole ring's budget is within r bits.

Copies of a fingerprint are one node. A key shared by more than `block` nodes is dealt out as pairs
of blocks, so no task holds more than two blocks and none is capped; each task reports
only a spanning forest of its links. A node is (smallest id, fingerprint), so that the smallest node a
component reaches already holds its name.

similar_texts() links texts by their word shingles: fingerprints of the texts' distinct words give
the candidates, the sets of shingles decide. An edit breaks `words` shingles but one word, so texts of
a Jaccard similarity of 0.8 on five-word shingles lie within a few bits there; see its docstring.

Defined results: null, empty and blank texts have fingerprint zero, which is linked like any other;
null ids take part with their fingerprint but are no component's name; rows that repeat an id
are fingerprinted each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, forget, keep, shuffle_tasks, sorted_groups, spanning_forest, table, text_slices

_STEP = 1 << 15
_NO_ID = (1 << 63) - 1


def word_list(text: bytes | None) -> list[bytes]:
    """On bytes: only A-Z is lower-cased, and white space is \\x20 \\x09-\\x0D."""
    return text.lower().split() if text else []


def fingerprint(text: bytes | None, words: int = 4, distinct: bool = False) -> bytes:
    """Eight big-endian bytes: the majority bits of XXH64 (seed 42) over the word shingles, or over the distinct ones."""
    import numpy as np
    import xxhash

    w = word_list(text)
    if not w:
        return bytes(8)
    joined, digest = b" ".join(w), partial(xxhash.xxh64_digest, seed=42)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    n = max(1, len(w) - words + 1)
    stops = (ends[words - 1 :] if len(w) >= words else ends[-1:]) - 1
    starts = np.concatenate(([0], ends[: n - 1]))
    counts, seen = np.zeros(64, np.int64), set()
    for at in range(0, n, _STEP):
        cut = map(joined.__getitem__, map(slice, starts[at : at + _STEP].tolist(), stops[at : at + _STEP].tolist()))
        if distinct:
            seen.update(cut)
            continue
        bits = np.unpackbits(np.frombuffer(b"".join(map(digest, cut)), np.uint8))
        counts += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    if distinct:
        n = len(seen)
        counts = np.unpackbits(np.frombuffer(b"".join(map(digest, seen)), np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > n).tobytes()


def fingerprints(df: DataFrame, row: Column, text_col: str, words: int, distinct: bool = False) -> DataFrame:
    """(row, key, fp, size): fp the fingerprint's 64 bits as a signed long, key the text's md5 digest, size its bytes."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        for b in text_slices(batches, 2 << 20):
            texts = b.column(1).to_pylist()
            fp = [int.from_bytes(fingerprint(t, words, distinct), "big", signed=True) for t in texts]
            key = pa.array([hashlib.md5(t or b"").digest() for t in texts], pa.binary())
            size = pa.array([len(t or b"") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), key, pa.array(fp, pa.int64()), size], ["row", "key", "fp", "size"])

    source = df.select(row.alias("row"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, key binary, fp long, size long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(bit offset, width) of distance + 1 segments as equal as can be."""
    n = distance + 1
    widths = [64 // n + (i < 64 % n) for i in range(n)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def chain_keys(distance: int) -> list[Column]:
    """A key for each start segment and each half of the one after it."""
    ring = segments(distance)
    part = lambda offset, width: F.shiftrightunsigned("fp", offset).bitwiseAND((1 << width) - 1)
    keys = []
    for i, (offset, width) in enumerate(ring):
        at, n = ring[(i + 1) % len(ring)]
        for half, (place, bits) in enumerate(((at, n // 2), (at + n // 2, n - n // 2))):
            keys.append(F.lit((i * 2 + half) << 56) + F.shiftleft(part(offset, width), bits) + part(place, bits))
    return keys


def _chain_masks(distance: int):
    """Rotation of each start, and for each start the masks of chains of 2, 3, ... segments after it."""
    import numpy as np

    ring = segments(distance)
    masks = [[(1 << sum(w for _, w in (ring[s:] + ring[:s])[:length])) - 1 for length in range(2, len(ring) + 1)] for s in range(len(ring))]
    return np.array([o for o, _ in ring], np.uint64), np.array(masks, np.uint64)


def _bucket_links(distance: int, fields: list[str]):
    """Rows sorted by (key, x, y): a spanning forest of the links of each run of them."""

    def forest(rows):
        import numpy as np

        group = np.stack([rows[k] for k in ("key", "x", "y")])
        new = np.append(True, (group[:, 1:] != group[:, :-1]).any(0))
        ends = np.append(np.flatnonzero(new)[1:], len(new))[np.cumsum(new) - 1]
        turns, masks = _chain_masks(distance)
        fp, start = rows["fp"].view(np.uint64), rows["key"] >> np.int64(57)
        turn = turns[start]
        ring = (fp >> turn) | np.where(turn > 0, fp << ((np.uint64(64) - turn) & np.uint64(63)), np.uint64(0))
        cross, found = rows["x"] != rows["y"], []
        i, step = np.arange(len(new)), 0
        while True:  # every row with the one `step` further on in its group
            step += 1
            i = i[i + step < ends[i]]
            if not len(i):
                break
            a = i if not cross.any() else i[~cross[i] | (rows["blk"][i] != rows["blk"][i + step])]
            differ = ring[a] ^ ring[a + step]
            for length in range(masks.shape[1]):  # along the chain; who exceeds a budget is dropped before the next segment
                good = np.bitwise_count(differ & masks[start[a], length]) <= length + 1
                a, differ = a[good], differ[good]
            found.append(np.stack((a, a + step)))
        i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return spanning_forest(len(new), i, j)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["key", "x", "y", "blk", *fields]

        def send(rows):
            moved, root = forest(rows)
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(rows[f][at]) for at in (moved, root) for f in fields], [f"{s}_{f}" for s in "ab" for f in fields])

        rest = {}
        for b in batches:
            if not b.num_rows:
                continue
            rows = {n: b.column(n).to_numpy(zero_copy_only=False) for n in names}
            rows = {k: np.concatenate((rest[k], v)) for k, v in rows.items()} if rest else rows
            last = np.flatnonzero(np.any([rows[k] != rows[k][-1] for k in ("key", "x", "y")], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            if cut:
                yield from send({k: v[:cut] for k, v in rows.items()})
            rest = {k: v[cut:] for k, v in rows.items()}
        if rest:
            yield from send(rest)

    return run


def links(classes: DataFrame, distance: int = 4, block: int = 1024) -> DataFrame:
    """Links between distinct fingerprints (fp, id) that connect all within `distance` bits: a, b as structs (id, fp)."""
    if not 1 <= distance <= 15:
        raise ValueError("distances of 1 to 15 bits have chain keys")
    keyed = classes.select("id", "fp", F.explode(F.array(*chain_keys(distance))).alias("key"))
    shared = keyed.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = keyed.join(shared.hint("merge"), "key").withColumn("blk", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = dealt.select("key", "id", "fp", "blk", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    pairs = pairs.select("key", F.least("blk", "other").alias("x"), F.greatest("blk", "other").alias("y"), "blk", "id", "fp")
    # The cost of a tile is its pairs, not its bytes: a stated number of tasks is not merged into fewer.
    tiles = pairs.repartition(shuffle_tasks(classes.sparkSession), "key", "x", "y").sortWithinPartitions("key", "x", "y")
    found = tiles.mapInArrow(_bucket_links(distance, ["id", "fp"]), "a_id long, a_fp long, b_id long, b_fp long")
    return found.select(*[F.struct(F.col(f"{s}_id").alias("id"), F.col(f"{s}_fp").alias("fp")).alias(s) for s in "ab"])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row; component_id is the smallest id its links reach."""
    fps = keep(fingerprints(df, F.col(id_col).cast("long"), text_col, words).select(F.col("row").alias("doc_id"), "fp"), "fingerprints")
    classes = fps.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(_NO_ID)).alias("id"))
    roots = connected_components(links(classes, distance)).select(F.col("node.fp").alias("fp"), F.col("root.id").alias("name"))
    named = classes.join(roots, "fp", "left").select("fp", F.nullif(F.coalesce("name", "id"), F.lit(_NO_ID)).alias("component_id"))
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- texts that share most of their shingles ------------------------------------------------------

#: Bytes of text that a block of candidates holds, about: a longer text is one by itself, with what falls to its block.
TILE_BYTES = 8 << 20


def shingle_set(text: bytes | None, words: int = 5):
    """The sorted distinct 64-bit hashes of the word shingles; of fewer words the whole sequence is one."""
    import numpy as np
    import xxhash

    w = word_list(text)
    if not w:
        return np.zeros(0, np.uint64)
    x, k = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w)), min(words, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[j : j + len(h)]
    return np.unique(h ^ (h >> np.uint64(32)))


def overlaps(sets, i, j, most: int = 1 << 22):
    """How many values the sets i[p] and j[p] share, for each p; memory follows the sets and `most` values compared at a time."""
    import numpy as np

    size = np.array([len(s) for s in sets])
    first = np.concatenate(([0], np.cumsum(size)))
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    mark, both, order = np.zeros(len(values), bool), np.zeros(len(i), np.int64), np.argsort(i, kind="stable")
    cuts = [*np.flatnonzero(np.append(True, i[order][1:] != i[order][:-1])).tolist(), len(i)] if len(i) else [0]
    for a, z in zip(cuts, cuts[1:]):
        own = code[first[i[order[a]]] : first[i[order[a]] + 1]]
        mark[own] = True
        others = j[order[a:z]]
        upto, at = np.cumsum(size[others]), 0
        while at < len(others):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
            to = others[at:end]
            n = size[to]
            place = np.arange(n.sum()) + np.repeat(first[to] - (np.cumsum(n) - n), n)
            both[order[a + at : a + end]] = np.bincount(np.repeat(np.arange(len(to)), n), mark[code[place]], len(to)).astype(np.int64)
            at = end
        mark[own] = False
    return both


def alike(fp, sets, label, similarity: float, distance: int, side):
    """Rows and their new roots under links of Jaccard similarity >= `similarity` among fingerprints within `distance`.

    Rows of one label count as linked already; nearest fingerprints are compared first. Only pairs that have a row
    whose side is true are compared.
    """
    import numpy as np

    n, pairs = np.array([len(s) for s in sets]), []
    for at in range(0, len(fp), 512):
        rows = np.arange(at, min(len(fp), at + 512))
        d = np.bitwise_count(fp[rows, None] ^ fp[None, :])
        ok = (d <= distance) & (rows[:, None] < np.arange(len(fp))[None, :]) & (label[rows, None] != label[None, :]) & (side[rows, None] | side[None, :])
        ok &= np.minimum(n[rows, None], n[None, :]) >= similarity * np.maximum(n[rows, None], n[None, :]) - 1e-9
        i, j = np.nonzero(ok)
        pairs.append(np.stack((d[i, j].astype(np.int64), rows[i], j)))
    pairs = np.concatenate(pairs, axis=1)
    pairs = pairs[1:, np.argsort(pairs[0], kind="stable")]
    root = np.unique(label, return_index=True)[1][label]  # the first row of each label
    before, step = root.copy(), 4096
    for at in range(0, pairs.shape[1], step):
        i, j = pairs[:, at : at + step]
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
        both = overlaps(sets, i, j)
        good = both >= similarity * (n[i] + n[j] - both) - 1e-9
        moved, to = spanning_forest(len(fp), root[i[good]], root[j[good]])
        up = np.arange(len(fp))
        up[moved] = to
        root = up[root]
    moved = np.flatnonzero((before == np.arange(len(fp))) & (root != before))
    return moved, root[moved]


def _tile_links(words: int, similarity: float, distance: int):
    """Rows sorted by tile: a spanning forest of the links between a tile's texts, as pairs of row numbers of nodes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for g in sorted_groups(batches, ["tile"]):
            if g.num_rows < 2:
                continue
            label = np.unique(np.array([str(x) for x in g["label"].to_pylist()]), return_inverse=True)[1]
            sets = [shingle_set(t, words) for t in g["text"].to_pylist()]
            moved, root = alike(g["fp"].to_numpy().view(np.uint64), sets, label, similarity, distance, g["side"].to_numpy().astype(bool))
            if len(moved):
                node = g["node"].combine_chunks()
                yield pa.RecordBatch.from_arrays([node.take(pa.array(at)) for at in (moved, root)], ["a", "b"])

    return run


def similar_texts(df: DataFrame, row_col: str, text_col: str = "text", *, words: int = 5, similarity: float = 0.8, distance: int = 8, block: int = 512) -> DataFrame:
    """(key, node, root) for each distinct text: node is the smallest row that has it, root the smallest row of its group.

    row_col is a column of any orderable type, unique in df and the same whenever df is read. Groups connect texts
    whose `words`-word shingle sets have a Jaccard similarity of `similarity` or more and whose fingerprints (SimHash of
    the distinct words) lie within `distance` bits. Candidates are found by chain keys over all distinct fingerprints;
    texts that candidates connect are dealt out as blocks, and no join is broadcast: nothing of the tables passes through the driver. A first pass compares within blocks, each with the text
    that has most copies; a second one compares only texts outside the largest group with all the others of
    their candidates' component. No pair is skipped but those whose texts are in one group already.

    Defined results: null and empty text are one text; blank texts and it have one empty set, and are similar; a text of
    fewer words has one shingle; an empty table gives an empty result.
    """
    spark = df.sparkSession
    prints = fingerprints(df, F.col(row_col), text_col, 1, distinct=True)
    classes = keep(prints.groupBy("key").agg(F.min("row").alias("node"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.count("*").alias("copies")), "texts")
    prints = classes.groupBy("fp").agg(F.lit(0).cast("long").alias("id"), F.count("*").alias("n"))
    near = connected_components(links(prints, distance)).select(F.col("node.fp").alias("fp"), F.col("root.fp").alias("ring"))
    ring = prints.join(near.hint("merge"), "fp", "left").where("ring is not null or n > 1").select("fp", F.coalesce("ring", "fp").alias("ring"))
    placed = classes.join(ring.hint("merge"), "fp")
    fill = lambda what: F.ceil(F.greatest(F.count("*") / block, F.sum("size") / TILE_BYTES, F.lit(1))).cast("int").alias(what)
    sizes = placed.groupBy("ring").agg(fill("blocks"), F.max_by("node", F.struct("copies", "node")).alias("pivot")).where("blocks > 0")
    placed = keep(placed.join(sizes.hint("merge"), "ring").withColumn("blk", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")), "placed")
    texts = df.select(F.col(row_col).alias("node"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = classes.schema["node"].dataType.simpleString()

    def compared(tiles: DataFrame) -> DataFrame:
        # Texts are dealt out by row at every size of the input, so that the plan and its cost stay in proportion.
        full = texts.join(tiles.groupBy("node").agg(F.first("fp").alias("fp"), F.collect_list(F.struct("tile", "label", "side")).alias("t")).hint("merge"), "node")
        full = full.select("node", "fp", "text", F.explode("t").alias("t")).select("t.*", "node", "fp", "text")
        full = full.repartition(shuffle_tasks(spark), "tile").sortWithinPartitions("tile")
        return keep(full.mapInArrow(_tile_links(words, similarity, distance), f"a {kind}, b {kind}"), "similar")

    every = F.when((F.col("node") == F.col("pivot")) & (F.col("blocks") > 1), F.expr("sequence(0, blocks - 1)")).otherwise(F.array("blk"))
    first = placed.select("node", "fp", F.col("node").alias("label"), F.lit(True).alias("side"), "ring", F.explode(every).alias("b"))
    done = [compared(first.withColumn("tile", F.xxhash64("ring", "b")))]
    wide = placed.where("blocks > 1")
    if not wide.isEmpty():
        named = wide.join(connected_components(done[0]).hint("merge"), "node", "left").withColumn("label", F.coalesce("root", "node"))
        counts = named.groupBy("ring", "label").agg(F.count("*").alias("n")).groupBy("ring").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
        named = named_table = keep(named.join(counts.hint("merge"), "ring").withColumn("side", F.col("label") != F.col("main")), "labelled")
        rest = named.where("side").groupBy("ring").agg(fill("open"))
        named = named.join(rest.hint("merge"), "ring").withColumn("ob", F.pmod(F.xxhash64("key", F.lit(1)), F.col("open")).cast("int"))
        right = named.select("node", "fp", "label", F.lit(False).alias("side"), "ring", "blk", F.explode(F.expr("sequence(0, open - 1)")).alias("ob"))
        left = named.where("side").select("node", "fp", "label", "side", "ring", F.explode(F.expr("sequence(0, blocks - 1)")).alias("blk"), "ob")
        again = left.unionByName(right).groupBy("ring", "blk", "ob", "node", "fp", "label").agg(F.max("side").alias("side"))
        done.append(compared(again.withColumn("tile", F.xxhash64("ring", "blk", "ob"))))
        forget(named_table)
    roots = connected_components(reduce(DataFrame.unionByName, done))
    forget(placed, *done)
    return classes.join(roots.hint("merge"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
