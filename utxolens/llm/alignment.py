"""Two tokenizers' views of a corpus, aligned on bytes.

Every token is an event at the byte offset where it ends. The events of both sides are united, dealt
out by document and put in order of offset; a machine then reads them once. Where both sides end, a
group is closed; between two neighbouring ends lies exactly one pair of overlapping tokens, a link.
The machine's state is the group that is open and a running digest, whatever a document's length; it also holds the distinct
id pairs of the one document it reads, which the counts per document need.

A row of events is a run of consecutive tokens of one side (`start`: where the first one begins, `ids`), since the length of
every token follows from its id; the machine takes many rows at a time as arrays.

An id pair's count is the number of documents that hold it linked. Tasks add up their pairs before they
are shuffled. The counts come back to the documents in slices of bounded size: pairs are cut by
residue, each slice is copied to a few tasks, and each document's pairs are dealt to them.

Defined results: texts that are null, empty, or that the tokens of either side do not give back byte for byte have no tokens (zeros,
an empty digest) and count for nothing; rows are told apart by their place, so null and repeated ids
each give their own row, and a repeated document counts for itself; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, keep, shuffle_tasks, table, text_slices
from .tokens import CACHE_CHARS, CACHE_ENTRIES, Encoder, default_vocabulary

#: Tokens of one side that a row of events holds at most.
RUN = 1 << 15
#: Distinct pairs that a slice of the counts holds at most, about.
SLICE = 1 << 20
_SPACE = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")
#: The largest byte offset is below 1 << AT.
AT = 40


class ByteSide:
    """Ids of a byte-level vocabulary for space + text; literals of special tokens are plain text."""

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        self.encoder.tokenizer.encode_special_tokens, self.encoder.added = True, []
        back = {c: b for b, c in self.encoder.letters.items()}
        vocabulary = self.encoder.tokenizer.get_vocab()
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.pieces[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(ids, "<u4") for ids in self.encoder.batch([" " + t for t in texts])]


class PieceSide:
    """Ids of a sentence-piece vocabulary for text, which it puts a space before.

    No piece has a space behind another character, so no token crosses the place between such a
    character and a space: texts are cut there, and a worker keeps the ids of a bounded number of chunks.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = [bytes([int(m[1], 16)]) if (m := _BYTE.match(n)) else n.replace(_SPACE, " ").encode() for n in names]
        self.cut = not any(" " in n.replace(_SPACE, " ").lstrip(" ") for n in names)
        self.kept: dict[str, bytes | None] = {}

    def _ids(self, chunks: list[str]) -> list[bytes | None]:
        """Ids of chunks, None for one that its tokens do not give back."""
        out = []
        for c, ids in zip(chunks, self.model.encode(chunks, num_threads=1)):
            # The model gives nothing for an empty text; here it is a single space at a text's end.
            ids = ids if c else [self.model.piece_to_id(_SPACE)]
            same = b"".join([self.pieces[i] for i in ids]) == b" " + c.encode()
            out.append(array("I", ids).tobytes() if same else None)
        return out

    def batch(self, texts: list[str]) -> list[np.ndarray | None]:
        rows, new, get = [], {}, self.kept.get
        for t in texts:
            if not self.cut or _SPACE in t:
                parts = [t]
            elif "  " in t or t[:1] == " " or t[-1:] == " ":
                parts = [p[1:] for p in re.findall(r" +[^ ]*", " " + t)]
            else:
                parts = t.split(" ")
            ids = list(map(get, parts))
            holes = [i for i, b in enumerate(ids) if b is None]
            new.update((parts[i], None) for i in holes)
            rows.append((ids, [(i, parts[i]) for i in holes]))
        new = dict(zip(new, self._ids(list(new))))
        out = []
        for ids, holes in rows:
            for i, p in holes:
                ids[i] = new[p]
            out.append(None if None in ids else np.frombuffer(b"".join(ids), "<u4"))
        if len(self.kept) < CACHE_ENTRIES:
            self.kept.update((p, b) for p, b in new.items() if len(p) <= CACHE_CHARS and b is not None)
        return out


_SIDES: dict = {}


def _side(kind, path: str):
    """This worker's tokenizer of a file."""
    if (kind, path) not in _SIDES:
        _SIDES[kind, path] = kind(path)
    return _SIDES[kind, path]


def _sides(a_path: str, b_path: str):
    return _side(ByteSide, a_path), _side(PieceSide, b_path)


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


EVENTS = "row long, doc_id long, start long, side int, ids binary"


def end_events(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Runs of token ends of both sides; a document without tokens has one row of side 2."""

    def run(batches):
        import pyarrow as pa

        a, b = _sides(a_path, b_path)
        sizes = [np.array([len(p) for p in s.pieces]) for s in (a, b)]
        kind = "<u2" if max(map(len, sizes)) <= 1 << 16 else "<u4"
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("side", pa.int32()), ("ids", pa.binary())])
        for part in text_slices(batches, text="text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            out = [[], [], [], [], []]
            for row, doc, text, x, y in zip(part.column("row").to_pylist(), part.column("doc_id").to_pylist(), texts, a.batch(texts), b.batch(texts)):
                n = len(text.encode()) + 1
                sound = text and y is not None and sizes[0][x].sum() == n == sizes[1][y].sum()
                if not sound:
                    runs = [(0, 2, b"")]
                else:
                    runs = []
                    for side, ids in ((0, x), (1, y)):
                        for k in range(0, len(ids), RUN):
                            runs.append((int(sizes[side][ids[:k]].sum()) if k else 0, side, ids[k : k + RUN].astype(kind).tobytes()))
                for start, side, ids in runs:
                    for column, v in zip(out, (row, doc, start, side, ids)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return docs.mapInArrow(run, EVENTS)


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0..n-1, left-aligned in zero bytes, and how many each has."""
    text = np.array([str(i).encode() for i in range(n)])
    width = text.dtype.itemsize
    table = text.view(np.uint8).reshape(n, width)
    return table, (table != 0).sum(1)


class Sweep:
    """The machine: takes slices of event rows in (row, start, side) order, gives finished documents."""

    def __init__(self, a_pieces: list[bytes], b_pieces: list[bytes]):
        self.sizes = [np.array([len(p) for p in s], np.int64) for s in (a_pieces, b_pieces)]
        self.n_b = len(b_pieces)
        self.kind = "<u2" if max(map(len, self.sizes)) <= 1 << 16 else "<u4"
        self.table, self.n_digits = _digits(max(map(len, self.sizes)))
        self.open: dict | None = None

    def _fresh(self, row: int, doc_id) -> dict:
        none = [np.empty(0, np.int64)] * 2
        return {"row": row, "doc_id": doc_id, "counts": np.zeros(4, np.int64), "digest": hashlib.sha256(), "codes": [], "times": [], "ends": none, "ids": none}

    def _close(self, d: dict) -> tuple:
        """A document's result: (row, doc_id, n_a, n_b, n_groups, n_links, digest, codes, times)."""
        if len(d["ends"][0]) or len(d["ends"][1]):
            raise ValueError(f"document {d['doc_id']}: the sides do not end together")
        codes, times = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(d["codes"]) == 1:
            codes, times = d["codes"][0], d["times"][0]
        elif d["codes"]:
            codes, at = np.unique(np.concatenate(d["codes"]), return_inverse=True)
            times = np.bincount(at, np.concatenate(d["times"])).astype(np.int64)
        return d["row"], d["doc_id"], *d["counts"].tolist(), d["digest"].hexdigest() if d["counts"][3] else "", codes, times

    def take(self, rows, doc_ids, start, side, offsets, ids) -> list[tuple]:
        """A slice of rows: ids are those of all rows, offsets (one more than rows) where each row's begin."""
        done, documents = [], []
        change = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        if self.open is not None:
            if self.open["row"] == rows[0]:
                documents.append(self.open)
                change = change[1:]
            else:
                done.append(self._close(self.open))
        documents += [self._fresh(int(rows[i]), doc_ids[i]) for i in change]
        ordinal = np.zeros(len(rows), np.int64)
        ordinal[change] = 1
        ordinal = np.cumsum(ordinal) - (0 if self.open is not None and self.open["row"] == rows[0] else 1)
        n, keys, tokens = np.diff(offsets), [], []
        held = documents[0]
        of_row = np.repeat(np.arange(len(rows)), n)
        for s in (0, 1):
            mine = side[of_row] == s
            t, r = ids[mine].astype(np.int64), of_row[mine]
            length = self.sizes[s][t]
            total = np.cumsum(length)
            first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.empty(0, np.int64)
            before = np.repeat(total[first] - length[first], np.diff(np.append(first, len(r))))
            end = total - before + start[r]
            # The first document's open group comes before.
            keys.append(np.concatenate((held["ends"][s], (ordinal[r] << AT) | end)))
            tokens.append(np.concatenate((held["ids"][s], t)))
        self._sweep(documents, keys, tokens)
        done += map(self._close, documents[:-1])
        self.open = documents[-1]
        return done

    def _sweep(self, documents: list[dict], keys: list, tokens: list) -> None:
        """Close every group that ends in these tokens; what follows the last document's stays open."""
        nothing = [np.empty(0, np.int64)] * 2
        for d in documents:
            d["ends"], d["ids"] = nothing, nothing
        at = np.searchsorted(keys[1], keys[0])
        both = at < len(keys[1])
        both[both] = keys[1][at[both]] == keys[0][both]
        common = keys[0][both]
        last, offset = documents[-1], (1 << AT) - 1
        cut = [int(np.searchsorted(k, common[-1], "right")) if len(common) else 0 for k in keys]
        if any((k[c:] >> AT != len(documents) - 1).any() for k, c in zip(keys, cut)):
            raise ValueError("the sides of a document do not end together")
        # It goes on as the next slice's document 0.
        last["ends"], last["ids"] = [k[c:] & offset for k, c in zip(keys, cut)], [t[c:] for t, c in zip(tokens, cut)]
        if not len(common):
            return
        (a, b), (x, y), m = [k[:c] for k, c in zip(keys, cut)], [t[:c] for t, c in zip(tokens, cut)], len(documents)
        every = np.concatenate((a, b))
        every.sort(kind="stable")
        link = every[np.concatenate(([True], every[1:] != every[:-1]))]
        code = x[np.searchsorted(a, link)] * self.n_b + y[np.searchsorted(b, link)]
        of = [v >> AT for v in (a, b, common, link)]
        counts = np.stack([np.bincount(v, minlength=m) for v in of], 1)
        pair, times = np.unique((of[3] << AT) | code, return_counts=True)
        pair_cut = np.searchsorted(pair, np.arange(m + 1) << AT)
        text, text_cut = self._text(a, b, x, y, common, m)
        for i, d in enumerate(documents):
            if not counts[i, 2]:
                continue
            if d["counts"][2]:
                d["digest"].update(b";")
            d["digest"].update(text[text_cut[i] : text_cut[i + 1] - 1])
            d["counts"] = d["counts"] + counts[i]
            p = slice(pair_cut[i], pair_cut[i + 1])
            d["codes"].append(pair[p] & offset)
            d["times"].append(times[p])
            if len(d["codes"]) > 64:
                codes, where = np.unique(np.concatenate(d["codes"]), return_inverse=True)
                d["times"], d["codes"] = [np.bincount(where, np.concatenate(d["times"])).astype(np.int64)], [codes]

    def _text(self, a, b, x, y, common, m: int):
        """`a1,a2|b1;` of all groups in order, and where each document's begin."""
        ga, gb = np.searchsorted(common, a), np.searchsorted(common, b)
        na, nb = np.cumsum(np.bincount(ga, minlength=len(common))), np.cumsum(np.bincount(gb, minlength=len(common)))
        out = np.zeros((len(a) + len(b), self.table.shape[1] + 1), np.uint8)
        for place, ids, ends, mark in ((np.arange(len(a)) + np.concatenate(([0], nb))[ga], x, na, b"|"), (np.arange(len(b)) + na[gb], y, nb, b";")):
            out[place, :-1] = self.table[ids]
            sign = np.full(len(ids), ord(","), np.uint8)
            sign[ends - 1] = mark[0]
            out[place, -1] = sign
        size = np.bincount(a >> AT, self.n_digits[x] + 1, m) + np.bincount(b >> AT, self.n_digits[y] + 1, m)
        return out[out != 0].tobytes(), np.concatenate(([0], np.cumsum(size))).astype(np.int64)

    def finish(self) -> list[tuple]:
        out, self.open = ([self._close(self.open)] if self.open is not None else []), None
        return out


def _narrow(values: np.ndarray) -> bytes:
    """Counts in the fewest whole bytes that hold the largest."""
    top = int(values.max(initial=0))
    return values.astype(next(k for k, bits in (("<u1", 8), ("<u2", 16), ("<u4", 32), ("<u8", 64)) if top < 1 << bits)).tobytes()


def _flat(column, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's values in a row, and where each row's begin (one more than rows)."""
    raw = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[raw[0] : raw[-1]]
    return np.frombuffer(data.tobytes(), kind), (raw - raw[0]).astype(np.int64) // np.dtype(kind).itemsize


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary"


def aligned(events: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row for each document: counts, digest, and its distinct id pairs (a * size of B + b) with how often each is linked."""

    def run(batches):
        import pyarrow as pa

        a, b = _sides(a_path, b_path)
        sweep = Sweep(a.pieces, b.pieces)
        code = "<u4" if len(a.pieces) * len(b.pieces) <= 1 << 32 else "<u8"
        types = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]
        names = [f.split(" ")[0] for f in ALIGNED.split(", ")]

        def packed(done):
            rows = [(*d[:7], d[7].astype(code).tobytes(), _narrow(d[8])) for d in done]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for part in text_slices(batches, 1 << 19, "ids"):
            ids, offsets = _flat(part.column("ids"), sweep.kind)
            done = sweep.take(part.column("row").to_numpy(), part.column("doc_id").to_pylist(), part.column("start").to_numpy(), part.column("side").to_numpy(), offsets, ids)
            if done:
                yield packed(done)
        if done := sweep.finish():
            yield packed(done)

    dealt = events.repartition(shuffle_tasks(events.sparkSession), "row").sortWithinPartitions("row", "start", "side")
    return dealt.mapInArrow(run, ALIGNED)


def pair_counts(documents: DataFrame, n_a: int, n_b: int, most: int = 1 << 21) -> DataFrame:
    """(pair, n): in how many documents each pair is linked; a task holds at most about 2 * most pairs before it passes them on."""
    code = "<u4" if n_a * n_b <= 1 << 32 else "<u8"

    def run(batches):
        import pyarrow as pa

        def merged(pairs, counts):
            values, where = np.unique(np.concatenate(pairs), return_inverse=True)
            return values, np.bincount(where, np.concatenate(counts)).astype(np.int64)

        pairs, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for part in text_slices(batches, 1 << 22, "codes"):
            values, n = np.unique(_flat(part.column("codes"), code)[0].astype(np.int64), return_counts=True)
            pairs, counts = merged((pairs, values), (counts, n))
            if len(pairs) > most:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])
                pairs, counts = pairs[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])

    return documents.select("codes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


_SCORED = "row long, n_best long, count_sum long"


def scored(documents: DataFrame, counts: DataFrame, n_a: int, n_b: int, size: int = SLICE) -> DataFrame:
    """(row, n_best, count_sum) from the pairs' counts, which reach the documents' pairs in slices of about `size` pairs.

    A slice is copied to as many tasks as the session's shuffle has for it, each of which takes a share of the documents.
    """
    spark = documents.sparkSession
    code = "<u4" if n_a * n_b <= 1 << 32 else "<u8"
    slices = max(1, -(-counts.count() // size))
    shares = max(1, -(-shuffle_tasks(spark) // slices))
    # One row for each id of A: bounded by its vocabulary.
    best = counts.groupBy(F.expr(f"pair div {n_b}").alias("a")).agg(F.max("n").alias("best"))
    marked = counts.withColumn("a", F.expr(f"pair div {n_b}")).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("best")).alias("top"))
    wire = "task int, kind int, row long, codes binary, values binary, tops binary"

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            pair, n, top, which = (b.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "top", "slice"))
            out = [[], [], [], [], [], []]
            for s in np.unique(which):
                m = which == s
                for column, v in zip(out, (int(s), 0, -1, pair[m].astype("<i8").tobytes(), n[m].astype("<i8").tobytes(), top[m].astype(np.uint8).tobytes())):
                    column.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["task", "kind", "row", "codes", "values", "tops"])

    def deal(batches):
        import pyarrow as pa

        for part in text_slices(batches, 1 << 20, "codes"):
            out = [[], [], [], [], [], []]
            for row, raw, times in zip(*(part.column(c).to_pylist() for c in ("row", "codes", "times"))):
                codes = np.frombuffer(raw, code)
                width, of = len(times) // max(1, len(codes)) or 1, codes % slices
                n = np.frombuffer(times, f"<u{width}")
                for s in np.unique(of):
                    m = of == s if slices > 1 else slice(None)
                    for column, v in zip(out, (int(s) * shares + row % shares, 1, row, codes[m].tobytes(), n[m].tobytes(), None)):
                        column.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["task", "kind", "row", "codes", "values", "tops"])

    def score(batches):
        import pyarrow as pa

        held, task, known = [], None, None
        for part in text_slices(batches, 1 << 20, "codes"):
            rows, found = part.column("row").to_pylist(), [[], [], []]
            for i, (t, kind) in enumerate(zip(part.column("task").to_pylist(), part.column("kind").to_pylist())):
                if t != task:
                    held, task, known = [], t, None
                raw, values = part.column("codes")[i].as_py(), part.column("values")[i].as_py()
                if kind == 0:
                    held.append((np.frombuffer(raw, "<i8"), np.frombuffer(values, "<i8"), np.frombuffer(part.column("tops")[i].as_py(), np.uint8)))
                    continue
                if known is None:
                    known = [np.concatenate(c) for c in zip(*held)]
                    known = [c[np.argsort(known[0])] for c in known]
                    held = []
                codes = np.frombuffer(raw, code)
                times = np.frombuffer(values, f"<u{len(values) // len(codes)}").astype(np.int64)
                at = np.searchsorted(known[0], codes)
                for column, v in zip(found, (rows[i], int((times * known[2][at]).sum()), int((times * known[1][at]).sum()))):
                    column.append(v)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["row", "n_best", "count_sum"])

    dealt = documents.select("row", "codes", "times").mapInArrow(deal, wire)
    tables = marked.withColumn("slice", F.expr(f"pair % {slices}")).mapInArrow(pack, wire)
    tables = tables.withColumn("task", F.explode(F.expr(f"sequence(task * {shares}, task * {shares} + {shares - 1})")))
    both = dealt.unionByName(tables).repartitionById(slices * shares, "task").sortWithinPartitions("task", "kind")
    return both.mapInArrow(score, _SCORED).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, a_path: str | None = None, b_path: str | None = None, size: int = SLICE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document; see the module for defined results."""
    a_path, b_path = a_path or default_vocabulary(), b_path or default_pieces()
    n_a, n_b = (len(s.pieces) for s in _sides(a_path, b_path))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    documents = keep(aligned(end_events(rows, a_path, b_path), a_path, b_path), "aligned")
    counts = keep(pair_counts(documents, n_a, n_b), "pairs")
    found = keep(scored(documents, counts, n_a, n_b, size), "scores")
    forget(counts)
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return documents.drop("codes", "times").join(found, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
