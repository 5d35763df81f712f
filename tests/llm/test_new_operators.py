"""WARC chunks, cross-tokenizer alignment and periodic runs against brute force, and their odd inputs."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from utxolens.llm import alignment, runs, warc
from utxolens.llm.tokens import _byte_letters, default_vocabulary


def table(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


# WARC


def equal_payloads(rows):
    """(page_id, bytes, digest, type, refers_to) by definition."""
    found = defaultdict(list)
    for key, text in rows:
        found[(text or "").encode()].append(key)
    out = []
    for payload, keys in found.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        keys.sort(key=lambda k: -1 if k is None else k)
        top = keys.pop()
        out += [(top, len(payload), digest, "response", None), *((k, len(payload), digest, "revisit", top) for k in keys)]
    return Counter(out)


PAGES = "page_id long, url string, html string, file int, at int, chunk string, payload binary"


@pytest.mark.parametrize(("size", "compression"), [(64, "none"), (1 << 20, "gzip")])
def test_archives_give_back_every_page(spark, tmp_path, size, compression):
    rnd = random.Random(size)
    texts = [None, "", "\r\n", "a\r\n\r\n", "\r\n\r\nWARC/1.1\r\nArchive-ID: ", "é🙂日" * 400, "x\r\n\r\n" * 900, "y" * 5000, "same"]
    rows = [(rnd.choice([None, *range(150)]), rnd.choice([None, "http://a b\r\nPage-ID: 7", "http://x/"]), rnd.choice(texts + ["same"] * 4), 1, 2, "c", None) for _ in range(200)]
    path = str(tmp_path / "archive")
    archive = warc.write_archive(table(spark, tmp_path, rows, PAGES), path, size=size, compression=compression)
    got = Counter(tuple(r) for r in warc.read_archive(spark, path, archive).collect())
    assert got == equal_payloads([(r[0], r[2]) for r in rows])


def test_archives_hold_valid_segments(spark, tmp_path):
    text = "0123456789é" * 50
    path = str(tmp_path / "archive")
    archive = warc.write_archive(table(spark, tmp_path, [(5, "u", text, 0, 0, "", None)], PAGES), path, size=100, compression="none")
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "archive").glob("part-*")))
    payload, number, total = b"", 0, None
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        n = int(fields[b"Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n" and int(fields[b"WARC-Segment-Number"]) == number + 1
        number, payload, raw = number + 1, payload + rest[:n], rest[n + 4 :]
        total = fields.get(b"WARC-Segment-Total-Length", total)
    assert payload == (warc.HTTP + text).encode() and int(total) == len(payload) and number > 5
    assert warc.read_archive(spark, path, archive).count() == 1


def test_small_payloads_are_all_responses(spark, tmp_path):
    rows = [(i, "u", t, 0, 0, "", None) for i, t in enumerate(["abc", "abc", "abcdefgh", "abcdefgh"])]
    archive = warc.write_archive(table(spark, tmp_path, rows, PAGES), str(tmp_path / "a"), least=5)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archive(spark, str(tmp_path / "a"), archive).collect()}
    assert got == {0: ("response", None), 1: ("response", None), 2: ("revisit", 3), 3: ("response", None)}


def test_damaged_archives_are_errors(spark, tmp_path):
    rows = [(1, "u", "z" * 500, 0, 0, "", None)]
    pages = table(spark, tmp_path, rows, PAGES)
    archive = warc.write_archive(pages, str(tmp_path / "a"), size=100, compression="none")
    lines = spark.read.option("lineSep", warc.separator(archive)).text(str(tmp_path / "a"))
    start = warc.separator(archive).removeprefix("\r\n\r\n")
    lines = lines.select(F.concat(F.lit(start), F.regexp_replace("value", "^WARC/1[.]1\r\nArchive-ID: .*\r\n|\r\n\r\n$", "")).alias("value"))
    lines.where("value not like '%WARC-Segment-Number: 3\r%'").coalesce(1).write.option("lineSep", "\r\n\r\n").text(str(tmp_path / "b"))
    with pytest.raises(Exception, match="does not follow"):
        warc.read_archive(spark, str(tmp_path / "b"), archive).collect()
    lines.select(F.regexp_replace("value", "zz", "zy")).coalesce(1).write.option("lineSep", "\r\n\r\n").text(str(tmp_path / "c"))
    with pytest.raises(Exception, match="digest says"):
        warc.read_archive(spark, str(tmp_path / "c"), archive).collect()


def test_an_empty_table_is_an_empty_archive(spark, tmp_path):
    archive = warc.write_archive(spark.createDataFrame([], PAGES), str(tmp_path / "a"))
    assert warc.read_archive(spark, str(tmp_path / "a"), archive).count() == 0


def test_pieces_never_cut_a_character():
    for text in ("", "a", "é" * 7, "🙂" * 9, "ab🙂" * 5):
        for size in (4, 5, 7):
            cuts = warc.pieces(text.encode(), size)
            assert "".join(text.encode()[a:z].decode() for a, z in cuts) == text and all(z - a <= size for a, z in cuts)


# Alignment


def brute_alignment(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text by definition, whole texts by the untouched libraries."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(default_vocabulary()), SentencePieceProcessor(model_file=alignment.default_pieces())
    a.encode_special_tokens = True
    back = {c: n for n, c in _byte_letters().items()}
    found = []
    for text in texts:
        x, y = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        p = [bytes(back[c] for c in a.id_to_token(i)) for i in x]
        q = [bytes([b.id_to_piece(i) and int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not text or b"".join(p) != b" " + text.encode() or b"".join(q) != b" " + text.encode():
            found.append(None)
            continue
        ends = [np.cumsum([len(t) for t in side]).tolist() for side in (p, q)]
        groups, links, i, j = [], [], 0, 0
        group = ([], [])
        while i < len(x):
            links.append((x[i], y[j]))
            end_a, end_b = ends[0][i], ends[1][j]
            if end_a <= end_b:
                group[0].append(x[i])
                i += 1
            if end_b <= end_a:
                group[1].append(y[j])
                j += 1
            if end_a == end_b:
                groups.append(group)
                group = ([], [])
        found.append((len(x), len(y), groups, links))
    count = Counter(pair for f in found if f for pair in set(f[3]))
    best = defaultdict(int)
    for (one, _), n in count.items():
        best[one] = max(best[one], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in f[2])
        out.append((f[0], f[1], len(f[2]), len(f[3]), sum(count[k] == best[k[0]] for k in f[3]), sum(count[k] for k in f[3]), hashlib.sha256(text.encode()).hexdigest()))
    return out


DOCS = "doc_id long, text string, row int, start string, ids int"
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def odd_texts(rnd, n):
    words = ["the", "dog", "  ", "   ", "\n\n", "\t", "é", "日本語", "🙂", "don't", "<|endoftext|>", "</s>", "▁", " ", "unbelievable", "123456", "--", "ﬁ", "\x01", "\r\n", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    return [rnd.choice(["", " "]).join(rnd.choice(words) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("run", [4, 1 << 15])
def test_alignment_is_that_of_whole_texts(spark, tmp_path, monkeypatch, run):
    monkeypatch.setattr(alignment, "RUN", run)
    rnd = random.Random(run)
    texts = [None, "", " ", "x", *odd_texts(rnd, 120), "The same text twice.", "The same text twice.", "word soup, " * 4000]
    rows = [(rnd.choice([None, i % 50]), t, 1, "s", 2) for i, t in enumerate(texts)]
    got = alignment.align(table(spark, tmp_path, rows, DOCS), size=40)
    expected = Counter((r[0], *e) for r, e in zip(rows, brute_alignment(texts)))
    assert Counter(tuple(r) for r in got.select("doc_id", *COLUMNS).collect()) == expected


def test_alignment_of_the_driver_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(docs).select("doc_id", *COLUMNS).collect()}
    assert got == {r.doc_id: e for r, e in zip(rows, brute_alignment([r.text for r in rows]))}


def test_alignment_of_nothing(spark):
    assert alignment.align(spark.createDataFrame([], DOCS)).count() == 0


def test_the_sweep_reads_any_slices():
    """A document's result does not depend on how its rows are cut into slices."""
    a, b = alignment._sides(default_vocabulary(), alignment.default_pieces())
    text = "Words and more words, don't stop; 日本語 🙂 " * 30
    sizes = [np.array([len(p) for p in s.pieces]) for s in (a, b)]
    rows = []
    for doc in range(3):
        for side, s in enumerate((a, b)):
            ids = s.batch([text[doc:]])[0]
            for k in range(0, len(ids), 7):
                rows.append((doc, int(sizes[side][ids[:k]].sum()), side, ids[k : k + 7]))
    rows.sort(key=lambda r: r[:3])
    results = []
    for step in (1, 2, 13, len(rows)):
        sweep, done = alignment.Sweep(a.pieces, b.pieces), []
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            offsets = np.concatenate(([0], np.cumsum([len(r[3]) for r in part])))
            done += sweep.take(np.array([r[0] for r in part]), [r[0] for r in part], np.array([r[1] for r in part]), np.array([r[2] for r in part]), offsets, np.concatenate([r[3] for r in part]))
        results.append([(*d[:7], d[7].tolist(), d[8].tolist()) for d in done + sweep.finish()])
    assert results[0] == results[1] == results[2] == results[3] and len(results[0]) == 3


# Periodic runs


def brute_runs(w):
    n, out = len(w), set()
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            a = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            e = i + p
            if i > a and e - a >= max(6, 4 * p) and not any(all(w[k] == w[k + q] for k in range(a, e - q)) for q in range(1, p)):
                out.add((a, e - a, p))
            i += i == a
    return sorted(out)


def test_runs_are_all_maximal_repetitions():
    rnd = random.Random(9)
    for _ in range(3000):
        n = rnd.randint(0, 100)
        w = [rnd.randrange(rnd.randint(1, 4)) for _ in range(n)]
        for _ in range(rnd.randint(0, 3)):
            if n > 8:
                p, a = rnd.randint(1, n // 5 + 1), rnd.randrange(n - 1)
                for i in range(a + p, min(n, a + rnd.randint(1, 6) * p)):
                    w[i] = w[i - p]
        assert runs.find_runs(np.array(w, np.int64)) == brute_runs(w)


def test_long_runs_end_soon():
    for w, expected in ((np.zeros(300_000, np.int64), [(0, 300_000, 1)]), (np.tile(np.arange(700), 500), [(0, 350_000, 700)])):
        assert runs.find_runs(w) == expected


def plain_row(key, text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(key).encode()) if key is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[:1]
    one = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join("%d,%d,%d\n" % r for r in found), " ".join(w for i, w in enumerate(words) if i not in gone))]
    return key, len(found), *one, *sha


def test_periodic_runs_by_definition(spark):
    rnd = random.Random(4)
    texts = [None, "", " \n", "a a a a a", "a a a a a a", "x y " * 9, " a " * 8, *(" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60))) for _ in range(60)), "no run here", "q w e r " * 40 + "t"]
    rows = [(rnd.choice([None, *range(80)]), t, "x", 1) for t in texts]
    got = runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, start string, period int"), fold=True)
    assert Counter(map(tuple, got.collect())) == Counter(plain_row(k, t) for k, t, *_ in rows)
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_periodic_runs_of_the_driver_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    short = docs.where("n_chars < 6000")
    assert sorted(map(tuple, runs.periodic_runs(short, fold=True).collect())) == sorted(plain_row(r.doc_id, r.text) for r in short.collect())


def test_collapsed_texts(spark):
    df = spark.createDataFrame([(1, "go go go go go go  on"), (2, "as  it is"), (3, None)], "n int, text string")
    assert [r.text for r in runs.collapsed_texts(df).orderBy("n").collect()] == ["go on", "as  it is", None]


# What earlier operators do with odd sizes


def test_blanks_behind_a_cue_are_read_once():
    import time

    from utxolens.llm.pii import find_spans

    for text in ("account" + " " * 100_000, "iban \t" * 20_000 + "x", "token " + " no" * 50_000, "account" + " \t" * 50_000 + "no. : 'DE12345678'"):
        began = time.perf_counter()
        found = find_spans(text)
        assert time.perf_counter() - began < 0.5, text[:20]
    assert [text[a:b] for a, k, b in found if k == 5] == ["DE12345678"]


def test_overlaps_are_those_of_sets():
    from utxolens.llm.simhash import overlaps

    rnd = random.Random(8)
    sets = [np.unique(np.array([rnd.randrange(60) for _ in range(rnd.choice([0, 3, 30, 200]))], np.uint64)) for _ in range(40)]
    i, j = (np.array([rnd.randrange(40) for _ in range(500)]) for _ in range(2))
    for most in (1, 50, 1 << 22):
        assert overlaps(sets, i, j, most).tolist() == [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(i, j)]


def test_long_texts_are_dealt_out_by_bytes(spark, monkeypatch):
    from utxolens.llm import simhash

    monkeypatch.setattr(simhash, "TILE_BYTES", 3000)
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(900)}" for _ in range(400)]
    rows = [(i, " ".join(base[:k] + [f"new{i}"] + base[k + 1 :])) for i in range(24) for k in [rnd.randrange(400)]] + [(100 + i, " ".join(f"z{rnd.randrange(900)}" for _ in range(400))) for i in range(6)]
    got = {r.node: r.root for r in simhash.similar_texts(spark.createDataFrame(rows, "id long, text string"), "id").collect()}
    assert {got[i] for i in range(24)} == {0} and all(got[100 + i] == 100 + i for i in range(6))


def test_the_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_shard_compares_keys_behind_fingerprints(spark, tmp_path, monkeypatch):
    from utxolens.llm import tokenstore

    docs = spark.createDataFrame([(i * 3, f"text {i}") for i in range(50)], "doc_id long, text string").coalesce(1)
    shards = tokenstore.write_shards(docs, str(tmp_path)).collect()
    found = 0
    for s in shards:
        shard = tokenstore.Shard(str(tmp_path), s.shard)
        assert all(shard.get(int(k)) is not None for k in shard.keys)
        # Every fingerprint agrees, as in a collision: the key decides.
        monkeypatch.setattr(tokenstore, "fingerprints", lambda keys: np.zeros(len(keys), np.uint32))
        shard.prints = np.zeros_like(shard.prints)
        assert (shard.find(np.arange(1, 150, 3)) == -1).all()
        found += int((shard.find(np.arange(0, 150, 3)) >= 0).sum())
        monkeypatch.undo()
    assert found == 50
