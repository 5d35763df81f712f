"""The training-data operators against brute force, exact round trips and planted cases."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T
from utxolens.llm import chars, language, mixing, packing, pii, quality, simhash, tokens, tokenstore, toxicity, vectors
from utxolens.llm.common import connected_components, new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, `size` string"


def documents(spark, rows):
    """Rows (doc_id, text, lang, source) with columns whose names clash with those the operators make."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y") for r in rows], DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, very long, tied and repeated rows."""
    long = prose(1, 30_000)
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "b"), (4, long, "en", "a"), (5, long + " tail", "fr", "a"), (6, "one two", "de", "b"), (6, "one two", "de", "b"), (7, "one two", "de", "b"), (None, "one two", "de", "b"), (8, "x" * 5000, "es", "c")]
    return documents(spark, rows + [(100 + i, prose(i, 40), "en", "abc"[i % 3]) for i in range(30)])


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7), (None, 3)]
    label = {}
    find = lambda x: x if label.setdefault(x, x) == x else find(label[x])
    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            label[b] = a
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in label}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 ------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum((sum(v >> b & 1 for v in h) * 2 > len(h)) << b for b in range(64))


def test_fingerprint_is_the_majority_of_shingle_hashes(spark):
    from pyspark.sql import functions as F

    for text in ("", "A b", "É C d E f", prose(3, 300), "a b c d e"):
        assert int.from_bytes(simhash.fingerprint(text.encode()), "big") == plain_fingerprint(text)
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] & (2**64 - 1) == __import__("xxhash").xxh64_intdigest("a b c d", 42)


def test_simhash_groups(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count() and simhash.near_duplicates(none).count() == 0
    by = {(r.doc_id): r for r in got}
    assert by[1].fingerprint == "0" * 16 and by[1].component_id == by[2].component_id == by[3].component_id == 1
    assert by[4].component_id == by[5].component_id == 4
    assert {r.component_id for r in got if r.doc_id in (6, 7, None)} == {6}


def test_simhash_links_agree_with_all_pairs(spark):
    """Chains of near fingerprints and a group far larger than a block, at blocks small enough to be split."""
    r = np.random.default_rng(5)
    fp = r.integers(0, 2**63, 300, dtype=np.uint64)
    near = np.array([fp[i % 20] ^ np.uint64(sum(1 << int(b) for b in r.choice(64, i % 6, replace=False))) for i in range(300)])
    both = np.unique(np.concatenate((fp, near)))
    signed = both.view(np.int64)
    for distance in (4, 8):
        edges = simhash.links(spark.createDataFrame([(0, int(x)) for x in signed], "id long, fp long"), distance, block=16)
        got = {x.node.fp: x.root.fp for x in connected_components(edges).collect()}
        linked = np.bitwise_count(both[:, None] ^ both[None, :]) <= distance
        want = signed.copy()
        while True:
            new = np.where(linked, want[None, :], 2**63 - 1).min(1)
            new = np.minimum(new, want)
            if (new == want).all():
                break
            want = new
        assert all(got.get(int(s), int(s)) == int(w) for s, w in zip(signed, want))


def test_every_pair_of_texts_within_the_radius_is_compared(spark):
    """Groups larger than a block, whose texts are similar in chains only."""
    r, rows = random.Random(12), []
    for g in range(3):
        w = words(g, "abcdefgh", 120).split()
        for i in range(40):
            v = list(w)
            for _ in range(r.randrange(4)):
                v[r.randrange(len(v))] = f"w{g}x{r.randrange(30)}"
            rows.append((len(rows), " ".join(v)))
    rows += [(1000, ""), (1001, None), (1002, " "), (1003, rows[0][1]), (1004, "x y"), (1005, "y x")]
    sets = [set(simhash.shingle_set((t or "").encode()).tolist()) for _, t in rows]
    near = [int.from_bytes(simhash.fingerprint((t or "").encode(), 1, True), "big") for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both, every = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if (near[a] ^ near[b]).bit_count() <= 8 and both >= 0.8 * every and root[a] != root[b]:
                root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    df = spark.createDataFrame(rows, "row long, text string")
    for block in (7, 512):
        got = {x.node: x.root for x in simhash.similar_texts(df, "row", block=block).collect()}
        assert {n: rows[root[i]][0] for i, (n, _) in enumerate(rows) if n in got} == got and len(got) == len({t or "" for _, t in rows})
    assert simhash.similar_texts(spark.createDataFrame([], "row long, text string"), "row").count() == 0


# 2, 4 ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_gives_the_tokenizers_ids(whole):
    r = random.Random(4)
    e = tokens.Encoder(tokens.default_vocabulary())
    texts = ["".join(r.choice(["a", "b", " ", "  ", "\n", "é", "'s", "'", "1", ".", "ß", " ", "中", "<|endoftext|>", "\0", "​"]) for _ in range(r.randint(0, 30))) for _ in range(2000)]
    for a in range(0, len(texts), 50):
        for t, ids in zip(texts[a : a + 50], e.batch(texts[a : a + 50])):
            assert np.frombuffer(ids, "<u4").tolist() == whole(t), t


def test_packing(spark, odd, none, whole):
    assert packing.pack_documents(none).count() == 0
    rows = packing.pack_documents(odd, with_ids=True).collect()
    docs = {}
    for r in odd.collect():
        docs.setdefault(r.doc_id, whole(r.text) + [1])
    pieces, sequences = {}, {}
    for p in rows:
        ids = docs[p.doc_id][p.start : p.start + p.length]
        assert p.ids == ids and p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and p.doc_tokens == len(docs[p.doc_id])
        pieces.setdefault(p.doc_id, []).append((p.start, p.length))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for doc, cuts in pieces.items():
        held = np.zeros(len(docs[doc]), int)
        for start, n in cuts:
            held[start : start + n] += 1
        assert (held == (2 if doc == 6 else 1)).all(), doc
    waste = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
        waste += 0 if at & (at - 1) == 0 else 2048 - at
    assert waste <= 0.03 * sum(map(len, docs.values()))


def test_harmonic_bins():
    """Every id once, bins of one class until a gap is filled, few documents cut, little padding."""
    cut = lambda p, n: ((p[0], p[1], n, p[3], None), (p[0], p[1] + n, p[2] - n, p[3], None))
    r = random.Random(1)
    lengths = [r.choice((r.randint(1, 300), r.randint(300, 2500), 9000)) for _ in range(3000)]
    bins = packing.Harmonic(2048, 7, cut)
    placed = [x for i, n in enumerate(lengths) for x in bins.add((i, 0, n, n, None))] + list(bins.finish())
    held, room, pieces = {i: np.zeros(n, int) for i, n in enumerate(lengths)}, {}, [0] * len(lengths)
    for seq, at, (doc, start, n, _, _) in placed:
        held[doc][start : start + n] += 1
        assert room.get(seq, 0) == at and at + n <= 2048
        room[seq] = at + n
        pieces[doc] += 1
    assert all((h == 1).all() for h in held.values()) and min(room) == 7
    assert sum(2048 - v for v in room.values() if v & (v - 1)) <= 0.02 * sum(lengths)
    short = [i for i, n in enumerate(lengths) if n <= 2048]
    assert sum(pieces[i] > 1 for i in short) <= 0.35 * len(short)
    equal = packing.Harmonic(100, 0, cut)
    assert {s for i in range(9) for s, _, _ in equal.add((i, 0, 33, 33, None))} == {0, 1}, "three to a bin, one held as filler"
    assert list(packing.Harmonic(100, 5, cut).finish()) == []


def test_token_shards(spark, odd, none, whole):
    where = new_path(spark, "test-ids")
    assert tokenstore.read_shards(tokenstore.write_shards(none, new_path(spark, "test-none")), where).count() == 0
    shards = tokenstore.write_shards(odd, where)
    got = tokenstore.read_shards(shards, where).collect()
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = sorted((r for r in odd.collect()), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    for r, g in zip(order, sorted(got, key=lambda r: r.start)):
        ids = np.array(whole(r.text) + [2], "<u4")
        assert (g.doc_id, g.n_tokens, g.ids_crc32) == (r.doc_id, len(ids), zlib.crc32(ids.tobytes()))
    opened = [tokenstore.Shard(where, s.shard) for s in shards.collect()]
    for key in (4, 6, 101):
        assert [s.get(key).tolist() for s in opened if s.get(key) is not None] == [whole(next(r.text for r in order if r.doc_id == key)) + [2]]
    assert all(s.get(987654321) is None for s in opened)


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64))
    h = tokenstore.MinimalPerfectHash.build(keys)
    assert np.array_equal(np.sort(h.slots(keys)), np.arange(len(keys)))
    assert len(tokenstore.MinimalPerfectHash.build(keys[:0]).slots(keys[:0])) == 0


# 3, 8 ---------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, node string, rank string"


def some_vectors(spark, n=300, dim=16, seed=6):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)).astype(np.float32)
    x[n // 2 :] = x[: n - n // 2] + r.normal(scale=0.12, size=(n - n // 2, dim))
    x[10] = x[11] = x[12]
    rows = [(i, v.tolist(), int(i % (n // 2)) % 3, "n", "r") for i, v in enumerate(x)]
    rows += [(900, None, 1, "", ""), (901, [0.0] * dim, 1, "", ""), (902, [float("nan")] * dim, 1, "", ""), (903, [None] * dim, 1, "", ""), (904, x[3].tolist(), None, "", ""), (None, x[3].tolist(), 0, "", ""), (905, [], 1, "", "")]
    return spark.createDataFrame(rows, VECTORS), x.astype(float), np.array([r_[2] for r_ in rows[:n]])


def test_near_vectors(spark):
    df, x, label = some_vectors(spark)
    got = {r.vec_id: r for r in vectors.near_vectors(df, block=16).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], len(x)).min(1))
        if (new == root).all():
            break
        root = new
    assert linked.sum() > 100
    for i in range(len(x)):
        r = got[i]
        assert (r.n_links, r.component_id, r.kept) == (linked[i].sum(), root[i], root[i] == i), i
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 904, 905)) and got[None].n_links == 0
    assert vectors.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_nearest(spark):
    df, x, _ = some_vectors(spark, n=1500)
    got = {}
    for r in vectors.nearest(df, df.where("vec_id % 20 = 0"), k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids, hits = np.append(np.arange(len(x)), [904]), 0
    x = np.vstack((x, x[3]))
    for q in range(0, 1500, 20):
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((ids, -score))[:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(m[2] - score[np.flatnonzero(ids == m[1])[0]]) < 1e-9 for m in mine)
        hits += len({m[1] for m in mine} & set(ids[best].tolist()))
    assert hits >= 0.9 * 750
    few, _, _ = some_vectors(spark, n=14)
    assert vectors.nearest(few, few.where("vec_id = 0")).count() == 14
    none = spark.createDataFrame([], VECTORS)
    assert vectors.nearest(none, none).count() == 0


def test_multi_index_finds_every_code_in_the_radius():
    r = np.random.default_rng(8)
    x = r.normal(size=(800, 12))
    model = vectors.fit_codes(x)
    index = vectors.MultiIndex(np.arange(800), x, model)
    code = vectors.codes(x, model)
    for radius in (0, 3, 9, 17, 30, 64):
        d = vectors.distances(code[:5], code)
        for q in range(5):
            assert index.within(code[q], radius).tolist() == np.flatnonzero(d[q] <= radius).tolist()


# 5, 7, 9 ------------------------------------------------------------------------------------------


def words(seed, letters, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


def test_language(spark, odd, none):
    letters = {"aa": "abcde ", "bb": "defghé", "cc": "xyzw"}
    rows = [(i, words(i, letters[k], 5 + i % 60), k, "s") for i, k in enumerate(list(letters) * 60)] + [(1000, None, "aa", "s"), (1001, "12 !?", "aa", "s"), (1002, "abc", None, "s")]
    got = {r.doc_id: r for r in language.identify(documents(spark, rows)).collect()}
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert np.mean([got[i].lang_pred == k for i, _, k, _ in rows[:180] if got[i].held_out]) >= 0.97
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(odd).count() == odd.count() and language.identify(none).count() == 0


def test_kernel_counts_shared_distinct_grams():
    a, b = language.presence(["abc abc", "ABC"])
    assert len(np.intersect1d(a, b)) == len(language.presence(["abc"])[0]) and len(language.presence(["12", None])[0]) == 0


LABELS = "doc_id long, quality int, toxic int, text string"


def labelled(spark, rows):
    return spark.createDataFrame([(i, q, t, "clash") for i, q, t in rows], LABELS)


def test_quality(spark, odd, none):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = words(i, "abcdefgh", 30 + i % 50)
        text = (text.upper().replace(" ", "!! ") if i % 8 == 0 else " ".join(w for w in text.split()[:6] for _ in range(12))) if bad else text
        rows.append((i, text, "en", "s"))
        labels.append((i, int(not bad), 0))
    docs, known = documents(spark, rows), labelled(spark, labels)
    got = quality.score_table(docs, quality.train(docs, known), "doc_id", "text", 5, 0, 0.3).collect()
    assert np.mean([r.predicted == (r.doc_id % 4 > 0) for r in got if r.held_out]) >= 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    score = quality.train(odd, known)
    assert quality.score_table(odd, score, "doc_id", "text", 5, 0, 0.3).count() == odd.count()
    assert quality.score_table(none, quality.train(none, labelled(spark, [])), "doc_id", "text", 5, 0, 0.3).count() == 0


def test_toxicity(spark, odd, none):
    rows, labels, bad = [], [], ["grobnix", "schlimmo", "vilezzo"]
    for i in range(500):
        w = words(i, "abcdefghilmnor", 80).split()
        if i % 3 == 0:
            for k in range(3):
                w[(i * 7 + k * 23) % 80] = bad[(i + k) % 3]
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(i % 3 == 0)))
    rows += [(900, words(900, "abcdefghilmnor", 40) + " grobnixx schlimmmo " + words(901, "abcdefghilmnor", 40), "en", "s")]
    docs = documents(spark, rows)
    score = toxicity.train(docs, labelled(spark, labels))
    got = {r.doc_id: r for r in toxicity.score_table(docs, score, "doc_id", "text", 5, 0, 0.5).collect()}
    assert np.mean([got[i].predicted == int(i % 3 == 0) for i in range(500) if got[i].held_out]) >= 0.95
    assert got[900].predicted == 1, "a misspelling shares n-grams with what it misspells"
    assert toxicity.score_table(odd, score, "doc_id", "text", 5, 0, 0.5).count() == odd.count()
    assert toxicity.score_table(none, toxicity.train(none, labelled(spark, [])), "doc_id", "text", 5, 0, 0.5).count() == 0


# 6 ------------------------------------------------------------------------------------------------

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (True, k != 1 or all(int(x) <= 255 for x in m[0].split(".")), k != 2 or (14 <= len(d) <= 19 and pii.luhn(d)), k != 3 or 10 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data_base_spans():
    r = random.Random(9)
    for _ in range(20_000):
        t = "".join(r.choice("0123 .-+@a(b%\n25é") for _ in range(r.randint(0, 40)))
        assert [s for s in pii.find_spans(t) if s[1] < 4] == plain_spans(t), t
    card = "4111 1111 1111 1111"
    assert [s[1] for s in pii.find_spans(f"{card} +49 (30) 1234-5678 a@b.co 10.0.0.255 10.0.0.256")] == [2, 3, 0, 1]


def test_personal_data_query(spark, odd, none):
    df = documents(spark, [(1, "é a@b.co, http://x.org/a. account no: 1234567", "en", "s"), (2, None, "en", "s"), (3, "9" * 100_000, "en", "s")])
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    assert got[1].n_email == 1 and got[1].spans == "email:2:8,url:10:24,account:38:45"
    assert got[2].spans == "" and got[2].base_sha256 == __import__("hashlib").sha256(b"").hexdigest() and got[3].spans == ""
    assert pii.redact("x a@b.co y") == "x <EMAIL> y" and pii.redact(None) is None
    assert pii.find_personal_data(odd).count() == odd.count() and pii.find_personal_data(none).count() == 0


# 10 -----------------------------------------------------------------------------------------------


def test_mixing(spark, odd, none):
    import duckdb

    con = duckdb.connect()
    rows = [(i, prose(i, 5 + i % 90), "en", ("a", "b", "c", None)[i % 7 % 4]) for i in range(800)] + [(900, None, "en", "d"), (901, "", "en", "a")]
    df = documents(spark, rows)
    got = sorted(tuple(r) for r in mixing.mix_sources(df).collect())
    documents_table = df.select("doc_id", "text", "source").toArrow()
    con.register("documents", documents_table)
    want = sorted(con.execute(mixing.SQL).fetchall())
    assert [(*g[:3], round(g[3], 6), g[4]) for g in got] == [(*w[:3], round(w[3], 6), w[4]) for w in want]
    taken, source = {}, {r[0]: r[3] for r in rows}
    for doc, size, source_size, target, t in got:
        assert t <= 2 * size
        taken.setdefault(source[doc], [0, target])[0] += t
    assert all(abs(t - target) <= 1 for t, target in taken.values())
    assert mixing.mix_sources(none).count() == 0 and mixing.mix_sources(odd).count() == odd.count()


PLAIN = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with copies, near copies, junk and nulls, and their labels, as files."""
    rows = [(i, prose(i, 60 + i % 40), "en", "ab"[i % 2], 0) for i in range(200)]
    rows += [(500 + i, rows[i][1] + " mail me@x.org", "en", "a", 0) for i in range(20)] + [(3, rows[3][1], "en", "b", 0)]
    rows += [(700 + i, prose(700 + i, 50).upper().replace(" ", "!! "), "en", "a", 0) for i in range(60)] + [(900, None, None, None, None)]
    where = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(r[0], 1 if r[0] < 600 else 0, 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(rows, PLAIN).write.parquet(f"{where}/documents.parquet")
    return where, rows


def similar_groups(rows):
    """The rows that stay, by comparing all pairs of five-word shingle sets: the first by (null id, id) of each group."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    sets = [frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if (w := (rows[i][1] or "").lower().split()) else frozenset() for i in order]
    root = list(range(len(order)))
    for a in range(len(order)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    return sorted((rows[order[i]][:2] for i in set(root)), key=str)


def test_pipeline_stages(spark, corpus):
    import corpus_pipeline

    where, rows = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, where).cache()
    assert {r.doc_id for r in good.where("doc_id < 600").collect()} == {r[0] for r in rows if r[0] < 600} and good.where("doc_id between 700 and 800").count() <= 2
    one = stages["near_duplicates"](spark, good, where).cache()
    assert sorted(((r.doc_id, r.text) for r in one.collect()), key=str) == similar_groups([tuple(r) for r in good.collect()])
    clean = stages["personal_data"](spark, docs, where)
    assert clean.where("text like '%@%'").count() == 0 and clean.count() == docs.count()
    mixed = stages["mixing"](spark, one, where)
    size = {}
    for r in one.collect():
        size[r.source] = size.get(r.source, 0) + len((r.text or "").split())
    taken = {}
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    target = {r.source_size: r.target for r in mixing.mix_sources(one).collect()}
    assert mixed.columns == docs.columns and all(abs(taken[s] - target[n]) <= 1 for s, n in size.items() if n)
    assert corpus_pipeline.run(spark, where).count() > 0


def test_stages_keep_clashing_columns_and_odd_rows(spark, corpus):
    """Extra columns named as the stages name theirs, null ids, repeated rows, an empty table and a very long text."""
    import corpus_pipeline

    names = ("taken", "size", "copy", "words", "rn", "row", "_row", "_size", "_taken", "_text", "key", "t", "score")
    schema = PLAIN + "".join(f", `{n}` string" for n in names)
    long = prose(5, 30_000)
    rows = [(1, prose(1, 50)), (None, prose(2, 50)), (None, prose(3, 50)), (4, long), (4, prose(4, 50)), (4, prose(4, 50)), (6, None), (7, "")]
    extra = tuple(f"mine {n}" for n in names)
    for given in (rows, []):
        docs = spark.createDataFrame([(*r, "en", "s", len(r[1] or ""), *extra) for r in given], schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, corpus[0])
            found = got.collect()
            assert got.columns == docs.columns and all(tuple(r)[5:] == extra for r in found) and bool(found) == bool(given), name
            if name == "near_duplicates":
                assert sorted(((r.doc_id, r.text) for r in found), key=str) == similar_groups(given)
        assert len({r.text for r in found if r.doc_id is None}) == (2 if given else 0)
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, corpus[0]).count() > 0) == bool(given)
