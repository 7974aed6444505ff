"""Operators 11 to 13 against plain versions, and each registered query on a small folder."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldlink.llm import attention, common, queries, spelling, tiff, toxicity, whitening

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# op11


def plain_variants(rows, modulus=97, least=5, times=3):
    counts = collections.Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            word = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % modulus == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least and c >= times}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(a == b[:k] + b[k + 1 :] for k in range(len(b)))

    out = {}
    for w in n:
        own = [x for x in n if near(w, x)]
        best = min(own, key=lambda x: (-n[x], x)) if own else None
        out[w] = [best if best and n[best] >= 2 * n[w] else None, w, n[w], len(own)]
    for w in n:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return {w: (f, root, c, k, n.get(f)) for w, (f, root, c, k) in out.items()}


@pytest.mark.parametrize("cell,leaf", [(32_768, 128), (40, 8), (3, 1)])
def test_variants_against_all_pairs(spark, monkeypatch, cell, leaf):
    draw = random.Random(6)
    letters = "abcdeéüß"
    base = ["".join(draw.choices(letters, k=draw.randrange(5, 9))) for _ in range(60)]
    vocabulary = base + [w[:k] + draw.choice(letters) + w[k + draw.randrange(2) :] for w in base for k in draw.sample(range(len(w)), 3)]
    rows = [(draw.choice([None, i, i % 7]), " ".join(draw.choice([str, str.upper, str.title])(w) for w in draw.choices(vocabulary, weights=[9] * 60 + [1] * 180, k=40)) + "×÷5" * (i % 3)) for i in range(150)]
    rows += [(1, None), (2, ""), (3, "12 $"), (None, "Straße straße STRASSE "), (5, "x" * 100 + " " + "x" * 100 + " " + "x" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    table = spelling.words(df)
    found = {r.word: (r.form, r.form_n, r.n_near) for r in spelling.neighbours(table, cell=cell, leaf=leaf).collect()}
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df, cell=cell).collect()}
    want = plain_variants(rows)
    assert got == want and {w for w in want if want[w][3]} == set(found) and all(found[w][2] == want[w][3] for w in found)


def test_words_of_the_same_letters_are_dealt_out(spark):
    """More than a cell of words with equal letter counts: none are near each other, but all are near to what differs by a letter."""
    draw = random.Random(1)
    same = sorted({"".join(draw.sample("abcdefg", 7)) for _ in range(60)})
    table = spark.createDataFrame([(w, 5) for w in same] + [(same[0][:-1] + "z", 50), (same[3] + "q", 7)], "word string, n long")
    trees = spelling.trees_of(table, 10, 1 << 20)
    assert any(letter < 0 and parts > 1 for letter, parts, *_ in trees[7].nodes)
    got = {r.word: (r.form, r.n_near) for r in spelling.neighbours(table, cell=10).collect()}
    assert got == {same[0]: (same[0][:-1] + "z", 1), same[0][:-1] + "z": (same[0], 1), same[3]: (same[3] + "q", 1), same[3] + "q": (same[3], 1)}


def test_crc_of_joined_texts():
    a, b = [b"", b"1:", b"123456:"], [b"abc", b"", b"x" * 64]
    got = spelling.joined_crc(np.array([zlib.crc32(x) for x in a], np.uint32), np.array([zlib.crc32(x) for x in b], np.uint32), np.array([len(x) for x in b]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


def test_long_paths_of_forms(spark):
    words = [f"word{i:03d}" for i in range(40)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(list(zip(words[:-1], words[1:])), "word string, form string")).collect()}
    assert got == dict.fromkeys(words[:-1], words[-1])


def test_variants_of_odd_tables(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = "Abcde" * 60_000
    rows = [(1, long + " " + long), (2, long), (2, long)] + [(3, "abcdf " * 200_000)]
    got = {len(r.word): r.n for r in spelling.variants(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, word int")).collect()}
    assert sum(n for size, n in got.items() if size > 1000) in (3, 4) and got[5] >= 150_000


# op12


def plain_whitening(vectors):
    """(n, deviations, whitened by component up to sign, explained) in numpy."""
    x = np.floor(64 * np.array(vectors, dtype=float)).astype(int) + 1_000_000
    n, s = len(x), x.sum(0)
    c = x - x.mean(0)
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    return ((n * x - s) ** 2).sum(1), (c @ v) / np.sqrt(np.maximum(e, 1e-300)), e / e.sum()


@pytest.mark.parametrize("rows,dimensions,flat", [(400, 64, True), (300, 50, False), (60, 5, False), (3000, 80, False)])
def test_whitening_against_numpy(spark, rows, dimensions, flat):
    made = np.random.default_rng(3)
    x = made.standard_normal((rows, dimensions)) * (1.0 if flat else 1.15 ** -np.arange(dimensions)) @ np.linalg.qr(made.standard_normal((dimensions, dimensions)))[0]
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None), (-2, [None] * dimensions), (-3, [math.nan] * dimensions), (-4, [math.inf] + [0.0] * (dimensions - 1)), (-5, []), (-6, [1.0])], "vec_id long, embedding array<float>")
    out = whitening.components(df.repartition(5), "embedding").collect()
    far, white, explained = plain_whitening(x)
    k = min(32, dimensions)
    assert len(out) == rows * k and {r.n for r in out} == {rows} and max(r.identity_error for r in out) < 1e-9
    got = np.zeros((rows, k))
    for r in out:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == far[r.vec_id] and abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    assert all(min(np.abs(got[:, j] - white[:, j]).max(), np.abs(got[:, j] + white[:, j]).max()) < 1e-6 for j in range(k))


def test_polynomial_damps_what_it_should():
    """Small over the unwanted interval, large above it, and applied to a block as to each vector."""
    e = np.array([10.0, 6.0, 3.0, 2.0, 1.0])
    got = whitening.filtered(lambda q: e[:, None] * q, np.eye(5), 8, 1.0, 3.0)
    want = [np.cosh(8 * np.arccosh((x - 2))) if x > 3 else np.cos(8 * np.arccos(np.clip(x - 2, -1, 1))) for x in e]
    assert np.allclose(np.diag(got), want) and np.allclose(got - np.diag(np.diag(got)), 0)


def test_close_eigenvalues_and_a_block_that_has_to_grow():
    made = np.random.default_rng(1)
    d = 120
    q = np.linalg.qr(made.standard_normal((d, d)))[0]
    e = np.concatenate([np.full(20, 5.0), 1 + 1e-4 * np.arange(100)[::-1]])
    a = (q * e) @ q.T
    got, v, report = whitening.leading(lambda y: a @ y, d, 40)
    assert np.allclose(got, np.sort(e)[::-1][:40], rtol=1e-11) and np.abs(a @ v - v * got).max() < 1e-10 and report["width"] <= d


def test_exact_sums_of_large_numbers():
    x = np.array([[2**60, 5], [2**60 + 3, -7], [-(2**61), 1]])
    n, sums = 3, [int(sum(map(int, c))) for c in x.T]
    y = whitening.scaled(x, n, sums)
    assert [[int(v) for v in r] for r in y] == [[n * int(v) - s for v, s in zip(r, sums)] for r in x.tolist()]
    assert [int(v) for v in whitening.squares(y)] == [sum((n * v - s) ** 2 for v, s in zip(r, sums)) for r in x.tolist()]


def test_partial_sums_meet_in_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 3)
    parts = spark.createDataFrame([(i, np.array([i, 1.0]).tobytes()) for i in range(20)], "part int, v binary")
    assert whitening.added(parts, 20, (2,)).tolist() == [190.0, 20.0]


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, x int, component string, whitened int"
    for rows in ([], [(1, [1.0, 2.0], 0, "a", 0)], [(i, [1.0, 2.0], 0, "a", 0) for i in range(5)], [(1, None, 0, "a", 0)]):
        assert whitening.components(spark.createDataFrame(rows, schema), "embedding").count() == 0
    out = whitening.components(spark.createDataFrame([(i, [float(i), 1.0, float(-i)], i, "a", 7) for i in range(9)] + [(3, [1e300, 0.0, 0.0], 1, "b", 7)], schema), "embedding")
    rows = out.collect()
    assert out.columns[:4] == ["vec_id", "doc_x", "doc_component", "doc_whitened"] and {r.component for r in rows} <= {1, 2, 3} and all(r.doc_whitened == 7 for r in rows)


# op13


def test_passages_have_what_a_plain_count_gives():
    text = "The the cat!! sat\non 99 mats\tÉTÉ " + "again and again " * 30
    bags = attention.Bags(pa.array([text, "", None, "one"]))
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert bags.per.tolist() == [-(-len(words) // attention.PASSAGE), 1, 1, 1]
    got = bags.features(0, int(bags.per.sum()))
    seen: set = set()
    for k in range(bags.per[0]):
        own = range(k * attention.PASSAGE, min((k + 1) * attention.PASSAGE, len(words)))
        n, chars = len(own), sum(len(words[i]) for i in own)
        triples = [tuple(words[i : i + 3]) for i in own if i + 3 <= len(words)]
        again = 0
        for t in triples:
            again += t in seen
            seen.add(t)
        want = [sum(i > 0 and words[i] == words[i - 1] for i in own) / n, 1 - len({words[i] for i in own}) / n, again / n, min(chars / n / 10, 3), 0.0, math.log1p(n) / 4]
        kinds = "".join(words[i] for i in own)
        want += [sum(not c.isalnum() for c in kinds) / chars, sum(c.isupper() for c in kinds) / chars, sum(c.isdigit() for c in kinds) / chars]
        assert np.allclose(got[k, attention.BUCKETS :], want, atol=1e-6), k
        assert abs(got[k, : attention.BUCKETS].sum() - 1) < 1e-6
    assert not got[bags.per[0]].any() and not got[bags.per[0] + 1].any()
    assert got[-1, zlib.crc32(b"a") % attention.BUCKETS] == 1


def test_gradients_are_those_of_differences():
    made = np.random.default_rng(2)
    net, per = attention.Net(), np.array([3, 1, 4])
    f, y, weight = made.random((8, attention.WIDTH)), np.array([1, 0, 1]), np.array([1.0, 3.0, 0.5])
    _, grads = net.gradients(f, per, y, weight)
    for name, g in grads.items():
        for at in {tuple(made.integers(0, s) for s in g.shape) for _ in range(4)}:
            was, ends = net.p[name][at], []
            for step in (1e-6, -1e-6):
                net.p[name][at] = was + step
                ends.append(net.gradients(f, per, y, weight)[0])
            net.p[name][at] = was
            assert abs((ends[0] - ends[1]) / 2e-6 - g[at]) < 1e-6, name


def test_scores_are_those_of_plain_loops(spark):
    net = attention.Net(seed=9)
    texts = ["a b c " * 60, "", None, "One!! Two## 3", "x" * 3000, "w " * 20_000]
    bags = attention.Bags(pa.array(texts))
    got, start = net.logits(bags), 0
    for i, n in enumerate(bags.per):
        f = bags.features(start, start + n)
        h = [np.tanh(x @ net.p["w1"] + net.p["b1"]) for x in f]
        e = [sum(w * math.tanh(v) / (1 + math.exp(-u)) for w, v, u in zip(net.p["w"], x @ net.p["v"], x @ net.p["u"])) for x in h]
        a = [math.exp(v - max(e)) for v in e]
        z = sum(w * x for w, x in zip(a, h)) / sum(a)
        assert abs(got[i] - (z @ net.p["w2"] + net.p["b2"][0])) < 1e-5
        start += n
    model = {"net": net, "shift": 0.25}
    rows = attention.scored(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int"), model, cut=0.3).orderBy("doc_id").collect()
    assert np.allclose([r.score for r in rows], 1 / (1 + np.exp(-(got + 0.25))), atol=1e-6) and all(r.predicted == (r.score >= 0.3) and r.doc_score == 1 for r in rows)


def test_one_bad_passage_decides(spark):
    """Documents differ in one passage of eight; the attention has to find it."""
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdefghij", k=draw.randrange(2, 9))) for _ in range(300)]

    def text(bad):
        passages = [" ".join(draw.choices(words, k=attention.PASSAGE)) for _ in range(8)]
        if bad:
            passages[draw.randrange(8)] = " ".join(w + "###" for w in draw.choices(words, k=attention.PASSAGE))
        return " ".join(passages)

    rows = [(i, text(i % 4 == 0), int(i % 4 != 0)) for i in range(400)]
    model = attention.fit(spark.createDataFrame(rows, "doc_id long, text string, quality int"), cut=0.3)
    new = [(i, text(i % 2 == 0), i % 2) for i in range(200)] + [(999, None, None)]
    got = attention.scored(spark.createDataFrame(new, "doc_id long, text string, quality int"), model, cut=0.3).collect()
    assert np.mean([r.predicted == r.quality for r in got if r.quality is not None]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_quality_from(spark):
    df = spark.createDataFrame([(1, "some text", 1), (2, None, 1)], "doc_id long, text string, quality int")
    assert attention.fit(df) is None and attention.fit(df.limit(0)) is None
    assert [r.score for r in attention.scored(df, None).collect()] == [0.0, 0.0] and attention.scored(df.limit(0), None).count() == 0


# op6 and op8, plainly


def test_network_outputs_are_those_of_plain_loops():
    draw = random.Random(3)
    texts = [" ".join(draw.choices(["you", "awful", "thing", "house", "idiotic", "the"], k=k)) for k in (1, 2, 3, 7, 30)] + ["", "idiotic"]
    words, codes, counts = toxicity.featured(pa.array(texts))
    every = np.unique(words)
    index = np.zeros(toxicity.BUCKETS, np.int32)
    index[every[every > 0]] = np.arange(1, (every > 0).sum() + 1)
    net = toxicity.Net(int((every > 0).sum()) + 1, np.concatenate([np.zeros((1, words.shape[1]), np.int32), index[words]]), np.concatenate([[0.0], np.linspace(0.1, 1, int((every > 0).sum()))]))
    model = {"rows": net.rows(index), "tables": net.tables(), "b": net.b, "out": net.out, "bias": net.bias}
    got, start = toxicity.logits(model, words, codes, counts), 0
    for i, n in enumerate(counts):
        vectors = [sum((net.e[r] * net.trust[r] for r in index[words[c]]), np.zeros(toxicity.DIM)) for c in codes[start : start + n]] + [np.zeros(toxicity.DIM)] * toxicity.PAD
        start += n
        top = [max([0.0] + [float(sum(vectors[at + j] @ w[j][:, f] for j in range(len(w))) + b[f]) for at in range(n)]) for w, b in zip(net.w, net.b) for f in range(toxicity.FILTERS)]
        assert abs(got[i] - float(np.dot(top, net.out) + net.bias[0])) < 2e-3  # tables have 16 bits


def test_toxicity_learns_from_all_labelled_rows(spark):
    draw = random.Random(8)
    word = lambda: "".join(draw.choices("bcdfgaeiou", k=8))
    marks, plain = [word() for _ in range(60)], [word() for _ in range(200)]
    made = lambda i: (i, " ".join([*draw.choices(plain, k=12), *([marks[i // 2 % 60]] if i % 2 else [])]), i % 2)
    rows = [made(i) for i in range(1200)] + [(5000, "long " * 100_000 + marks[0], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    featured = toxicity.featured_rows(df.select(F.col("doc_id").cast("string").alias("k"), F.col("toxic").alias("y"), F.lit(None).cast("string").alias("l"), F.col("text").alias("t")), 2)
    counts = toxicity.counted(featured, 2).where("name = '#'").collect()
    assert sum(int(np.frombuffer(r.n, np.int64)[0]) for r in counts) == 1201 and sum(int(np.frombuffer(r.hits, np.int64)[0]) for r in counts) == 601
    # each mark is in ten rows: a hundred of all 1,201 rows wouldn't have most of them more than once
    model = toxicity.fit(df, most=100)
    got = toxicity.scored(spark.createDataFrame([made(i) for i in range(2000, 2240)], df.schema), model).collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.95


def test_long_texts_go_by_in_pieces(monkeypatch):
    made = np.random.default_rng(6)
    net = toxicity.Net(50)
    ids, lengths = made.integers(1, 50, (3, 100 + toxicity.PAD)), np.array([100, 37, 64])
    ids[np.arange(ids.shape[1])[None] >= lengths[:, None]] = 0
    whole = net.pooled(ids, lengths)
    monkeypatch.setattr(toxicity, "PIECE", 16)
    parts = net.pooled(ids, lengths)
    assert np.allclose(whole[0], parts[0], atol=1e-6) and all((a < lengths[:, None])[parts[0][:, 12 * c : 12 * c + 12] > 0].all() for c, a in enumerate(parts[1]))


def test_features_of_a_page_are_a_plain_count():
    made = np.random.default_rng(4)
    p = made.integers(0, 256, (7, 9, 1), dtype=np.uint8)
    mean, spread, change, shares = tiff._feature(p).split(";")
    values = [int(v) for v in p.ravel()]
    assert abs(float(mean) - sum(values) / 63) < 1e-4 and abs(float(spread) - np.std(values)) < 1e-3
    assert abs(float(change) - sum(abs(int(p[r, c + 1, 0]) - int(p[r, c, 0])) for r in range(7) for c in range(8)) / 63) < 1e-4
    assert shares == ",".join(str(sum(v // 32 == k for v in values)) for k in range(8))


# the registered queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("small"))
    draw = random.Random(12)
    vocabulary = {lang: ["".join(draw.choices(letters, k=draw.randrange(3, 8))) for _ in range(150)] for lang, letters in (("en", "abcdefghijklm"), ("de", "nopqrstuvwxyzäöü"))}
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        own = draw.choices(vocabulary[lang], k=draw.randrange(60, 90))
        rows.append((i, " ".join([*own, "horrid"] if i % 5 == 0 else [w + "##" for w in own] if i % 7 == 0 else own), lang, f"s{i % 3}", 0))
    rows += [(200, rows[1][1], "en", "s0", 0), (201, None, None, None, 0), (202, "", "en", "s1", 0), (203, "MIT License", None, "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 != 0), int(i % 5 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, [draw.gauss(0, 0.1) for _ in range(40)], 0) for i in range(50)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path, rows


RESULTS = {
    "op1_language_id": "doc_id held_out lang_pred score", "op2_token_counts": "doc_id n_tokens", "op3_packed_ids": "doc_id start n_tokens ids_crc32", "op4_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op5_near_duplicates": "doc_id n_shingles component_id kept", "op6_toxicity": "doc_id held_out score predicted", "op7_sentencepiece": "doc_id round_trip n_ids ids_crc32", "op8_tiff": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op9_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op10_mixing": "doc_id size source_size target taken", "op11_spelling_variants": "word form root n n_near form_n",
    "op12_whitening": "vec_id component n deviation whitened explained identity_error", "op13_quality_attention": "doc_id held_out score predicted",
}


@pytest.mark.parametrize("name", RESULTS)
def test_registered_queries(spark, folder, name):
    path, rows = folder
    out = queries.queries()[name](spark, path)
    assert set(RESULTS[name].split()) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    got = out.collect()
    ids = [r[0] for r in rows]
    if name == "op11_spelling_variants":
        assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == plain_variants([r[:2] for r in rows])
        return
    if name == "op12_whitening":
        assert len(got) == 50 * 32
        return
    assert sorted(r.doc_id for r in got) == ids
    by = {r.doc_id: r for r in got}
    crc = {i: zlib.crc32(str(i).encode()) for i in ids}
    texts = {r[0]: (r[1] or "") for r in rows}
    if name == "op1_language_id":
        assert all(by[i].held_out == (crc[i] % 4 == 2) for i in ids) and by[201].lang_pred == by[202].lang_pred == "und"
        assert np.mean([by[r[0]].lang_pred == r[2] for r in rows[:120]]) > 0.95
    if name in ("op6_toxicity", "op13_quality_attention"):
        assert all(by[i].held_out == (crc[i] % 5 == 0) and 0 <= by[i].score <= 1 and by[i].predicted == (by[i].score >= (0.5 if "toxicity" in name else 0.3)) for i in ids)
    if name == "op13_quality_attention":
        assert np.mean([by[i].predicted == (i % 7 != 0) for i in range(120) if i % 5]) > 0.9
    if name == "op8_tiff":
        for i, t in texts.items():
            raw = t.encode()
            payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
            assert (by[i].n_bytes, by[i].payload_bytes, by[i].tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
    if name in ("op3_packed_ids", "op7_sentencepiece"):
        assert all((r.n_tokens if name[2] == "3" else r.n_ids) >= (1 if name[2] == "3" else 0) for r in got)
    if name == "op4_license_scan":
        assert (by[203].base_labels, by[203].n_base, by[203].first_word, by[203].last_word, by[203].n_words) == ("mit", 1, 0, 0, 2)


def test_hashes_of_arrays_are_the_librarys():
    """All words of a slice go by at once, with the hashes that each has alone."""
    import xxhash

    words = ["", "a", "abc", "abcd", "fünf", "x" * 15, "y" * 16, "漢字漢字漢字漢字", "z" * 100_000, *(("pqrs" * 5)[:n] for n in range(20))]
    for part in (pa.array(words), pa.array(["cut", *words, "off"]).slice(1, len(words)), pa.array([], pa.string())):
        for seed in (0, 7):
            assert toxicity.hashes(part, seed).tolist() == [xxhash.xxh32_intdigest(w.encode(), seed) for w in part.to_pylist()]
    alone = lambda w, seed: 1 + xxhash.xxh32_intdigest(w.encode(), seed) % (toxicity.BUCKETS - 1)
    assert toxicity.buckets_of(pa.array(words)).tolist() == [[alone(w, 0), *(alone(w[:n], n) if len(w) > n else 0 for n in toxicity.STEMS)] for w in words]
