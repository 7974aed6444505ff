import random
import zlib

import numpy as np
import pytest

from fieldlink.llm import langid, licenses, mixing, neardup, packed_ids, quality, sentencepiece_stream, tiff, token_counts, toxicity, unigram

random.seed(4)
WORDS = ["the", "cat", "sat", "on", "a", "mat", "while", "rain", "fell", "über", "naïve", "日本語", "x" * 40, "$5", "MIT", "License"]
TEXTS = [None, "", "   ", "one", " lead  double\n\nspace ", "▁mark", "😀 emoji\ttab"] + [" ".join(random.choices(WORDS, k=k)) for k in (3, 5, 60, 200, 4000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", i) for i, t in enumerate(TEXTS)]
    rows += [(None, "one", "en", "s1", 0), (7, TEXTS[7], "en", "s1", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")


def library():
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    v = unigram.load(unigram.default_path())
    t = Tokenizer(models.Unigram(v.library_vocabulary(), unk_id=v.unknown_id, byte_fallback=True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    t.pre_tokenizer = pre_tokenizers.Split("▁", "merged_with_next")
    return t


def test_token_counts_and_ids_match_the_library(docs):
    t = library()
    want = {x: t.encode(x or "", add_special_tokens=False).ids for x in TEXTS}
    for r in token_counts.count_tokens(docs).collect():
        assert r.n_tokens == len(want[r.text])
    for r in sentencepiece_stream.decode(sentencepiece_stream.encode(docs)).collect():
        assert r.ids == want[r.text]
        assert r.decoded == (r.text or "").replace("▁", " ")


def test_streaming_window_is_bounded():
    codec = sentencepiece_stream.codec(unigram.default_path())
    stream = sentencepiece_stream.StreamingViterbi(codec.vocabulary, codec.prefixes)
    text, ids = "▁" + "abcdefghij" * 500, []
    for c in text:
        ids += stream.feed(c)
        assert len(stream.scores) <= 4 * codec.vocabulary.longest + 1
    assert ids + stream.finish() == codec.encode(text)


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17])
def test_bit_packing(bits):
    ids = np.array([random.randrange(1 << bits) for _ in range(10001)], dtype=np.uint32)
    lengths = np.array([0, 5000, 1, 5000])
    f = packed_ids.PackedFile(packed_ids.file_image([1, None, 3, 4], lengths, ids, bits, block=100))
    assert (f.all() == ids).all() and (f.range(4999, 5003) == ids[4999:5003]).all() and f.doc_ids == [1, None, 3, 4]


def test_packed_files(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = sorted(packed_ids.read(packed_ids.encode(docs, path, 2, file_ids=500)).collect(), key=lambda r: r.start)
    start = 0
    for r, text in zip(rows, [x[1] for x in sorted(((-1, "one"), *enumerate(TEXTS), (7, TEXTS[7])), key=lambda x: x[0])]):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, zlib.crc32(bytes(r.ids_le))) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("how", [{}, {"predictor": 2}, {"tile": (16, 32)}, {"order": ">", "rows": 3}])
def test_tiff(compression, how):
    pages = [np.random.default_rng(i).integers(0, 3 + 250 * (i % 2), (37, 50, 1 + 2 * (i % 2)), dtype=np.uint8) for i in range(3)]
    read = tiff.read_pages(tiff.tiff(pages, compression, **how))
    assert [r["pixels"] for r in read] == [p.tobytes() for p in pages]


def test_tiff_query_path(docs):
    rows = tiff.read(tiff.write(docs)).collect()
    assert len(rows) == len(TEXTS) + 2 and all(r.error is None for r in rows)
    assert tiff.read_pages(b"junk")[0]["error"]


def test_near_duplicates(spark):
    base = [f"w{i}" for i in range(200)]
    near = [*base[:100], "changed", *base[101:]]
    rows = [(5, " ".join(base), 0), (2, " ".join(near), 0), (9, " ".join(base).upper(), 0), (1, None, 0), (3, "", 0), (4, "a b", 0), (6, "a  b", 0), (7, " ".join(base[:100]), 0), (None, "a b", 0)]
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, sig int")).collect()}
    assert got == {(5, 196): (2, False), (2, 196): (2, True), (9, 196): (2, False), (1, 0): (1, True), (3, 0): (3, True), (4, 1): (4, True), (6, 1): (4, False), (7, 96): (7, True), (None, 1): (4, False)}


def test_licenses(docs, spark):
    assert licenses.labelled(docs).count() == len(TEXTS) + 2
    rows = [(1, "The MIT License, and MIT-License."), (2, "Licensed under the Apache License, Version 2.0"), (3, None)]
    got = {r.doc_id: r for r in licenses.labelled(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 1, 4, "mit")
    assert got[2].labels == "apache,apache-2.0" and got[3].n_words == 0 and got[3].labels == ""


def test_quality(docs, spark):
    rows = quality.judged(docs).collect()
    assert len(rows) == len(TEXTS) + 2 and all(r.base_failed for r in rows if r.n_words < 50)
    clean = [(i, " ".join(random.choices([f"w{j}" for j in range(3000)], k=200 + i)), "en", "s") for i in range(300)]
    junk = [(1000 + i, " ".join(w + "###$$" for w in random.choices([f"w{j}" for j in range(3000)], k=200)), "en", "s") for i in range(9)]
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i, *_ in clean) and not any(got[i] for i, *_ in junk)
    assert quality.accepted(docs.limit(0)).count() == 0


def test_mixing(docs):
    rows = mixing.plan(docs).collect()
    assert len(rows) == len(TEXTS) + 2 and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert sorted(map(str, mixing.plan(docs).collect())) == sorted(map(str, rows))
    assert mixing.mixed(docs).columns == docs.columns and mixing.plan(docs.limit(0)).count() == 0


def test_language_and_toxicity(spark):
    made = [(i, " ".join(random.choices(["the", "house", "and", "with"] if i % 2 else ["der", "das", "und", "haus"], k=30)) + (" idiot" if i % 3 == 0 else ""), "en" if i % 2 else "de", int(i % 3 == 0)) for i in range(240)]
    df = spark.createDataFrame([*made, (None, None, None, None), (999, "12 34", "en", None)], "doc_id long, text string, lang string, toxic int")
    got = langid.predict(df, langid.fit(df)).collect()
    assert all(r.lang_pred == r.lang for r in got if r.toxic is not None) and [r.lang_pred for r in got if r.toxic is None] == ["und", "und"]
    scored = toxicity.scored(df, toxicity.fit(df)).collect()
    assert np.mean([r.predicted == r.toxic for r in scored if r.toxic is not None]) > 0.95
    assert {r.score for r in toxicity.scored(df, toxicity.fit(df.limit(0))).collect()} == {0.0}


def test_toxicity_learns_rare_words_and_stems(spark):
    """Marking words of fewer than 1 in 200 rows count, and forms never seen share their stem's evidence."""
    draw = random.Random(9)
    plain = [f"w{i}" for i in range(400)]
    text = lambda *marks: " ".join([*draw.choices(plain, k=25), *marks])
    endings = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    rows = [(i, text(), 0) for i in range(2200)]
    rows += [(3000 + 8 * m + i, text(f"mark{m}"), 1) for m in range(25) for i in range(8)]
    rows += [(4000 + i, text(f"vileword{e}"), 1) for i, e in enumerate(endings[:40])]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    new = [(i, text(f"mark{i}"), 1) for i in range(25)] + [(100 + i, text(f"vileword{e}"), 1) for i, e in enumerate(endings[40:])] + [(200 + i, text(), 0) for i in range(300)]
    got = {r.doc_id: r.predicted for r in toxicity.scored(spark.createDataFrame(new, "doc_id long, text string, toxic int"), model).collect()}
    assert sum(got[i] for i in range(25)) >= 22
    assert sum(got[100 + i] for i in range(len(endings) - 40)) >= 18
    assert sum(got[200 + i] for i in range(300)) <= 15


def test_mixing_gives_a_long_tail_its_targets(spark):
    """Sources of few and short documents get their targets however many shards there are."""
    rows = [(i, "w " * 300, f"big{i % 4}") for i in range(6_000)]
    rows += [(10_000 + i, "w " * 12, "short") for i in range(50)] + [(11_000 + i, "w " * 30, "some") for i in range(50)]
    rows += [(20_000 + i, "w " * (1 + i % 9), f"tail{i // 2}") for i in range(600)]
    plan = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    got = {r["source"]: (r["sum(taken)"], r["max(target)"]) for r in plan}
    for name in ("short", "some", "big0", "big3"):
        assert abs(got[name][0] / got[name][1] - 1) < 0.03
    tail = [x for name, x in got.items() if name.startswith("tail")]
    assert len(tail) == 300 and abs(sum(a for a, _ in tail) / sum(b for _, b in tail) - 1) < 0.03
    assert all(abs(a - b) <= 2 for a, b in tail)


def test_mixing_deals_rows_without_id_over_all_shards(spark):
    """Half the rows have no id, of which half share one text as well; each shard has blocks of one size and no more than its part."""
    rows = [(i, f"text {i} " + "w " * 40, "a") for i in range(3_000)] + [(None, f"other {i} " + "w " * 40, "a") for i in range(1_500)] + [(None, "same " + "w " * 40, "b")] * 1_500
    plan = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)).collect()
    per: dict[int, list] = {}
    for r in plan:
        per.setdefault(r.shard, []).append(r)
    assert len(plan) == 6_000 and len(per) == 6 and max(map(len, per.values())) < 1_400
    assert all(len({r.block for r in own}) == 1 for own in per.values())
    assert all(sum(r.doc_id is None for r in own) < 0.65 * len(own) for own in per.values())
    for name in "ab":
        own = [r for r in plan if r.source == name]
        assert abs(sum(r.taken for r in own) / own[0].target - 1) < 0.01
