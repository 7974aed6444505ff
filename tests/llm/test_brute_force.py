"""Operators against plain versions, and what readers do with files and tables that are odd."""

import math
import random
from concurrent.futures import ThreadPoolExecutor
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldlink.llm import common, langid, licenses, mixing, neardup, packed_ids, quality, sentencepiece_stream, tiff, token_counts, toxicity, unigram
from fieldlink.llm.license_texts import TEXTS

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# op1


def test_forward_pass_is_the_sum_over_all_segmentations():
    path = unigram.default_path()
    table = langid.pieces(path)
    p = np.vstack([np.random.default_rng(1).dirichlet(np.ones(table.size), 2).T, np.zeros(2)])

    def total(word, j):
        if not word:
            return 1.0
        whole = sum(p[table.index[word[:n]], j] * total(word[n:], j) for n in range(1, len(word) + 1) if word[:n] in table.index)
        return whole + (0 if word[0] in table.index else langid.UNKNOWN_P * total(word[1:], j))

    words = [unigram.MARK + w for w in ("the", "hause", "über日", "aa", "")]
    got = langid.log_likelihoods(words, path, p)
    for w, row in zip(words, got):
        assert np.allclose(row, [math.log(total(w, j)) for j in range(2)], rtol=1e-9)
    long = unigram.MARK + "abcde" * 5
    assert np.allclose(langid.long_word(long, table, p), langid.log_likelihoods([long], path, p)[0])


def test_languages_and_toxicity_of_rows_not_learned_from(spark):
    draw = random.Random(5)
    words = {"en": "the house and with of light".split(), "de": "der haus und mit von licht".split(), "fr": "la maison et avec de lumière".split()}
    rows = [(i, " ".join([*draw.choices(words[lang], k=25), *(["idiot"] if i % 4 == 0 else [])]), lang, int(i % 4 == 0)) for i in range(600) for lang in [list(words)[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    learned, held = df.where("doc_id % 3 != 2 or doc_id < 0 or doc_id % 2 = 0"), df.where("doc_id % 6 = 5")
    assert all(r.lang_pred == r.lang for r in langid.predict(held, langid.fit(learned)).collect())
    other = df.where("doc_id % 5 = 0")
    got = toxicity.scored(other, toxicity.fit(df.where("doc_id % 5 != 0"), lang="lang")).collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.95


# op4


def plain_places(text, phrase):
    words, want = licenses.lower_words(text or ""), phrase.split()
    return [i for i in range(len(words) - len(want) + 1) if words[i : i + len(want)] == want]


def test_hashes_are_those_of_spark(spark):
    words = ["mit", "licence", "über", "日本", "a"]
    row = spark.range(1).select(F.array(*(F.xxhash64(F.lit(w)) for w in words)).alias("h")).select("h", F.expr("transform(h, x -> xxhash64(x, h[0]))").alias("p")).first()
    assert licenses.gram_hashes(words)[0] == row.h and [licenses._hash(h, row.h[0]) for h in row.h] == row.p


def test_base_places_and_exact_notices_are_those_of_a_plain_search(spark):
    draw = random.Random(3)
    pool = "mit license apache general public all rights reserved the MIT License, General-Public. über x".split()
    texts = [" ".join(draw.choices(pool, k=draw.randrange(0, 60))) for _ in range(150)] + [None, "", "all rights all rights", "rights reserved x rights reserved", "all rights reserved " * 6]
    got = {r.doc_id: r for r in licenses.labelled(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        found = {label: plain_places(t, p) for p, label in licenses.PHRASES}
        starts = sorted(x for xs in found.values() for x in xs)
        labels = {k for k, xs in found.items() if xs}
        notices = {label for p, label in licenses.NOTICES if plain_places(t, p)}
        assert (got[i].n_words, got[i].n_base) == (len(licenses.lower_words(t or "")), len(starts))
        assert (got[i].first_word, got[i].last_word) == ((starts[0], starts[-1]) if starts else (None, None))
        assert got[i].base_labels == ",".join(sorted(labels)) and got[i].labels == ",".join(sorted(labels | notices))


def test_spans_of_whole_texts(spark):
    mit, isc = licenses.lower_words(TEXTS[0][0]), licenses.lower_words(TEXTS[1][0])
    edited = [*mit[:60], "two", "more", *mit[60:100], *mit[103:]]
    texts = {
        1: " ".join(mit), 2: " ".join(edited), 3: " ".join(mit[:80]), 4: " ".join(["x"] * 7 + mit + ["y"] * 9 + mit), 5: " ".join(mit * 3), 6: " ".join(isc + mit),
        7: " ".join(random.Random(1).sample(mit, len(mit))), 8: " ".join(mit[80:] + mit[:80]),
    }
    found, _ = licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    got = sorted((r.id, r.label, r.first, r.last) for r in found.where("kind = 'text'").select("key.id", "label", "first", "last").collect())
    n, m = len(mit), len(isc)
    assert got == [(1, "mit-text", 0, n - 1), (2, "mit-text", 0, n - 2), (4, "mit-text", 7, n + 6), (4, "mit-text", n + 16, 2 * n + 15), *((5, "mit-text", i * n, i * n + n - 1) for i in range(3)), (6, "isc-text", 0, m - 1), (6, "mit-text", m, m + n - 1)]
    near = "a b c d e f g h i j k l m n o p q r s t"
    tie, _ = licenses.scan(spark.createDataFrame([(1, near)], "doc_id long, text string"), phrases=[], notices=[], texts=[(near + " u v", "longer"), (near, "whole"), (near, "later")])
    assert [r.label for r in tie.collect()] == ["whole"]


# op5


@pytest.mark.parametrize("easy,known", [(8, 200_000), (0, 200_000), (0, 0)])
def test_links_in_a_large_bucket_of_middling_similarity(spark, monkeypatch, easy, known):
    """Texts of one template, at similarity 0.75 to each other, and near copies of some. With no bucket easy, all go on to shingles and blocks; with no ids few, texts are dealt out by id."""
    monkeypatch.setattr(neardup, "EASY", easy)
    monkeypatch.setattr(neardup, "BROADCAST_IDS", known)
    draw = random.Random(2)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(160):
        own = base[:]
        for k in range(5):
            own[draw.randrange(300)] = f"u{i}x{k}"
        texts.append(" ".join(own))
    texts += [t.replace(" w150 ", " new ") for t in texts[:25]]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(296)} for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root))


@pytest.mark.parametrize("n_bytes", [2 << 20, 2000])
def test_blocks_find_links(spark, monkeypatch, n_bytes):
    monkeypatch.setattr(neardup, "BLOCK_BYTES", n_bytes)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:i] + ["x"] + base[i + 1 :]) if i else " ".join(base)) for i in range(0, 40, 4)]
    hard = spark.createDataFrame([(1, i, i, 300) for i, _ in rows], "key long, id long, component long, n long")
    held = neardup.sets_of(spark.createDataFrame(rows, "id long, text string"), 5)
    got = {(r.a, r.b) for r in neardup.blocked(hard, held, (85, 100)).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(96)} for i, t in rows}
    assert got == {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}


def test_long_chains_become_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in neardup.components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


# op8


def test_codec_examples_of_the_specifications():
    packed = bytes.fromhex("FEAA028000 2AFDAA 0380002A22 F7AA".replace(" ", ""))
    assert tiff.packbits_decode(packed, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22") + b"\xaa" * 10
    assert tiff.packbits_decode(tiff.packbits_encode(b"abcaaaad" * 99), 792) == b"abcaaaad" * 99
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(raw, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == raw


@pytest.mark.parametrize("size", [0, 1, 300, 70_000])
@pytest.mark.parametrize("alphabet", [1, 3, 256])
def test_lzw_round_trip(size, alphabet):
    data = np.random.default_rng(size).integers(0, alphabet, size, dtype=np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data), size) == data


def hand_made(tags: dict, data: bytes) -> bytes:
    """A one-page file of (type, values) by tag number, big-endian; data stands at 8."""
    out = bytearray(b"MM" + struct.pack(">HI", 42, 8 + len(data)) + data)
    entries = b""
    for tag, (kind, values) in sorted(tags.items()):
        raw = struct.pack(f">{len(values)}{'H' if kind == 3 else 'I'}", *values)
        assert len(raw) <= 4
        entries += struct.pack(">HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return bytes(out + struct.pack(">H", len(tags)) + entries + b"\0\0\0\0")


def test_samples_of_other_widths():
    one = {256: (3, [10]), 257: (3, [2]), 258: (3, [1]), 259: (3, [1]), 273: (4, [8]), 277: (3, [1]), 278: (3, [2]), 279: (4, [4])}
    (page,) = tiff.read_pages(hand_made(one, bytes([0b10110000, 0b01000000, 0b00000001, 0b10000000])))
    assert page["error"] is None and list(page["pixels"]) == [1, 0, 1, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 1, 1, 0]
    wide = {**one, 256: (3, [2]), 257: (3, [1]), 258: (3, [16]), 317: (3, [2])}
    (page,) = tiff.read_pages(hand_made(wide, struct.pack(">HH", 1000, 65535)))
    assert np.frombuffer(page["pixels"], np.uint16).tolist() == [1000, 999]


def test_files_that_claim_what_they_do_not_hold():
    good = {256: (3, [4]), 257: (3, [2]), 258: (3, [8]), 259: (3, [1]), 273: (4, [8]), 277: (3, [1]), 278: (3, [2]), 279: (4, [8])}
    assert tiff.read_pages(hand_made(good, b"abcdefgh"))[0]["pixels"] == b"abcdefgh"
    bad = [{257: (4, [1 << 31])}, {256: (4, [1 << 31]), 257: (4, [1 << 31])}, {278: (3, [1])}, {256: (3, [0])}, {259: (3, [99])}, {279: (4, [1 << 30])}, {322: (4, [0]), 323: (4, [0]), 324: (4, [8]), 325: (4, [8])}, {258: (3, [7])}, {317: (3, [3])}]
    for more in bad:
        (page,) = tiff.read_pages(hand_made({**good, **more}, b"abcdefgh"))
        assert page["error"] and "pixels" not in page, more
    bomb = zlib.compress(b"\0" * 50_000_000)
    assert len(tiff.decompress(bomb, tiff.DEFLATE, 100)) == 100
    whole = tiff.tiff([np.full((300, 64, 1), 7, np.uint8)] * 2, tiff.LZW)
    for n in range(0, len(whole), 7):
        assert all(p["error"] is None for p in tiff.read_pages(whole[:n])[:-1])
    assert tiff.read_pages(b"II*\0\0\0\0\0")[0]["error"] and tiff.read_pages(None)[0]["error"]


@pytest.mark.parametrize("size", [0, 5, 64, 700, 40_000, 140_000])
def test_payloads_of_all_lengths_meet_all_forms(size):
    raw = (b"the text of a page " * (size // 19 + 1))[:size]
    for form in tiff.FORMS:
        read = tiff.read_pages(tiff.media_of(tiff.padded(raw), forms=[form]))
        assert b"".join(p["pixels"] for p in read) == tiff.padded(raw) and len(read) == -(-len(tiff.padded(raw)) // (64 * tiff.PAGE_ROWS))


# op9


def plain_counts(text):
    words, lines, seen = [w for w in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in text or "").split(" ") if w], 0, set()
    for line in (text or "").split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            lines += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text or ""), lines, len(covered)


def plain_estimate(x, settled=0.01):
    """The estimate of fit() in numpy."""
    k, floor = x.shape[1], quality.FLOOR**2
    med = np.median(x, 0)
    wide = np.maximum(np.median(abs(x - med), 0) * 1.4826, quality.FLOOR)
    t = np.floor(np.tanh((x - med) / wide) * 1024 + 0.5)
    ct = np.cov(t.T, bias=True)
    shape = ct / np.sqrt(np.maximum(np.outer(np.diag(ct), np.diag(ct)), 1.0))
    np.fill_diagonal(shape, 1.0)
    starts = [(med, np.diag(wide**2)), (med, shape * np.outer(wide, wide)), (x.mean(0), np.cov(x.T, bias=True) + floor * np.eye(k))]
    far = lambda m, v: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(v), x - m)
    bins = lambda d: np.floor(np.log2(1 + d) * 256)

    def step(m, v):
        b = bins(far(m, v))
        half = x[b <= np.median(b)]
        return half.mean(0), np.cov(half.T, bias=True) + floor * np.eye(k)

    logdet = lambda f: np.linalg.slogdet(f[1])[1]
    best = min((step(*step(*s)) for s in starts), key=logdet)
    while True:
        new = step(*best)
        fell = logdet(best) - logdet(new)
        best = new if fell > 0 else best
        if fell <= settled:
            break
    mid = np.median(bins(far(*best)))
    return best[0], best[1] * max((2 ** ((mid + 0.5) / 256) - 1) / quality.chi_squared(0.5, 0), 1.0)


def test_counts_and_distances_are_those_of_a_plain_version(spark):
    draw = random.Random(8)
    words = [f"w{i}" for i in range(400)] + ["#tag", "a|b", "x*"]
    texts = ["\n".join(" ".join(draw.choices(words, k=draw.randrange(1, 25))) for _ in range(draw.randrange(1, 14))) for _ in range(260)]
    texts += [None, "", " \n\t", "a b c a b c a b c", "same\nsame\n same\n", "one two three " * 40]
    rows = [(i, t, "en" if i % 3 else "de", None) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    stats = {}
    for i, t, *_ in rows:
        n, chars, symbols, lines, repeats = plain_counts(t)
        failed = n < 50 or 100 * repeats > 50 * n
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, lines, repeats, failed), i
        if not failed:
            raw = np.array([math.log2((chars + 1) / n) * 4, math.log2(1 + 1000 * symbols / n) / 2, math.log2(1 + 100 * repeats / n) / 2, math.log2(n)])
            stats[i] = np.floor(raw * quality.UNIT + 0.5)
    pool = plain_estimate(np.array(list(stats.values())))
    for lang in ("en", "de"):
        own = [i for i in stats if rows[i][2] == lang]
        m, v = plain_estimate(np.array([stats[i] for i in own]))
        w, gap = len(own) / (len(own) + 50.0), m - pool[0]
        m, v = w * m + (1 - w) * pool[0], w * v + (1 - w) * pool[1] + w * (1 - w) * np.outer(gap, gap)
        for i in own:
            d = (stats[i] - m) @ np.linalg.inv(v) @ (stats[i] - m)
            assert math.isclose(got[i].distance, d, rel_tol=1e-6, abs_tol=1e-9)
            assert got[i].kept == (d <= quality.chi_squared(None, quality.TAIL))


def test_chi_squared_quantiles():
    assert abs(quality.chi_squared(0.5, 0) - 3.356694) < 1e-5 and abs(quality.chi_squared(0.95, 0) - 9.487729) < 1e-5 and abs(quality.chi_squared(None, 0.05) - 9.487729) < 1e-5


# what each operator does with odd tables

EMPTY_OR_NOT = {
    "op1": lambda d: langid.predict(d, langid.fit(d)), "op2": token_counts.count_tokens, "op3": lambda d: packed_ids.read(packed_ids.encode(d, byte_bpe(), 2)), "op4": licenses.labelled, "op5": neardup.near_duplicates,
    "op6": lambda d: toxicity.scored(d, toxicity.fit(d.withColumn("toxic", F.lit(0)))), "op7": lambda d: sentencepiece_stream.decode(sentencepiece_stream.encode(d)), "op8": lambda d: tiff.read(tiff.write(d)),
    "op9": quality.judged, "op9 accepted": quality.accepted, "op10": mixing.plan, "op10 mixed": mixing.mixed, "near_duplicates": lambda d: corpus_pipeline._near_duplicates(d.sparkSession, d, ""), "toxicity": lambda d: toxicity.left(d, None), "sentencepiece": lambda d: corpus_pipeline._sentencepiece(d.sparkSession, d, ""),
}


def byte_bpe():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", EMPTY_OR_NOT)
def test_empty_tables(spark, name):
    assert EMPTY_OR_NOT[name](spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("name", EMPTY_OR_NOT)
def test_very_long_texts_and_words(spark, name):
    texts = ["word and word " * 80_000, "x" * 1_100_000, "ab " + "日本" * 200_000, None, ""]
    out = EMPTY_OR_NOT[name](spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)).collect()
    if name == "op8":  # pages are rows
        assert sorted({r.doc_id for r in out}) == [0, 1, 2, 3, 4] and all(r.error is None for r in out)
    elif name not in ("op9 accepted", "op10 mixed"):
        assert len(out) == 5


CLASHING = ["score", "predicted", "lang_pred", "n_tokens", "n_segments", "ids", "decoded", "media", "n_bytes", "pages", "page", "error", "kept", "n_words", "distance", "size", "start", "taken", "blocks", "quota", "key", "label", "h", "_row", "component_id", "_own", "z_len"]


@pytest.mark.parametrize("name", EMPTY_OR_NOT)
def test_columns_of_clashing_names(spark, name):
    text = " ".join(f"w{i}" for i in range(120))
    docs = spark.createDataFrame([(1, text, "en", "s", 9, *range(len(CLASHING))), (2, text + " end", None, None, 9, *range(len(CLASHING)))], DOCS + ", " + ", ".join(f"{c} int" for c in CLASHING))
    out = EMPTY_OR_NOT[name](docs)
    rows = out.collect()
    assert len({c.lower() for c in out.columns}) == len(out.columns) and rows
    if name in ("op9 accepted", "op10 mixed", "near_duplicates", "toxicity"):
        assert out.columns == docs.columns and all([r[c] for c in CLASHING] == list(range(len(CLASHING))) for r in rows)
    elif name in ("op1", "op2", "op6", "op7", "op9"):
        for at, c in enumerate(CLASHING):
            assert all(r[f"doc_{c}" if f"doc_{c}" in out.columns else c] == at for r in rows), c


def test_ids_of_text(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([("b", text, 1), ("a", text + " end", 0), (None, text, 1), ("c", "idiot", 1), ("d", "fine", 0)], "doc_id string, text string, toxic int")
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == [("None", "a", False), ("a", "a", True), ("b", "a", False), ("c", "c", True), ("d", "d", True)]
    assert toxicity.scored(docs, toxicity.fit(docs, least_docs=1)).count() == 5
    with pytest.raises(TypeError):
        packed_ids.encode(docs, byte_bpe(), 2)


def test_many_rows_of_one_id_are_dealt_out(spark):
    docs = spark.createDataFrame([(7, "same text", "en", "s", 0)] * 400, DOCS).repartition(8)
    files = packed_ids.encode(docs, byte_bpe(), 2, shards=4, file_ids=50)
    assert files.select("shard").distinct().count() > 1
    rows = sorted(packed_ids.read(files).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [i * rows[0].n_tokens for i in range(400)]


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    docs = spark.createDataFrame([(i, f"some text {i % 3} that is here", "en", "s", 0) for i in range(9)], DOCS)
    assert neardup.near_duplicates(docs).count() == 9
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["component", "named", "rows"]
    with common.scratch(spark) as keep:
        kept, gone = keep(common.written(docs, "kept")), common.written(docs, "gone")
    assert kept.count() == 9 and not list(tmp_path.glob("gone*")) and gone is not None


def test_scratch_of_one_thread_keeps_off_another(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    with common.scratch(spark), ThreadPoolExecutor(1) as pool:
        other = pool.submit(lambda: common.written(spark.range(3), "other")).result()
        common.written(spark.range(2), "own")
    assert other.count() == 3 and not list(tmp_path.glob("own*"))


def test_prefixes_of_similar_sets_meet(spark):
    """Two sets of the threshold's similarity share one of their prefixes' elements, whatever else is common."""
    draw = random.Random(3)
    texts = []
    for i in range(30):
        own = [f"w{draw.randrange(40)}" for _ in range(120)]
        texts += [" ".join(own), " ".join([*own[:100], *(f"n{i}x{k}" for k in range(3)), *own[103:]])]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for t in texts]
    keys: dict[int, set[int]] = {}
    for r in neardup.prefixes(neardup.sets_of(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 5), (85, 100)).collect():
        keys.setdefault(r.id, set()).add(r.key)
    near = [(a, b) for b in range(60) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert len(near) >= 30 and all(keys[a] & keys[b] for a, b in near)


def test_expected_counts_are_those_of_all_segmentations():
    """Of short words and, by logarithms, of long ones."""
    path = unigram.default_path()
    table = langid.pieces(path)
    p = np.vstack([np.repeat(table.start[:, None], 2, 1) * [1.0, 0.5], np.zeros(2)])
    words, language, count = ["▁the", "▁zqx", "▁house"], np.array([0, 1, 1]), np.array([3, 1, 2])

    def all_ways(word, own):
        ways = []

        def walk(at, used, weight):
            if at == len(word):
                ways.append((used, weight))
            for m in range(1, min(table.longest, len(word) - at) + 1):
                r = table.index.get(word[at : at + m], -1)
                if r >= 0:
                    walk(at + m, [*used, r], weight * p[r, own])
                elif m == 1:
                    walk(at + 1, used, weight * langid.UNKNOWN_P)

        walk(0, [], 1.0)
        return ways

    want = np.zeros((2, table.size))
    for w, own, n in zip(words, language, count):
        ways = all_ways(w, own)
        for used, weight in ways:
            for r in used:
                want[own, r] += n * weight / sum(x for _, x in ways)
    assert np.allclose(langid.expected(words, language, count, table, p), want)
    for w, own, n in zip(words, language, count):
        found, times = langid.long_counts(w, table, p[:, own])
        got = np.bincount(found, times, minlength=table.size)
        assert np.allclose(got, langid.expected([w], np.array([own]), np.array([1]), table, p)[own])


def test_long_words_are_learned_whole(spark):
    """A piece across the 24th character of a word counts."""
    word = "ab" * 11 + "house" + "cd" * 8
    df = spark.createDataFrame([(i, word, "x") for i in range(3)], "doc_id long, text string, lang string")
    model = langid.fit(df, rounds=1)
    piece, own, n = model["groups"][0]
    table = langid.pieces(model["path"])
    p = np.append(table.start, 0.0)
    found, times = langid.long_counts(unigram.MARK + word, table, p)
    want = np.bincount(found, 3 * np.array(times), minlength=table.size)
    got = np.bincount(piece, n, minlength=table.size)
    assert np.allclose(got, np.where(want > 1e-9, want, 0)) and got[table.index["house"]] > 0


def test_three_hundred_languages(spark):
    """More languages than a group holds: each is learned, and the score is the posterior over all of them."""
    draw = random.Random(5)
    own = {f"l{k:03d}": ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(8)] for k in range(300)}
    rows = [(k * 4 + i, " ".join(draw.choices(w, k=30)), name) for k, (name, w) in enumerate(own.items()) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, rounds=1, smoothing=20.0)
    assert model["languages"] == sorted(own)
    got = langid.predict(df.where("doc_id % 40 = 0"), model).collect()
    assert all(r.lang_pred == r.lang for r in got)
    p = np.hstack([langid.dense(model, g) for g in range(len(model["groups"]))])
    for r in got[:3]:
        words = r.text.split()
        log = langid.log_likelihoods(langid.marked(words), model["path"], p).astype(np.float32).astype(float).sum(0)
        q = np.exp(log - log.max())
        assert abs(r.score - q.max() / q.sum()) < 1e-6
