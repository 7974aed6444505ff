"""run() against a plain version: groups by all pairs, quotas by DuckDB, ids by the tokenizers library."""

import random
import re
from collections import defaultdict

import duckdb
import pandas as pd

import corpus_pipeline
from fieldlink.llm import oracles, quality, queries, toxicity

from test_operators import library

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def made() -> list[tuple]:
    draw = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne", "tu") for b in ("ra", "so", "vi", "del", "pan") for c in ("", "n", "s", "ta", "mo", "ri")]
    rows = []
    for i in range(240):
        words = draw.choices(vocabulary, k=draw.randrange(60, 200))
        if i % 6 == 0:
            words[draw.randrange(len(words))] = "idiot"
        rows.append((i, " ".join(words), "en", "big" if i % 3 else f"s{i % 2}"))
    for i in range(240, 270):  # near and exact copies of documents without the marked word
        words = rows[1 + 6 * (i % 10)][1].split()
        if i % 2:
            words[3] = "changed"
        rows.append((i, " ".join(words), "en", None))
    rows += [(270, None, "en", "big"), (271, "", "en", "big"), (272, "too short", "en", "s0"), (273, "again and again " * 60, "en", "s0")]
    return rows


def shingles(text: str) -> set:
    words = WORD.findall(text.lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def classes(texts: dict[int, str]) -> dict[int, int]:
    """The smallest id of each document's component, from all pairs."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in texts}


def test_pipeline_against_a_plain_version(spark, tmp_path):
    rows = made()
    sf_dir = str(tmp_path)
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(i, 1, int("idiot" in (t or ""))) for i, t, *_ in rows[:240]], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text, source = {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}

    verdict = {r.doc_id: r for r in quality.judged(docs).collect()}
    good = {i for i, r in verdict.items() if r.kept}
    assert good.isdisjoint({270, 271, 272, 273}) and len(good) > 200
    left = docs.where(docs.doc_id.isin(sorted(good)))
    toxic = {r.doc_id for r in toxicity.scored(left, queries.toxicity_model(spark, sf_dir, left)).where("predicted = 1").collect()}
    marked = {i for i in good if "idiot" in text[i]}
    assert len(toxic & marked) > 0.8 * len(marked) and len(toxic - marked) <= 5
    component = classes({i: text[i] for i in sorted(good - toxic)})
    heads = sorted(i for i, c in component.items() if i == c)
    assert len(heads) < len(component)

    frame = pd.DataFrame({"doc_id": heads, "text": [text[i] for i in heads], "source": [source[i] for i in heads]})
    con = duckdb.connect()
    con.register("documents", frame)
    taken = dict(con.sql(f"SELECT doc_id, taken FROM ({oracles.OP10})").fetchall())

    t, got = library(), defaultdict(list)
    result = corpus_pipeline.run(spark, sf_dir)
    assert result.columns == ["doc_id", "lang", "source", "ids", "n_ids", "round_trip"]
    for r in result.collect():
        words = "".join(t.id_to_token(i) for i in r.ids).replace("▁", " ").split()
        assert r.round_trip and r.n_ids == len(r.ids) and r.source == source[r.doc_id]
        assert r.ids == t.encode(" ".join(words), add_special_tokens=False).ids
        got[r.doc_id].append(words)
    assert {i: sum(map(len, w)) for i, w in got.items()} == {i: n for i, n in taken.items() if n}
    for i, copies in got.items():
        whole = text[i].split()
        assert sum(c != whole for c in copies) <= 1
        for c in copies:
            rest = iter(whole)
            assert all(w in rest for w in c)
