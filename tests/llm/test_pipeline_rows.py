"""Rows of the pipeline that have no id or share one."""

import corpus_pipeline
from fieldlink.llm import mixing, neardup


def test_rows_without_an_id_or_with_a_shared_one(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(100)) for k in "abcde"}
    near = {k: t.replace(f"{k}50 ", "changed ") for k, t in text.items()}
    rows = [(None, text["a"]), (None, text["b"]), (None, near["b"]), (1, text["c"]), (1, text["c"]), (2, text["d"]), (2, text["e"]), (3, near["d"]), (1, near["e"])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((str(r.doc_id), r.text[0]) for r in corpus_pipeline._near_duplicates(spark, docs, "").collect())
    assert [k for _, k in kept] == ["c", "e", "d", "a", "b"] and [i for i, _ in kept] == ["1", "1", "2", "None", "None"]
    found = neardup.near_duplicates(docs).collect()
    assert len(found) == len(rows) and sum(r.kept for r in found) == 5
    assert sorted(str(r.component_id) for r in found) == ["1"] * 4 + ["2"] * 2 + ["None"] * 3


def test_mix_keeps_to_the_plan_where_ids_repeat(spark):
    texts = [" ".join(f"{k}{i}" for i in range(n)) for k, n in zip("abcdef", (700, 40, 500, 90, 333, 64))]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in zip((7, 7, None, None, 1, 2), texts, "xxyyzz")], "doc_id long, text string, lang string, source string, n_chars long")
    taken = sum(r.taken for r in mixing.plan(docs).collect())
    out = [r.text.split() for r in mixing.mixed(docs).collect()]
    assert sum(map(len, out)) == taken
    for t in texts:
        own = [w for w in out if w[0][0] == t[0]]
        assert sum(map(len, own)) <= 2 * len(t.split()) and sum(w != t.split() for w in own) <= 1
