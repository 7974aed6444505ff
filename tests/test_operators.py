"""Operators against plain values: texts of doubles, moments, rows that agree, first values, reasons, lost targets."""

import math
import random
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlink.functions import values as V
from fieldlink.operators import duplicates, match, melt, overlap, profile, types
from fieldlink.plans import mapping


def test_doubles_have_exact_texts(spark):
    want = {
        1.001: "1.001", 1.002: "1.002", 1.004: "1.004", 0.0049: "0.0049", 1e40: "1" + "0" * 40, -2.5e-7: "-0.00000025", 5.0: "5", -0.0: "0", 1e7: "10000000", 12345678.25: "12345678.25", 0.1 + 0.2: "0.30000000000000004", 2.0**-44: "0.00000000000005684341886080802",
        1e23: "1" + "0" * 23, 5e-324: "0." + "0" * 323 + "49", math.inf: "Infinity", -math.inf: "-Infinity",
    }
    got = spark.createDataFrame([(x,) for x in want], "x double").select("x", melt.double_text(F.col("x")).alias("t")).collect()
    assert {r.x: r.t for r in got} == want and all(float(r.t) == r.x for r in got)
    assert spark.createDataFrame([(math.nan,), (None,)], "x double").select(melt.double_text(F.col("x")).alias("t")).where("t is not null").count() == 0


def test_equal_floats_and_doubles_have_equal_texts(spark):
    made = random.Random(1)
    df = spark.createDataFrame([(made.uniform(-1, 1) * 10.0 ** made.randint(-30, 30),) for _ in range(500)], "x float").withColumn("y", F.col("x").cast("double"))
    both = df.select("y", *(melt.to_text(F.col(c), k).alias(f"t{c}") for c, k in (("x", T.FloatType()), ("y", T.DoubleType())))).collect()
    assert all(r.tx == r.ty and float(r.tx) == r.y and "e" not in r.tx.lower() for r in both)


def test_moments_of_large_numbers(spark):
    d = melt.dictionary(melt.melt(spark.createDataFrame([(str(10**12 + i % 100), str(i % 7), "x") for i in range(700)], "a string, b string, c string"), "A"))
    got = {r.col_idx: r for r in overlap.numbers(d).collect()}
    spread = lambda xs: (sum((x - sum(xs) / len(xs)) ** 2 for x in xs) / len(xs)) ** 0.5
    assert abs(got[0].std - spread(range(100))) < 1e-9 and abs(got[0].mean - (10**12 + 49.5)) < 1e-3 and abs(got[1].std - 2.0) < 1e-12
    assert (got[2].n, got[2].mean, got[2].std) == (0, None, None)


def test_lengths_of_a_column_without_values(spark):
    p = profile.profile(melt.dictionary(melt.melt(spark.createDataFrame([("N/A",), (None,)], "a string"), "A"))).first()
    assert (p.min_length, p.max_length, p.avg_length, p.n_values, p.null_ratio) == (0, 0, 0.0, 0, 1.0)


def test_first_values_are_limited_before_they_are_normalized(spark):
    rows = [(i, None if i % 3 else f" Val-{i} ", "N/A" if i % 2 else "\tX  y\n") for i in range(400)]
    cells = melt.melt(spark.createDataFrame(rows, "k int, a string, b string"), "A", order="k", hidden=True)
    got = profile.first_values(cells, k=5)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp") < plan.index("rank") or "regexp" not in plan[plan.index("Window") :]
    values = {c: [r.value for r in got.where(f"col_idx = {c}").orderBy("rank").collect()] for c in (0, 1)}
    assert values == {0: [f"val-{i}" if len(f"val-{i}") < 8 else f"val-{i}" for i in range(0, 15, 3)], 1: ["x y"] * 5}


def test_has_value_is_null_like(spark):
    texts = ["", " ", "\t", "N/A", " n/A\n", "--", "-", "x", "\x0bnull\x0c", "nul", "undefined", None, " "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select((V.null_like(F.col("t")).isNotNull() == V.has_value(F.col("t"))).alias("same")).collect()
    assert all(r.same for r in got)


def test_rows_that_agree_in_one_scan(spark):
    made = random.Random(2)
    rows = [tuple(made.choice(["1.0", "$1", " 1", "2", None, "N/A"]) for _ in range(4)) + (str(i),) for i in range(3000)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string").repartition(5)
    normal = {"1.0": "1", "$1": "1", " 1": "1", "2": "2", None: None, "N/A": None}
    want = {(x, y): sum(normal.get(r[x], r[x]) != normal.get(r[y], r[y]) for r in rows) for x in range(5) for y in range(x + 1, 5)}
    got = {(r.a, r.b): (r.misses, r.n) for r in overlap.row_misses(df, list(want)).collect()}
    assert got == {p: (m, 3000) for p, m in want.items()}
    early = {(r.a, r.b): r.misses for r in overlap.row_misses(df, list(want), 10).collect()}
    assert all((early[p] > 10) == (m > 10) for p, m in want.items())
    assert [tuple(r) for r in overlap.rows_equal(df.limit(0), [("a", "b")]).collect()] == [("a", "b", 0.0)]


def test_many_unique_columns_need_no_count(spark, monkeypatch):
    """Columns without common values are told apart by the inverted index alone; copies with few changes are counted."""
    n = 40
    df = spark.createDataFrame([tuple(f"c{c}v{i}" for c in range(n)) + (f"c0v{i}" if i else "changed", None, None) for i in range(1500)], ", ".join(f"x{c} string" for c in range(n + 3)))
    seen = []
    real = overlap.row_misses
    monkeypatch.setattr(overlap, "row_misses", lambda df, pairs, allowed: seen.append(pairs) or real(df, pairs, allowed))
    d = melt.dictionary(melt.melt(df, "A"))
    checked = melt.columns(df, "A").join(profile.profile(d), ["side", "col_idx"], "left")
    over = overlap.overlaps(overlap.signatures(d, ("raw",)))
    got = sorted((r.a, r.b) for r in mapping.equal_columns(df, checked, over).collect())
    assert seen == [[(n + 1, n + 2)]] and got == [(n + 1, n + 2)]  # (0, n) share enough values to be near without a count


def test_reasons_of_values_and_types(spark):
    over = spark.createDataFrame([("A", 0, "B", 0, "raw", 9, 10, 10, 0.9, 0.9, 9 / 11, 0.9), ("A", 0, "B", 0, "prefix", 6, 10, 10, 0.6, 0.6, 6 / 14, 0.6)], "side_a string, col_a int, side_b string, col_b int, view string, shared long, size_a long, size_b long, coverage_a double, coverage_b double, jaccard double, overlap_ratio double")
    numeric = spark.createDataFrame([(0, 0, 0.7), (1, 0, 0.0)], "col_a int, col_b int, numeric double")
    sizes = spark.createDataFrame([("A", 0, "raw", 10), ("A", 1, "raw", 3), ("B", 0, "raw", 10)], "side string, col_idx int, view string, size long")
    got = {r.col_a: r.reasons for r in overlap.value_similarity(over, numeric, sizes).collect()}
    assert got == {0: ["High normalized value overlap", "Numeric distribution appears aligned"], 1: ["Low distinct value volume; confidence reduced"]}
    kinds = spark.createDataFrame([("date", "date"), ("date", "datetime"), ("unknown", "date"), ("date", "amount")], "a string, b string").select(types.compatibility_reason(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r.r for r in kinds] == ["Inferred types are identical", "Inferred financial types are compatible", "One side has uncertain type inference", "Inferred types appear incompatible"]


def test_duplicates_carry_names_and_reason(spark):
    columns = "side string, col_idx int, col_id string, original_name string, observed_type string, uniqueness_ratio double, alignment double, null_ratio double"
    checked = spark.createDataFrame([("A", 0, "A_1", "Amount", "amount", 0.9, 100.0, 0.0), ("A", 1, "A_2", "Account", "amount", 0.9, 15.0, 0.0), ("B", 0, "B_1", "x", "date", 0.9, 45.0, 0.0), ("B", 1, "B_2", "y", "date", 0.9, 45.0, 0.0)], columns)
    near = spark.createDataFrame([("A", 0, 1), ("B", 0, 1)], "side string, a int, b int")
    got = sorted(tuple(r) for r in duplicates.duplicates(duplicates.clusters(near), checked).collect())
    assert got == [("A", 1, "A_2", "Account", 0, "A_1", "Amount", duplicates.SOURCE_REASON), ("B", 1, "B_2", "y", 0, "B_1", "x", duplicates.TARGET_REASON)]


def test_a_source_that_loses_two_targets_names_the_last(spark):
    """Targets are settled in the order in which accepted pairs first name them: buckets first, then sources, then places."""
    rows = [  # source, target, decision, confidence, place
        (0, 1, "ACCEPT_EXACT", 95, 1), (1, 1, "ACCEPT_EXACT", 90, 1), (1, 0, "ACCEPT_TRANSFORMED", 70, 2), (2, 0, "ACCEPT_TRANSFORMED", 99, 1), (3, 0, "ACCEPT_SEMANTIC", 50, 1), (3, 2, "ACCEPT_SEMANTIC", 45, 2),
    ]
    decided = spark.createDataFrame([(s, f"A_{s + 1}", f"S{s}", t, f"B_{t + 1}", f"T{t}", d, c, p, 0.0, True) for s, t, d, c, p in rows], "s_col_idx int, s_col_id string, s_original_name string, t_col_idx int, t_col_id string, t_original_name string, decision string, confidence long, place int, s_alignment double, accepted boolean")
    resolved = match.resolved(decided)
    results = spark.createDataFrame([], "source_id string, decision string")
    dups = spark.createDataFrame([], "side string, col_idx int, reason string")
    checked = spark.createDataFrame([("A", i, f"A_{i + 1}", f"S{i}") for i in range(4)], "side string, col_idx int, col_id string, original_name string")
    got = [tuple(r) for r in match.unmatched(results, dups, resolved, checked).collect()]
    # S1 loses T1 (settled first, bucket of exact pairs) and T0 (settled after it, though its column comes first); S3 keeps T2
    assert got == [("A_2", "S1", "REJECT_DUPLICATE", 70, "Weaker duplicate candidate for T0; S2 is the stronger business mapping")]


def test_texts_of_doubles_use_no_patterns(spark):
    """A pattern for zeros at the end tries each zero of a long run anew; such texts cost the square of their length."""
    df = spark.createDataFrame([(5e-324,), (-1.5e300,), (120.0,), (1e-5 / 3,)], "x double").select(melt.double_text(F.col("x")).alias("t"))
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r.t for r in df.collect()] == ["0." + "0" * 323 + "49", "-15" + "0" * 299, "120", "0.0000033333333333333337"]


def test_index_of_a_dictionary_counts_as_signatures_do(spark, monkeypatch):
    """Equal frames from bits and from signatures one by one; no table of signatures is made twice."""
    made = random.Random(4)
    texts = ["12.50", "$12.5", "0012", "12", "01/02/2024", "2024-02-01 10:00:00", "4111111111111111", "41111111xxxx1111", "POS shop a-b", "shop  AB", "swipe_x purchase abc", "N/A", None, "é pos", "2024/2/1", "3 jan 2024", "-0.0", "+.5", "a|b"]
    df = spark.createDataFrame([tuple(made.choice(texts) for _ in range(12)) for _ in range(200)], ", ".join(f"c{i} string" for i in range(12)))
    d = melt.dictionary(melt.melt(df, "A").unionByName(melt.melt(df.select("c3", "c1"), "B")))
    asked = []
    real = overlap.signatures
    want = sorted(map(tuple, overlap.overlaps(real(d)).collect()))
    monkeypatch.setattr(overlap, "signatures", lambda *x: asked.append(x) or real(*x))
    assert sorted(map(tuple, overlap.dictionary_overlaps(d).collect())) == want and not asked
    monkeypatch.setattr(overlap, "WORDS", 1)
    assert sorted(map(tuple, overlap.dictionary_overlaps(d).collect())) == want and asked
    assert overlap.dictionary_overlaps(d.limit(0)).count() == 0


def test_generated_methods_are_small_enough_to_be_compiled(spark, monkeypatch, capsys, tmp_path):
    """The JVM interprets generated methods of over 8,000 bytes: no step of the dictionary and of its index has one."""
    monkeypatch.setattr(overlap, "written", lambda df, name: plans.append(df) or df)
    df = spark.createDataFrame([(f"ORD-{i:09d}", f"$1{i}.500", f"0{i % 9 + 1}/02/2024 10:00", f"4{i:015d}") for i in range(20)], "a string, b string, c string, d string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        d = melt.dictionary(melt.melt(df, "A").unionByName(melt.melt(df, "B")))
        d.write.parquet(str(tmp_path / "d"))
        plans = [d]
        overlap.dictionary_overlaps(spark.read.parquet(str(tmp_path / "d")))
        for plan in plans:
            plan.explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert len(plans) == 2 and sizes and max(sizes) <= 8000
