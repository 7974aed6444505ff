"""The end-to-end pair of small files, with every frame held against values traced by hand."""

import json

import pytest
from pyspark.sql import functions as F

from fieldlink.operators import match, melt, overlap, profile, review
from fieldlink.plans.mapping import map_columns
from fieldlink.sources import files

#: The pair whose answers are traced by hand (fixed values).
FILE_A = """REPLACED_AMOUNT,PART_TRAN_TYPE,ACCOUNT_NUMBER,TRANSACTION_DATE_TIME,RRN,OTHER_SOURCE
1200.00,2026-03-01 10:10:00,1200.00,1234567811111111,amazon marketplace payment,alpha
35.90,2026-03-02 11:20:00,35.90,4567123499992222,coffee bean cafe purchase,beta
4500.00,2026-03-03 12:30:00,4500.00,8765432112343333,airline ticket booking,gamma
-250.00,2026-03-04 13:40:00,-250.00,1111222233334444,fuel station charge,delta
640.25,2026-03-05 14:50:00,640.25,2222333344445555,grocery mart order,epsilon
"""
FILE_B = """AMOUNT,ENTRY_DATE,CARD_NUMBER,TRAN_PARTICULAR,TRAN_DATE,VALUE_DATE,OTHER_TARGET
1200,2026-03-01,12345678xxxx1111,amazon marketplace online,2026-03-01,2026-03-01,x1
35.9,2026-03-02,45671234xxxx2222,coffee bean store,2026-03-02,2026-03-02,x2
4500.00,2026-03-03,87654321xxxx3333,airline booking portal,2026-03-03,2026-03-03,x3
-250,2026-03-04,11112222xxxx4444,fuel station pos,2026-03-04,2026-03-04,x4
640.2500,2026-03-06,22223333xxxx5555,grocery mart purchase,2026-03-05,2026-03-05,x5
"""


def read(spark, folder, name, text):
    path = folder / f"{name}.csv"
    path.write_text(text)
    return files.read_text_table(spark, f"file://{path}")


@pytest.fixture(scope="module")
def pair(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pair")
    return map_columns(read(spark, folder, "a", FILE_A), read(spark, folder, "b", FILE_B))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_types_and_trust(pair):
    got = {r.col_id: (r.observed_type, r.column_type, r.trust) for r in pair.checked.collect()}
    observed = {"A_1": "amount", "A_2": "date", "A_3": "amount", "A_4": "card_number", "A_5": "narration_text", "A_6": "generic_text", "B_1": "amount", "B_2": "date", "B_3": "masked_pan", "B_4": "narration_text", "B_5": "date", "B_6": "date", "B_7": "generic_text"}
    trust = {"A_1": "medium", "A_2": "low", "A_3": "low", "A_4": "low", "A_5": "low", "A_6": "medium", "B_1": "high", "B_2": "high", "B_3": "high", "B_4": "high", "B_5": "high", "B_6": "low", "B_7": "medium"}
    header = {"A_1": "amount", "A_2": "date", "A_3": "account_number", "A_4": "datetime", "A_5": "transaction_id", "A_6": "generic_text"}
    assert {k: v[0] for k, v in got.items()} == observed and {k: v[2] for k, v in got.items()} == trust
    assert {k: got[k][1] for k in header} == header


def test_warnings_and_duplicates(pair):
    assert rows(pair.warnings.groupBy("side", "code").count(), "side", "code", "count") == [("A", "HEADER_VALUE_INCONSISTENT", 4), ("A", "SCHEMA_SHIFT_SUSPECTED", 1), ("B", "HEADER_VALUE_INCONSISTENT", 1)]
    assert rows(pair.duplicates, "side", "col_idx", "canonical_idx") == [("A", 2, 0), ("B", 5, 4)]


def test_decisions_and_buckets(pair):
    got = {(r.s_col_id, r.t_col_id): (r.bucket, r.category, r.confidence) for r in pair.buckets.collect()}
    assert got == {("A_1", "B_1"): ("ACCEPT_EXACT", "exact", 100), ("A_2", "B_2"): ("ACCEPT_EXACT_PARTIAL", "exact", 100), ("A_4", "B_3"): ("ACCEPT_TRANSFORMED", "transformed", 38)}
    plausible = {(r.s_col_id, r.t_col_id): r.plausibility for r in pair.decisions.collect()}
    assert (plausible["A_1", "B_1"], plausible["A_2", "B_2"], plausible["A_4", "B_3"]) == (92, 70, 55)
    assert rows(pair.rejected, "s_col_id", "t_col_id", "decision", "duplicate_penalty", "rejection_reason") == [
        ("A_2", "B_5", "REJECT_WEAK", 0, "Target date column is treated as derived date-part mapping"), ("A_2", "B_6", "REJECT_DUPLICATE", 100, "Duplicate target column rejected; canonical target retained"),
        ("A_3", "B_1", "REJECT_DUPLICATE", 100, "Source column is duplicate/suspicious and not the canonical amount representative"), ("A_5", "B_4", "REJECT_WEAK", 0, "No reliable evidence found"),
        ("A_5", "B_7", "REJECT_WEAK", 0, "No reliable evidence found"), ("A_6", "B_7", "REJECT_WEAK", 0, "No reliable evidence found"),
    ]
    assert rows(pair.derived, "s_col_id", "t_col_id", "confidence") == [("A_2", "B_5", 100), ("A_2", "B_6", 100)]


def test_results_reverse_and_summary(pair):
    assert rows(pair.results, "source_id", "target_id", "category", "decision", "status") == [
        ("A_1", "B_1", "exact", "ACCEPT_EXACT", "matched"), ("A_2", "B_2", "exact", "ACCEPT_EXACT_PARTIAL", "matched"), ("A_3", None, "unmatched", "UNMATCHED", "unmatched"),
        ("A_4", "B_3", "transformed", "ACCEPT_TRANSFORMED", "unmatched"), ("A_5", None, "unmatched", "UNMATCHED", "unmatched"), ("A_6", None, "unmatched", "UNMATCHED", "unmatched"),
    ]
    assert {r.source_id: r.alternatives for r in pair.results.collect()}["A_2"] == ["B_5", "B_6"]
    assert [r for r in rows(pair.unmatched, "source_id", "decision")] == [("A_3", "UNMATCHED"), ("A_5", "UNMATCHED"), ("A_6", "UNMATCHED")]
    best = {r.target_id: (r.source_id, r.source_name) for r in pair.reverse.collect()}
    assert best == {"B_1": ("A_1", "REPLACED_AMOUNT"), "B_2": ("A_2", "PART_TRAN_TYPE"), "B_3": ("A_4", "TRANSACTION_DATE_TIME"), **{f"B_{i}": (None, None) for i in range(4, 8)}}
    assert {r.bucket: r.n for r in pair.summary.collect()} == {"TOTAL": 6, "ACCEPT_EXACT": 1, "ACCEPT_EXACT_PARTIAL": 1, "ACCEPT_STRONG_DOMAIN_MATCH": 0, "ACCEPT_TRANSFORMED": 1, "ACCEPT_SEMANTIC": 0, "DERIVED_MATCH": 2, "DUPLICATE": 2, "UNMATCHED": 3}


def test_exports_and_explanations(pair, spark, tmp_path):
    files.write_csv(pair.results, f"file://{tmp_path}/csv")
    back = spark.read.csv(f"file://{tmp_path}/csv", header=True, quote='"', escape='"')
    assert back.columns == ["sourceColumnId", "sourceColumnName", "sourceObservedType", "mappingCategory", "finalMappingDecision", "targetColumnId", "targetColumnName", "targetObservedType", "confidence", "status", "reason"]
    got = {r.sourceColumnId: r for r in back.collect()}
    assert (got["A_6"].targetObservedType, got["A_6"].confidence, got["A_6"].reason) == ("unknown", "0", "No accepted match found after strict validation")
    files.write_json(pair.results, f"file://{tmp_path}/json")
    lines = [json.loads(x) for p in (tmp_path / "json").glob("part-*") for x in p.read_text().splitlines()]
    assert {x["source_id"] for x in lines} == {f"A_{i}" for i in range(1, 7)}
    text = {r.source_id: r.explanation for r in review.explained(pair.results).collect()}
    assert text["A_6"] == "No confident candidate was found." and text["A_1"].startswith("Header score 28, Value score 10000, Type score 100, Total score 100. Reasons: High unique-set overlap")


def test_a_second_date_source_and_a_lost_conflict(spark, tmp_path):
    """Two sources of one target: the weaker loses it; each date source has its own derived dates."""
    days = [f"2026-03-{i:02d}" for i in range(1, 31)]
    a = spark.createDataFrame([(d, days[(i + 1) % 30], f"ref{i:08d}") for i, d in enumerate(days)], '`Book Date` string, `Other Date` string, `Txn Ref` string')
    b = spark.createDataFrame([(d, d[:-2] + f"{int(d[-2:]) % 30 + 1:02d}" if i < 26 else f"2025-01-{i:02d}", f"ref{i:08d}") for i, d in enumerate(days)], '`Posting Date` string, `Tran Date` string, `Transaction Id` string')
    m = map_columns(a.withColumn("Book Date", F.when(F.col("Book Date") == "2026-03-09", None).otherwise(F.col("Book Date"))), b)
    assert rows(m.resolved.where("t_col_id = 'B_1'"), "s_col_id", "wins") == [("A_1", True), ("A_2", False)]
    lost = [r for r in m.rejected.collect() if (r.s_col_id, r.t_col_id) == ("A_2", "B_1")]
    assert [(r.decision, r.category, r.duplicate_penalty, r.rejection_reason) for r in lost] == [("REJECT_DUPLICATE", "duplicate_or_suspicious", 100, "Weaker duplicate candidate for Posting Date; Book Date is the stronger business mapping")]
    result = {r.source_id: r for r in m.results.collect()}
    assert (result["A_2"].target_id, result["A_2"].category, result["A_2"].decision, result["A_2"].reason) == (None, "unmatched", "REJECT_DUPLICATE", [lost[0].rejection_reason])
    assert rows(m.derived, "s_col_id", "t_col_id") == [("A_1", "B_2"), ("A_2", "B_2")]
    assert {r.bucket: r.n for r in m.summary.collect()}["DUPLICATE"] >= 1


def test_readers_of_odd_files(spark, tmp_path):
    no_header = read(spark, tmp_path, "n", "N/A,--\n1,2\n3,4,5\n , \n6\n")
    assert no_header.columns == ["Column_1", "Column_2", "Column_3"]
    assert [tuple(r) for r in no_header.collect()] == [("N/A", "--", None), ("1", "2", None), ("3", "4", "5"), ("6", None, None)]
    header = read(spark, tmp_path, "h", 'x,x,x 2,"q ""r"""\n1,2,3,"a,b"\n')
    assert header.columns == ["x", "x 2", "x 2 2", 'q "r"'] and [tuple(r) for r in header.collect()] == [("1", "2", "3", "a,b")]
    assert melt.safe_names(["x", "x 2", "x", "", "x"]) == ["x", "x 2", "x 3", "column 4", "x 4"]
    names = melt.columns(spark.createDataFrame([], "`Txn Ref` string, txn_ref string, `txn ref 2` string"), "A").collect()
    assert [r.safe_name for r in names] == ["transaction reference", "transaction reference 2", "transaction reference 2 2"]


def test_hints_need_whole_numbers_and_words(spark):
    df = spark.createDataFrame([("ab-12", "7", "abc")], "a string, b string, c string")
    d = melt.dictionary(melt.melt(df, "A"))
    got = {r.col_idx: r.pattern_hints for r in profile.hints(profile.profile(d), profile.first_distinct(d)).collect()}
    assert got == {0: ["mostly_unique"], 1: ["mostly_unique", "contains_numeric"], 2: ["mostly_unique", "contains_text"]}


def test_views_on_demand_are_those_of_all_views(spark):
    df = spark.createDataFrame([(f"{i:03d}", f"4{i:015d}", f"01/0{i % 9 + 1}/2026 10:00") for i in range(20)], "a string, b string, c string")
    d = melt.dictionary(melt.melt(df, "A"))
    every = overlap.signatures(d)
    for views in (("raw",), ("pan", "date"), ("token", "amount")):
        assert rows(overlap.signatures(d, views), "col_idx", "view", "sig") == rows(every.where(F.col("view").isin(*views)), "col_idx", "view", "sig")


def test_labels_and_feedback(spark):
    assert [r[0] for r in spark.createDataFrame([(100,), (60,), (45,), (39,)], "c int").select(match.rounded(F.col("c")), review.confidence_label(F.col("c")).alias("l")).select("l").collect()] == ["Strong", "Medium", "Weak", "Low"]
    log = spark.createDataFrame([("a", 1, "correct"), ("a", 2, "incorrect"), ("b", 1, "correct")], "source_id string, updated_at int, verdict string")
    assert rows(review.latest(log), "source_id", "verdict") == [("a", "incorrect"), ("b", "correct")]


def test_large_frames_are_tables(spark, tmp_path, monkeypatch):
    """Frames of more rows than later plans hold are written; the mapping is the same."""
    from fieldlink.sources import shared

    a, b = read(spark, tmp_path, "a", FILE_A), read(spark, tmp_path, "b", FILE_B)
    kept = map_columns(a, b)
    monkeypatch.setattr(shared, "SMALL", 0)
    tables = map_columns(a, b)
    for name in ("checked", "duplicates", "decisions", "results", "unmatched", "summary"):
        assert rows(getattr(kept, name), "*") == rows(getattr(tables, name), "*") if name == "summary" else sorted(map(str, getattr(kept, name).collect())) == sorted(map(str, getattr(tables, name).collect()))
