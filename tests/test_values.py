import pytest
from pyspark.sql import functions as F

from fieldlink.functions import headers as H
from fieldlink.functions import values as V

CASES = [
    (V.amount, "$01,200.5000", "1200.5"), (V.amount, "-00035.90", "-35.9"), (V.amount, "+", "0"), (V.amount, "-0.00", "-0"), (V.amount, ".5", "0.5"), (V.amount, "1200.", "1200."),
    (V.date, "01/03/2026", "2026-03-01"), (V.date, "99/99/2026", "2026-99-99"), (V.date, "TRX001", None), (V.date, "3 Mar 2026", "2026-03-03"), (V.date, "12.5", None),
    (V.cell, "2026-03-01", "2026-03-01"), (V.cell, "0001234567890123", "0001234567890123"), (V.cell, "N/A", None), (V.cell, "--", None), (V.cell, "Nil", None), (V.cell, "1234 5678 9012", "123456789012"), (V.cell, "APPROVED", "approved"), (V.cell, "007", "7"), (V.cell, None, None),
    (V.date_part, "2026-03-01T10:22:33", "2026-03-01"), (V.date_part, "01/03/2026 10:22", "2026-03-01"),
    (V.card_fingerprint, "1234567812341111", "123456781111"), (V.card_fingerprint, "12345678xxxx1111", "123456781111"), (V.card_fingerprint, "abc", None),
    (V.zero_stripped, "000123400", "123400"), (V.zero_stripped, "AB-001", "ab-001"),
    (H.normalize, "Txn_Ref No.", "transaction reference number"), (H.normalize, "AuthorizedAmount", "authorized amount"),
]


def test_scalars(spark):
    row = spark.range(1).select(*(f(F.lit(x).cast("string")).alias(f"c{i}") for i, (f, x, _) in enumerate(CASES))).first()
    assert [(f.__name__, x, got) for (f, x, _), got in zip(CASES, row)] == [(f.__name__, x, want) for f, x, want in CASES]


def test_staged_cell_is_cell(spark):
    raw = spark.createDataFrame([(x,) for f, x, _ in CASES if f is V.cell or f is V.amount], "raw string")
    rows = V.with_cell(raw, "raw", "a").withColumn("b", V.cell(F.col("raw"))).collect()
    assert all(r.a == r.b for r in rows)


@pytest.mark.parametrize("text,sep", [("a,b\n1,2\n", ","), ("a|b;c\n1|2\n", "|"), ("a\tb\n", "\t")])
def test_delimiter(spark, tmp_path, text, sep):
    from fieldlink.sources import files

    path = tmp_path / "x.csv"
    path.write_text(text)
    assert files.detect_delimiter(spark, f"file://{path}") == sep


def test_read_text_table(spark, tmp_path):
    from fieldlink.sources import files

    path = tmp_path / "x.csv"
    path.write_text('Txn Ref,Amount,N/A\nT1,"1,200.50",x\n , ,\nT2,3,\n')
    df = files.read_text_table(spark, f"file://{path}")
    assert df.columns == ["Txn Ref", "Amount", "Column_3"]
    assert [tuple(r) for r in df.collect()] == [("T1", "1,200.50", "x"), ("T2", "3", None)]


def odd_texts(n: int = 3000) -> list[str]:
    """Texts of parts that steps tell apart: letters, digits, marks, currencies, spaces and ends of lines of all kinds."""
    import random

    made = random.Random(7)
    parts = ["a", "B", "xx", "07", "5", "12345678", "0001234567", "4777777712345678", ".", ",", "-", "--", "_", "/", " ", "  ", "|", "\t", "\n", "\r", " ", "\u0085", "$", "₹", "*", "#", "+", "é", "İ", "jan ", "2026-03-01", "01/02/26", "T10:22", "pos", "atm ", "txn", "n/a", "null"]
    return ["".join(made.choice(parts) for _ in range(made.randint(1, 6))) for _ in range(n)]


def test_steps_are_the_plain_forms(spark):
    raw = spark.createDataFrame([(x,) for x in odd_texts()], "raw string")
    cells = V.with_cell(raw, "raw", "a").withColumn("b", V.cell(F.col("raw")))
    assert [r for r in cells.where("not a <=> b").collect()] == []
    v = F.col("a")
    views = V.signature_views(cells.where("a is not null").select("a"), "a", ("raw", "date", "amount", "pan", "padded", "prefix"))
    plain = {"date": V.date_part(v), "amount": V.amount(v), "pan": V.card_fingerprint(v), "padded": V.zero_stripped(v), "prefix": F.substring(v, 1, 3)}
    for name, c in plain.items():
        assert [r for r in views.where(v == V.trimmed(v)).where(~F.col(f"v_{name}").eqNullSafe(c)).collect()] == [], name
    assert [r for r in cells.where(V.is_token(v) & (F.array(v) != V.tokens(v))).collect()] == []
    assert cells.where(V.is_token(v)).count() > 0


def test_profile_by_shapes(spark):
    from fieldlink.operators import profile

    v = F.col("value")
    kinds = V.predicates(v) | {"integer": v.rlike(r"^[-+]?\d+$"), "decimal": v.rlike(r"^[-+]?\d*\.\d+$"), "date_like": v.rlike(r"\d{2,4}[/-]\d{1,2}[/-]\d{1,2}"), "uppercase": v == F.upper(v), "masked_like": v.rlike("[*xX#]")}
    d = spark.createDataFrame([("A", 0, x, i % 7 + 1, i) for i, x in enumerate(dict.fromkeys([None, "01", "09", "13", "12 ", "13 ", *odd_texts(500)]))], "side string, col_idx int, value string, cnt long, first_pos long")
    got = profile.profile(d).first()
    n = F.sum(F.when(v.isNotNull(), F.col("cnt")))
    want = d.agg(F.count("value").alias("n_distinct"), n.alias("n_values"), F.sum("cnt").alias("n_rows"), (F.max(F.when(v.isNotNull(), F.col("cnt"))) / n).alias("top_share"), (F.sum(F.length(v) * F.col("cnt")) / n).alias("avg_length"), F.max(F.length(v)).alias("max_length"), *((F.sum(F.when(c, F.col("cnt")).otherwise(0)) / n).alias(f"r_{k}") for k, c in kinds.items())).first().asDict()
    assert {k: got[k] for k in want} == want
    # numbers of as many digits are one shape, whatever their digits
    many = spark.range(100_000, 101_000).select(F.lit("A").alias("side"), F.lit(0).alias("col_idx"), F.col("id").cast("string").alias("value"), F.lit(1).cast("long").alias("cnt"))
    assert [(r.value, r.n) for r in profile.shapes(many).collect()] == [("000000", 1000)]
