"""Cell values: normal forms, signatures and classes. All are Column expressions.

White space and digits are ASCII, lengths are code points. Session time zone: UTC.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that mean no value (fixed values).
NULL_WORDS = ["", "null", "nil", "none", "na", "n/a", "-", "--", "undefined"]
#: Words that say nothing about a narration (fixed values).
TOKEN_STOP_WORDS = "pos swipe atm cash others swt purchase transaction txn entry date time timestamp withdrawal oth live normaltrx normal_trx".split()
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
#: A plain number (fixed value).
NUMBER = r"^[-+]?\d+(\.\d+)?$"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\x0c\r"))


def null_like(c: Column) -> Column:
    """Trimmed, or null for a text that means no value."""
    t = trimmed(c)
    return F.when(~F.lower(t).isin(NULL_WORDS), t)


def has_value(c: Column) -> Column:
    """Whether null_like() isn't null, without a regular expression."""
    return F.coalesce(~F.lower(F.btrim(c, F.lit(" \t\n\x0b\x0c\r"))).isin(NULL_WORDS), F.lit(False))


def compact_id(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s|]+", "")


def _bare(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, "[₹$€£¥,]", ""))


def _amount_of(bare: Column, other: Column) -> Column:
    """Canonical form of a bare amount; `other` where it is none."""
    digits = F.ltrim(bare, F.lit("+-"))
    whole = F.ltrim(F.substring_index(digits, ".", 1), F.lit("0"))
    part = F.when(digits.contains("."), F.rtrim(F.substring_index(digits, ".", -1), F.lit("0")))
    made = F.concat(F.when(bare.startswith("-"), "-").otherwise(""), F.coalesce(F.nullif(whole, F.lit("")), F.lit("0")), F.coalesce(F.concat(F.lit("."), F.nullif(part, F.lit(""))), F.lit("")))
    return F.when(bare.rlike(r"^[-+]?\d*(\.\d+)?$") & (bare != ""), made).otherwise(other)


def amount(c: Column) -> Column:
    """Canonical amount: no signs of currency, thousands or padding; other texts in lower case."""
    return _amount_of(_bare(c), F.lower(trimmed(c)))


#: How every text begins that _day_first() or _general() reads.
DATE_START = r"^(\d{1,4}[/ -]|[A-Za-z]{3} \d)"


def _day_first(t: Column, pattern: str) -> Column:
    """ISO text of a leading day/month/year; parts are not checked for range."""
    g = lambda i: F.regexp_extract(t, pattern, i)
    year = F.when(F.length(g(3)) == 2, F.concat(F.lit("20"), g(3))).otherwise(g(3))
    return F.when(t.rlike(pattern), F.concat(year, F.lit("-"), F.lpad(g(2), 2, "0"), F.lit("-"), F.lpad(g(1), 2, "0")))


def _general(t: Column) -> Column:
    """ISO date of the accepted year-first and month-name formats."""
    checked = lambda x: F.date_format(x.try_cast("date"), "yyyy-MM-dd")
    iso = r"^(\d{4}-\d{2}-\d{2})([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"
    zoned = r"(?i)^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[-+]\d{2}:\d{2})$"
    slashed = r"^(\d{4})/(\d{1,2})/(\d{1,2})$"
    named, named_first = r"(?i)^(\d{1,2}) ([a-z]{3}) (\d{4})$", r"(?i)^([a-z]{3}) (\d{1,2}), (\d{4})$"
    x = lambda p, i: F.regexp_extract(t, p, i)
    month = lambda m: F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(m)).cast("string"), 2, "0")
    joined = lambda y, m, d: checked(F.concat(y, F.lit("-"), m, F.lit("-"), F.lpad(d, 2, "0")))
    return (
        F.when(t.rlike(iso), checked(F.substring(t, 1, 10)))
        .when(t.rlike(zoned), F.date_format(t.try_cast("timestamp"), "yyyy-MM-dd"))
        .when(t.rlike(slashed), joined(x(slashed, 1), F.lpad(x(slashed, 2), 2, "0"), x(slashed, 3)))
        .when(t.rlike(named), joined(x(named, 3), month(x(named, 2)), x(named, 1)))
        .when(t.rlike(named_first), joined(x(named_first, 3), month(x(named_first, 1)), x(named_first, 2)))
    )


def _date_of(t: Column) -> Column:
    return F.when(t.rlike(DATE_START) & ~t.rlike(NUMBER), F.coalesce(_day_first(t, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})$"), _general(t)))


def date(c: Column) -> Column:
    """ISO date, or null for what is no date; plain numbers aren't."""
    return _date_of(trimmed(c))


def _text_of(low: Column) -> Column:
    """text() of a trimmed text in lower case; most have nothing to replace."""
    return F.when(low.rlike(r"[\s\-_/]{2}|[\t\n\x0b\f\r]"), F.regexp_replace(F.regexp_replace(low, r"[\s\-_/]{2,}", " "), r"\s+", " ")).otherwise(low)


def text(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(trimmed(F.lower(c)), r"[\s\-_/]{2,}", " "), r"\s+", " ")


def parted(df: DataFrame) -> DataFrame:
    """df, whose later steps get a generated method of their own: the JVM compiles none of over 8,000 bytes and interprets it row by row. No partitions are merged and none is moved."""
    return df.coalesce(1 << 20)


def cell(c: Column) -> Column:
    """The normal form by which cells are compared."""
    base = null_like(c)
    short = compact_id(base)
    code = ~base.rlike(r"\s") & short.rlike(r"^[A-Za-z0-9\-*#]{8,}$") & short.rlike("[A-Za-z]")
    day, money = date(base), amount(base)
    return F.when(base.isNull(), None).when(short.rlike(r"^\d{10,}$"), short).when(code, F.lower(short)).when(day.isNotNull(), day).when(money != F.lower(trimmed(base)), money).otherwise(text(base))


def with_cell(df: DataFrame, raw: str, name: str) -> DataFrame:
    """df with cell(raw) as `name`, in steps: each part is a column that later ones refer to, so plans stay small.

    Codes and long numbers are settled first; what is left for a later step is null for them, and texts with letters
    go by no step for numbers.
    """
    step = df.withColumn("_base", null_like(F.col(raw)))
    base = F.col("_base")
    code_like, lettered = r"^[A-Za-z0-9\-*#]{8,}$", F.col("_lettered")
    step = step.withColumn("_lettered", base.rlike("[A-Za-z]"))
    settled = F.when((F.length(base) >= 8) & base.rlike(code_like), F.when(lettered, F.lower(base)).when(base.rlike(r"^\d{10,}$"), base))
    step = step.withColumn("_settled", settled).withColumn("_rest", F.when(F.col("_settled").isNull(), base))
    rest, short, low = F.col("_rest"), F.col("_short"), F.col("_low")
    step = step.withColumn("_low", F.lower(rest)).withColumn("_short", F.when(~(lettered & rest.contains(" ")), compact_id(rest))).withColumn("_bare", F.when(~lettered, _bare(rest)))
    step = parted(step).withColumn("_day", _date_of(rest)).withColumn("_money", _amount_of(F.col("_bare"), low))
    code = lettered & short.rlike(code_like) & ~rest.rlike(r"\s")
    chosen = F.when(rest.isNull(), F.col("_settled")).when(~lettered & short.rlike(r"^\d{10,}$"), short).when(code, F.lower(short)).when(F.col("_day").isNotNull(), F.col("_day")).when(F.col("_money") != low, F.col("_money")).otherwise(_text_of(low))
    # explode(array(x)): a filter on x isn't pushed below, which would write all steps out into it
    return step.select(*(f"`{c}`" for c in df.columns if c != name), F.explode(F.array(chosen)).alias(name))


def _date_part_of(t: Column) -> Column:
    found = F.coalesce(_day_first(t, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})"), _general(t), F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2})[Tt\s].*$", "$1"))
    return F.when(~t.rlike(DATE_START) | t.rlike(NUMBER) | t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).otherwise(found)


def date_part(c: Column) -> Column:
    """Date signature: numbers and ISO dates as they are, dates and times as ISO date, other texts trimmed."""
    return _date_part_of(trimmed(c))


def _spaced(c: Column) -> Column:
    """Whether compact_id() changes c, without a regular expression."""
    return reduce(lambda a, b: a | b, (c.contains(x) for x in " |\t\n\x0b\x0c\r"))


def signature_views(df: DataFrame, value: str, views: tuple[str, ...]) -> DataFrame:
    """df with those of v_raw, v_date, v_amount, v_pan, v_padded, v_prefix that views names, of a normal value, which has no space at its ends."""
    v, low, lettered, short = F.col(value), F.col("_low"), F.col("_lettered"), F.coalesce("_short", F.col(value))
    step = df.withColumn("_low", F.lower(v)).withColumn("_lettered", v.rlike("[A-Za-z]")) if {"amount", "padded"} & {*views} else df
    step = step.withColumn("_bare", F.when(~lettered, _bare(v))) if "amount" in views else step
    step = step.withColumn("_short", F.when(_spaced(v), compact_id(v))) if "padded" in views else step
    step = step.withColumn("_digits", _digits_of_card(v)) if "pan" in views else step
    made = {
        "raw": lambda: v, "date": lambda: _date_part_of(v), "amount": lambda: _amount_of(F.col("_bare"), low), "pan": lambda: _card_of(F.col("_digits")), "prefix": lambda: F.substring(v, 1, 3),
        "padded": lambda: F.when(~lettered & short.rlike(r"^\d+$"), F.regexp_replace(short, r"^0+(\d)", "$1")).when(F.col("_short").isNotNull(), F.lower("_short")).otherwise(low),
    }
    if "date" in views:
        step = parted(step).withColumn("v_date", made.pop("date")())
    return parted(step).select(*df.columns, *(["v_date"] if "date" in views else []), *(f().alias(f"v_{k}") for k, f in made.items() if k in views))


def zero_stripped(c: Column) -> Column:
    short = compact_id(c)
    return F.when(short.rlike(r"^\d+$"), F.regexp_replace(short, r"^0+(\d)", "$1")).otherwise(F.lower(short))


def _digits_of_card(c: Column) -> Column:
    return F.when(F.length(c) >= 10, F.regexp_replace(c, r"\D+", ""))


def _card_of(digits: Column) -> Column:
    joined = lambda k: F.concat(F.substring(digits, 1, k), F.right(digits, F.lit(4)))
    return F.when(F.length(digits) >= 12, joined(8)).when(F.length(digits) >= 10, joined(6))


def card_fingerprint(c: Column) -> Column:
    """First and last digits of a card number, whole or masked (either has ten digits or more); null for other texts."""
    return _card_of(_digits_of_card(c))


def is_token(c: Column) -> Column:
    """Whether tokens() of c are c alone, as they are of one plain word; never so for a text of which they aren't."""
    return c.rlike(r"^[a-z0-9]{3,}\z") & ~c.isin(TOKEN_STOP_WORDS)


def tokens(c: Column) -> Column:
    """Distinct words of three or more characters, without the stop words."""
    low = F.lower(c)
    some = reduce(lambda a, b: a | b, (low.contains(w) for w in TOKEN_STOP_WORDS if not any(o != w and o in w for o in TOKEN_STOP_WORDS)))
    bare = F.when(some, F.regexp_replace(low, r"\b(" + "|".join(TOKEN_STOP_WORDS) + r")\b", " ")).otherwise(low)
    return F.array_distinct(F.regexp_extract_all(bare, F.lit("([a-z0-9]{3,})"), F.lit(1)))


def format_class(c: Column) -> Column:
    """A text's format by patterns (fixed values), first hit wins."""
    return F.when(c.rlike(r"^\d{1,3}(,\d{3})*(\.\d+)?$"), "comma-number").when(c.rlike(r"^\d+\.\d+$"), "decimal").when(c.rlike(r"^[₹$€£¥]\d+"), "currency").when(c.rlike(r"^\d{2,4}[/-]\d{1,2}[/-]\d{1,2}"), "date").otherwise("other")


def type_class(c: Column) -> Column:
    """A text's kind by patterns (fixed values), first hit wins."""
    return F.when(c.rlike(r"^\d+(\.\d+)?$"), "number").when(c.rlike(r"^\d{2,4}[/-]\d{1,2}[/-]\d{1,2}"), "date").when(trimmed(c) == "", "blank").otherwise("text")


def is_dirty(c: Column) -> Column:
    """Whether a text has one of a set of characters (fixed values), or letters of both cases."""
    return c.rlike(r"""[\s,₹$€£¥()/\[\]{}#@!%^&*_=+|;:'"<>?]""") | (c.rlike("[A-Z]") & (c != F.upper(c)))


def predicates(c: Column) -> dict[str, Column]:
    """What a normal value may be, by name; the patterns are fixed values."""
    masked = c.rlike(r"^(\d{4,8})[xX*#-]{2,}(\d{2,6})$")
    digits = F.length(F.regexp_replace(c, r"\D", ""))
    return {
        "date": c.rlike(r"^\d{4}-\d{2}-\d{2}$"),
        "datetime": c.rlike(r"^\d{4}-\d{2}-\d{2}[Tt\s]\d{2}:\d{2}(:\d{2})?"),
        "numeric": c.rlike(NUMBER),
        "amount": F.regexp_replace(c, r"[₹$€£¥,\s]", "").rlike(r"^[-+]?\d+(\.\d{1,4})?$"),
        "currency": F.upper(c).rlike("^[A-Z]{3}$"),
        "card": c.rlike(r"^(?:\d[\s-]*){13,19}$") | masked,
        "masked": masked,
        "masked_run": masked | (c.rlike(r"\*{2,}|[xX]{2,}") & c.rlike(r"\d{2,}")),
        "drcr": c.rlike("(?i)^(dr|cr|debit|credit|d|c)$"),
        "status": c.rlike("(?i)^(approved|declined|failed|pending|success|error|reversed|00|01|05|09|12)$"),
        "account": (digits >= 8) & (digits <= 18) & ~masked,
        "txn_id": c.rlike(r"^[A-Za-z0-9\-_/]{8,}$") & c.rlike("[A-Za-z]"),
        "text": c.rlike("[A-Za-z]"),
        "long_text": c.rlike(r"\S\s+\S") | (F.length(c) >= 15),
        "long_id": c.rlike(r"^[A-Za-z0-9\-]{8,}$"),
        "spaced": (F.length(c) > 12) & c.contains(" "),
    }
