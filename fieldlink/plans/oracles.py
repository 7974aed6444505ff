"""DuckDB forms of the registered queries, with all fixed values written out here.

Functions take a SQL expression of a text and give one of its normal form.
"""

from __future__ import annotations

NULL_WORDS = "'', 'null', 'nil', 'none', 'na', 'n/a', '-', '--', 'undefined'"
NUMBER = r"^[-+]?\d+(\.\d+)?$"
STOP = "pos|swipe|atm|cash|others|swt|purchase|transaction|txn|entry|date|time|timestamp|withdrawal|oth|live|normaltrx|normal_trx"
SHAPES = "['Txn_Ref No.', 'AuthorizedAmount', 'Posting Date', 'cardNumber', 'Acct-No', 'value date', 'Merchant Desc', 'status_code']"
ABBREVIATIONS = "MAP {'txn': 'transaction', 'ref': 'reference', 'no': 'number', 'num': 'number', 'amt': 'amount', 'dr': 'debit', 'cr': 'credit', 'ccy': 'currency', 'curr': 'currency', 'acct': 'account', 'a': 'account', 'desc': 'description', 'dt': 'date', 'ts': 'timestamp'}"
MASKED = r"^(\d{4,8})[xX*#-]{2,}(\d{2,6})$"
DERIVED = r"tran[_\s-]?date|value[_\s-]?date"

def _sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def _trim(x: str) -> str:
    return _sub(x, r"^\s+|\s+$")


def _null_like(x: str) -> str:
    return f"CASE WHEN lower({_trim(x)}) NOT IN ({NULL_WORDS}) THEN {_trim(x)} END"


def _compact(x: str) -> str:
    return _sub(x, r"[\s|]+")


def _amount(x: str) -> str:
    bare = _trim(_sub(x, "[₹$€£¥,]"))
    digits = f"regexp_replace({bare}, '^[-+]', '')"
    whole = f"coalesce(nullif(ltrim(regexp_extract({digits}, '^(\\d*)', 1), '0'), ''), '0')"
    part = f"rtrim(regexp_extract({digits}, '\\.(\\d+)$', 1), '0')"
    return f"CASE WHEN regexp_matches({bare}, '^[-+]?\\d*(\\.\\d+)?$') AND {bare} <> '' THEN CASE WHEN {bare} LIKE '-%' THEN '-' ELSE '' END || {whole} || CASE WHEN {part} <> '' THEN '.' || {part} ELSE '' END ELSE lower({_trim(x)}) END"


def _text(x: str) -> str:
    return _sub(_sub(_trim(f"lower({x})"), r"[\s\-_/]{2,}", " "), r"\s+", " ")


def _day_first(x: str, end: str) -> str:
    p = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})" + end
    g = lambda i: f"regexp_extract({_trim(x)}, '{p}', {i})"
    return f"CASE WHEN regexp_matches({_trim(x)}, '{p}') THEN CASE WHEN length({g(3)}) = 2 THEN '20' ELSE '' END || {g(3)} || '-' || lpad({g(2)}, 2, '0') || '-' || lpad({g(1)}, 2, '0') END"


def _year_first(x: str) -> str:
    """Of the general formats those that the oracle's data have."""
    p = r"^(\d{4})/(\d{1,2})/(\d{1,2})$"
    g = lambda i: f"regexp_extract({_trim(x)}, '{p}', {i})"
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"
    return f"CASE WHEN regexp_matches({_trim(x)}, '{p}') THEN {g(1)} || '-' || lpad({g(2)}, 2, '0') || '-' || lpad({g(3)}, 2, '0') WHEN regexp_matches({_trim(x)}, '{iso}') THEN substr({_trim(x)}, 1, 10) END"


def _date(x: str) -> str:
    return f"CASE WHEN NOT regexp_matches({_trim(x)}, '{NUMBER}') THEN coalesce({_day_first(x, '$')}, {_year_first(x)}) END"


def _date_part(x: str) -> str:
    return f"CASE WHEN regexp_matches({_trim(x)}, '{NUMBER}') THEN {_trim(x)} ELSE coalesce({_day_first(x, '')}, {_year_first(x)}, {_trim(x)}) END"


def _cell(x: str) -> str:
    return (
        f"CASE WHEN {_null_like(x)} IS NULL THEN NULL WHEN regexp_matches({_compact(x)}, '^\\d{{10,}}$') THEN {_compact(x)}"
        f" WHEN NOT regexp_matches({_trim(x)}, '\\s') AND regexp_matches({_compact(x)}, '^[A-Za-z0-9\\-*#]{{8,}}$') AND regexp_matches({_compact(x)}, '[A-Za-z]') THEN lower({_compact(x)})"
        f" WHEN {_date(x)} IS NOT NULL THEN {_date(x)} WHEN {_amount(x)} <> lower({_trim(x)}) THEN {_amount(x)} ELSE {_text(x)} END"
    )


def _stripped(x: str) -> str:
    return f"CASE WHEN regexp_matches({_compact(x)}, '^\\d+$') THEN regexp_replace({_compact(x)}, '^0+(\\d)', '\\1') ELSE lower({_compact(x)}) END"


def _pan(x: str) -> str:
    d, m = _sub(x, r"\D"), r"^(\d{6,8})[*xX#-]+(\d{4})$"
    return f"CASE WHEN length({d}) >= 12 THEN substr({d}, 1, 8) || right({d}, 4) WHEN length({d}) >= 10 THEN substr({d}, 1, 6) || right({d}, 4) WHEN regexp_matches({_compact(x)}, '{m}') THEN regexp_extract({_compact(x)}, '{m}', 1) || regexp_extract({_compact(x)}, '{m}', 2) END"


NOISY = """noisy AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'N/A' WHEN 1 THEN '$' || p || '00' WHEN 2 THEN '-00' || p WHEN 3 THEN lpad(o_orderkey::VARCHAR, 12, '0')
  WHEN 4 THEN ' ORD-' || lpad(o_orderkey::VARCHAR, 9, '0') WHEN 5 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 6 THEN strftime(o_orderdate, '%Y/%-m/%-d')
  WHEN 7 THEN lpad(o_orderkey::VARCHAR, 8, '4') || 'xxxx' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') ELSE o_orderpriority || ' -- ' || o_orderstatus END AS raw
  FROM (SELECT *, o_totalprice::DECIMAL(18,2)::VARCHAR AS p FROM orders))"""


def _double(x: str) -> str:
    """The shortest text of a double, its point moved by the exponent."""
    v = f"abs({x})::VARCHAR"
    whole, part = f"regexp_extract({v}, '^(\\d+)', 1)", f"regexp_extract({v}, '\\.(\\d+)', 1)"
    digits, at = f"({whole} || {part})", f"(length({whole}) + coalesce(try_cast(regexp_extract({v}, 'e([-+]?\\d+)$', 1) AS INT), 0))"
    moved = f"CASE WHEN {at} <= 0 THEN '0.' || repeat('0', -{at}) || rtrim({digits}, '0') WHEN {at} >= length({digits}) THEN {digits} || repeat('0', {at} - length({digits})) ELSE substr({digits}, 1, {at}) || '.' || rtrim(substr({digits}, {at} + 1), '0') END"
    return f"CASE WHEN {x} < 0 THEN '-' ELSE '' END || CASE WHEN contains({v}, 'e') THEN {moved} ELSE regexp_replace({v}, '\\.0$', '') END"


def _as_text(name: str, kind: str) -> str:
    if kind == "double":
        return _double(name)
    return f"CASE WHEN {name} = date_trunc('day', {name}) THEN strftime({name}, '%Y-%m-%d') ELSE strftime({name}, '%Y-%m-%d %H:%M:%S') END" if kind == "ts" else f"{name}::VARCHAR"


TABLES = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal:double", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal:double"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice:double", "o_orderdate:ts", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity:double", "l_extendedprice:double", "l_discount:double", "l_tax:double", "l_returnflag", "l_linestatus", "l_shipdate:ts"],
}


def _dict(name: str, out: str) -> str:
    """Common table expression `out` (col_idx, value, cnt) of a table."""
    cells = " UNION ALL ".join(f"SELECT {i} AS col_idx, {_as_text(c.split(':')[0], c.partition(':')[2])} AS raw FROM {name}" for i, c in enumerate(TABLES[name]))
    return f"{out} AS (SELECT col_idx, {_cell('raw')} AS value, sum(cnt)::BIGINT AS cnt FROM (SELECT col_idx, raw, count(*) AS cnt FROM ({cells}) GROUP BY ALL) GROUP BY ALL)"


def _views(d: str, views: str = "raw date amount pan padded prefix token", key: str = "col_idx") -> str:
    """(key, view, sig), distinct, of a dictionary's values."""
    x = "value"
    sig = {"raw": x, "date": _date_part(x), "amount": _amount(x), "pan": _pan(x), "padded": _stripped(x), "prefix": f"substr({x}, 1, 3)", "token": f"unnest({_tokens_of_value(x)})"}
    return " UNION ".join(f"SELECT DISTINCT {key}, '{v}' AS view, {sig[v]} AS sig FROM {d} WHERE value IS NOT NULL" for v in views.split())


def _tokens_of_value(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({x}), '\\b({STOP})\\b', ' ', 'g'), '[^a-z0-9]+'), lambda t: length(t) >= 3))"


def _over() -> str:
    return f"""{_dict("orders", "da")}, {_dict("lineitem", "db")}, sa AS (SELECT * FROM ({_views("da")}) WHERE sig IS NOT NULL), sb AS (SELECT * FROM ({_views("db")}) WHERE sig IS NOT NULL),
na AS (SELECT col_idx, view, count(*) AS n FROM sa GROUP BY ALL), nb AS (SELECT col_idx, view, count(*) AS n FROM sb GROUP BY ALL),
o AS (SELECT s.col_a, s.col_b, s.view, shared, na.n AS size_a, nb.n AS size_b FROM (SELECT sa.col_idx AS col_a, sb.col_idx AS col_b, sa.view, count(*) AS shared FROM sa JOIN sb USING (view, sig) GROUP BY ALL) s
  JOIN na ON na.col_idx = col_a AND na.view = s.view JOIN nb ON nb.col_idx = col_b AND nb.view = s.view)"""


def _tokens(x: str) -> str:
    """Tokens of a header."""
    return f"list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_.\\-/\\s]+'), lambda t: regexp_replace(lower(t), '[^a-z0-9]', '', 'g')), lambda t: t <> ''), lambda t: coalesce({ABBREVIATIONS}[t], t)), lambda t: t NOT IN ('column', 'field', 'value'))"


def _expected(x: str) -> str:
    """Type that a header makes expect."""
    return f"""CASE WHEN regexp_matches(lower({x}), 'amount|amt|value') THEN 'amount' WHEN regexp_matches(lower({x}), 'date|datetime|timestamp|time') THEN 'datetime'
 WHEN regexp_matches(lower({x}), 'part[_\\s-]?tran[_\\s-]?type|tran[_\\s-]?type|debit[_\\s-]?credit|drcr') THEN 'debit_credit' WHEN regexp_matches(lower({x}), 'account|acct|iban') THEN 'account_number'
 WHEN regexp_matches(lower({x}), 'card|pan') THEN 'card_number' WHEN regexp_matches(lower({x}), 'rrn|stan|trace|ref|transaction id|txn id') THEN 'transaction_id'
 WHEN regexp_matches(lower({x}), 'narration|description|merchant|particular') THEN 'narration_text' WHEN regexp_matches(lower({x}), 'currency|ccy|curr') THEN 'currency' WHEN regexp_matches(lower({x}), 'status|response') THEN 'status_code' ELSE 'unknown' END"""


#: Normalized terms of the synonym groups, in the order of the groups.
GROUPS = [
    ("transaction_id", "transaction reference|transaction id|trace id|stan|rrn|reference number|transaction identifier"), ("reference_number", "reference|reference number|retrieval reference"),
    ("amount", "amount|transaction amount|auth amount|clearing amount|posted amount"), ("debit_amount", "debit|withdrawal|debit amount"), ("credit_amount", "credit|deposit|credit amount"),
    ("currency", "currency|currency code"), ("date", "transaction date|date|posting date|settlement date|book date"), ("datetime", "transaction datetime|timestamp|transaction timestamp"),
    ("account_number", "account|account c|account number|iban"), ("masked_pan", "masked pan|card|card number|pan"), ("merchant_name", "merchant|merchant name|acceptor name"), ("narration", "narration|description|remarks|details"),
    ("status_code", "status|status code|response code"), ("auth_code", "auth|auth code|authorization code"), ("customer_id", "customer|customer id|cust id"), ("branch_code", "branch|branch code|sol id"),
]


def _groups(norm: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({norm}, '{terms}') THEN '{g}' END" for g, terms in GROUPS) + "], lambda x: x IS NOT NULL)"


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN len(list_intersect(list_distinct({a}), list_distinct({b})))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END"


def _header_score(a: str, b: str) -> str:
    """Of two rows with norm, toks and grps."""
    return f"CASE WHEN {a}.norm = '' OR {b}.norm = '' THEN 0 ELSE least(100, floor(CASE WHEN {a}.norm = {b}.norm THEN 60 ELSE 0 END + {_jaccard(f'{a}.toks', f'{b}.toks')} * 25 + {_jaccard(f'{a}.grps', f'{b}.grps')} * 15 + 0.5)) END::DOUBLE"


#: Families of header texts, with their keys first.
FAMILIES = [
    "amount,txn amount,auth amount,posted amount,replaced amount,amt,transaction amount", "transaction_id,txn id,trace id,reference id,rrn,stan,trans id", "card_number,pan,masked pan,card no,card #", "date,transaction date,posting date,entry date,value date",
    "merchant_text,merchant,merchant name,merchant desc,merchant description", "narration_text,narration,description,particulars,details", "response_code,auth code,status code,resp code", "currency,ccy,currency code,currency", "debit_amount,debit,dr", "credit_amount,credit,cr",
]


def _family(x: str) -> str:
    norm = f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]', ' ', 'g'), '\\s+', ' ', 'g'))"
    found = "concat_ws(',', " + ", ".join(f"CASE WHEN list_contains(string_split('{f}', ','), {norm}) THEN '{f}' END" for f in FAMILIES) + ")"
    return f"CASE WHEN {found} <> '' THEN {found} ELSE {norm} END"


#: Source types and the target types that score 72 with them.
COMPATIBLE = [
    ("debit_credit", "status_code generic_text"), ("transaction_id", "reference_number auth_code"), ("reference_number", "transaction_id auth_code customer_id"), ("amount", "debit_amount credit_amount generic_numeric"),
    ("debit_amount", "amount generic_numeric"), ("credit_amount", "amount generic_numeric"), ("date", "datetime"), ("datetime", "date"), ("card_number", "masked_pan account_number"), ("account_number", "reference_number customer_id"),
    ("masked_pan", "card_number account_number"), ("merchant_text", "narration_text merchant_name narration generic_text"), ("narration_text", "merchant_text narration merchant_name generic_text"), ("merchant_name", "narration generic_text"),
    ("narration", "merchant_name generic_text"), ("status_code", "generic_text"), ("auth_code", "reference_number transaction_id"), ("customer_id", "reference_number account_number"), ("branch_code", "reference_number generic_text"),
    ("generic_text", "narration merchant_name"), ("generic_numeric", "amount debit_amount credit_amount"), ("unknown", "generic_text generic_numeric"),
]


def _compatible(a: str, b: str) -> str:
    listed = " OR ".join(f"({a} = '{s}' AND {b} IN ({', '.join(repr(t) for t in ts.split())}))" for s, ts in COMPATIBLE)
    return f"CASE WHEN {a} = {b} THEN 100 WHEN {listed} THEN 72 WHEN {a} = 'unknown' OR {b} = 'unknown' THEN 40 ELSE 15 END::DOUBLE"


def _alignment(name: str, kind: str) -> str:
    return f"CASE WHEN {_expected(name)} = 'unknown' THEN 45 ELSE {_compatible(_expected(name), kind)} END::DOUBLE"


def _predicates(v: str) -> dict[str, str]:
    is_ = lambda p: f"regexp_matches({v}, '{p}')"
    digits = f"length(regexp_replace({v}, '\\D', '', 'g'))"
    return {
        "date": is_(r"^\d{4}-\d{2}-\d{2}$"), "datetime": is_(r"^\d{4}-\d{2}-\d{2}[Tt\s]\d{2}:\d{2}(:\d{2})?"), "numeric": is_(NUMBER), "amount": f"regexp_matches(regexp_replace({v}, '[₹$€£¥,\\s]', '', 'g'), '^[-+]?\\d+(\\.\\d{{1,4}})?$')",
        "currency": f"regexp_matches(upper({v}), '^[A-Z]{{3}}$')", "card": is_(r"^(?:\d[\s-]*){13,19}$") + " OR " + is_(MASKED), "masked_run": is_(MASKED) + " OR (" + is_(r"\*{2,}|[xX]{2,}") + " AND " + is_(r"\d{2,}") + ")",
        "drcr": is_("(?i)^(dr|cr|debit|credit|d|c)$"), "status": is_("(?i)^(approved|declined|failed|pending|success|error|reversed|00|01|05|09|12)$"), "account": f"{digits} BETWEEN 8 AND 18 AND NOT {is_(MASKED)}",
        "txn_id": is_(r"^[A-Za-z0-9\-_/]{8,}$") + " AND " + is_("[A-Za-z]"), "text": is_("[A-Za-z]"), "long_text": is_(r"\S\s+\S") + f" OR length({v}) >= 15", "long_id": is_(r"^[A-Za-z0-9\-]{8,}$"), "spaced": f"length({v}) > 12 AND {v} LIKE '% %'",
    }


OBSERVED = """CASE WHEN r_currency > 0.8 THEN 'currency' WHEN r_datetime > 0.72 THEN 'datetime' WHEN r_date > 0.75 THEN 'date' WHEN r_drcr > 0.8 THEN 'debit_credit' WHEN r_card > 0.55 AND r_masked_run > 0.25 THEN 'masked_pan' WHEN r_card > 0.55 THEN 'card_number'
 WHEN r_status > 0.75 THEN 'status_code' WHEN r_amount > 0.82 THEN 'amount' WHEN r_numeric > 0.9 THEN 'generic_numeric' WHEN r_txn_id > 0.7 THEN 'transaction_id' WHEN r_account > 0.72 AND r_text < 0.2 THEN 'account_number'
 WHEN r_long_text > 0.7 AND r_text > 0.7 THEN 'narration_text' WHEN r_text > 0.75 THEN 'generic_text' ELSE 'unknown' END"""

COLUMN_TYPE = """CASE WHEN regexp_matches(norm, 'debit|withdrawal|dr') THEN 'debit_amount' WHEN regexp_matches(norm, 'credit|deposit|cr') THEN 'credit_amount'
 WHEN regexp_matches(norm, 'tran type|part tran|debit credit|drcr') THEN CASE WHEN r_datetime >= 0.5 THEN 'datetime' WHEN r_date >= 0.5 THEN 'date' ELSE 'debit_credit' END
 WHEN regexp_matches(norm, 'amount|amt') AND r_numeric > 0.5 THEN 'amount' WHEN regexp_matches(norm, 'currency|ccy|curr') OR r_currency > 0.7 THEN 'currency' WHEN regexp_matches(norm, 'datetime|timestamp') AND r_datetime > 0.2 THEN 'datetime'
 WHEN regexp_matches(norm, 'date|value date|posting') AND r_date > 0.4 THEN 'date' WHEN regexp_matches(norm, 'time|timestamp|datetime') THEN 'datetime' WHEN regexp_matches(norm, 'merchant|acceptor') THEN 'merchant_text'
 WHEN regexp_matches(norm, 'narration|description|remark|particular') THEN 'narration_text' WHEN regexp_matches(norm, 'status|response') THEN 'status_code' WHEN regexp_matches(norm, 'auth|authorization') THEN 'auth_code'
 WHEN regexp_matches(norm, 'customer|cust') THEN 'customer_id' WHEN regexp_matches(norm, 'branch|sol') THEN 'branch_code' WHEN regexp_matches(norm, 'account|iban|a c') OR r_long_id > 0.7 THEN 'account_number'
 WHEN regexp_matches(norm, 'pan|card') OR r_card > 0.5 OR r_masked_run > 0.5 THEN CASE WHEN r_masked_run > 0.2 THEN 'masked_pan' ELSE 'card_number' END
 WHEN regexp_matches(norm, 'transaction|txn|trace|rrn|stan|identifier') THEN 'transaction_id' WHEN regexp_matches(norm, 'reference|ref') THEN 'reference_number' WHEN observed_type <> 'unknown' THEN observed_type WHEN r_spaced > 0.4 THEN 'narration_text' ELSE 'unknown' END"""


def _moments(d: str, keys: str) -> str:
    """(keys, n, mean, std) of a dictionary's numbers."""
    numbers = f"SELECT {keys}, cnt, try_cast(value AS DOUBLE) AS x FROM {d} WHERE regexp_matches(value, '{NUMBER}')"
    about = f"SELECT *, sum(x * cnt) OVER (PARTITION BY {keys}) / sum(cnt) OVER (PARTITION BY {keys}) AS mu FROM ({numbers})"
    return f"SELECT {keys}, coalesce(n, 0) AS n, mean, std FROM (SELECT DISTINCT {keys} FROM {d}) LEFT JOIN (SELECT {keys}, sum(cnt) AS n, any_value(mu) AS mean, sqrt(sum(cnt * (x - mu) * (x - mu)) / sum(cnt)) AS std FROM ({about}) GROUP BY {keys}) USING ({keys})"


def _numeric(a: str, b: str) -> str:
    return f"CASE WHEN {a}.n < 5 OR {b}.n < 5 THEN 0 ELSE 1 - least(1, (abs({a}.mean - {b}.mean) + abs({a}.std - {b}.std)) / (2 * greatest(abs({a}.mean), abs({b}.mean), 1))) END"


def _typed(d: str, names: str, out: str) -> str:
    """Common table expressions up to `out`: each column's ratios, types and header features. d: (side, col_idx, value, cnt); names: (side, col_idx, name)."""
    n = "sum(cnt) FILTER (WHERE value IS NOT NULL)"
    ratios = ", ".join(f"coalesce(sum(cnt) FILTER (WHERE value IS NOT NULL AND ({p}))::DOUBLE / {n}, 0) AS r_{k}" for k, p in _predicates("value").items())
    return f"""{out}_p AS (SELECT side, col_idx, coalesce(sum(cnt) FILTER (WHERE value IS NULL), 0)::DOUBLE / sum(cnt) AS null_ratio, coalesce(count(value)::DOUBLE / {n}, 0) AS uniqueness, coalesce((max(cnt) FILTER (WHERE value IS NOT NULL))::DOUBLE / {n}, 0) AS top_share, {ratios} FROM {d} GROUP BY side, col_idx),
{out}_n AS (SELECT *, array_to_string(toks, ' ') AS norm FROM (SELECT *, {_tokens('name')} AS toks, {_expected('name')} AS expected_type FROM {names})),
{out}_g AS (SELECT *, {_groups('norm')} AS grps, side || '_' || (col_idx + 1) AS col_id FROM {out}_n), {out}_o AS (SELECT *, {OBSERVED} AS observed_type FROM {out}_g JOIN {out}_p USING (side, col_idx)),
{out} AS (SELECT *, {COLUMN_TYPE} AS column_type, {_alignment('name', 'observed_type')} AS alignment FROM {out}_o)"""


def oracle_sql() -> dict[str, str]:
    r = "raw"
    m = MASKED
    is_ = lambda p: f"regexp_matches(v, '{p}')"
    count = lambda cond: f"count(*) FILTER (WHERE {cond})"
    share = lambda p: f"round(coalesce(sum(CASE WHEN {p} THEN cnt ELSE 0 END)::DOUBLE / sum(cnt) FILTER (WHERE value IS NOT NULL), 0), 6)"
    val = lambda p: f"regexp_matches(value, '{p}')"
    digits = "length(regexp_replace(v, '\\D', '', 'g'))"
    return mapping_sql() | more_sql() | {
        "normalize_values": f"WITH {NOISY} SELECT o_orderkey, {_null_like(r)} AS null_like, {_compact(r)} AS compact, {_amount(r)} AS amount, {_text(r)} AS text, {_cell(r)} AS cell, {_stripped(r)} AS stripped, {_pan(r)} AS pan FROM noisy",
        "normalize_dates": f"WITH {NOISY} SELECT o_orderkey, {_date(r)} AS date, {_date_part(r)} AS date_part FROM noisy",
        "value_tokens": f"SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower('POS Purchase ' || p_name || ' ' || p_type), '\\b({STOP})\\b', ' ', 'g'), '[^a-z0-9]+'), lambda t: length(t) >= 3))) AS token FROM part) GROUP BY token",
        "value_classes": f"""WITH {NOISY} SELECT CASE WHEN regexp_matches(raw, '^\\d{{1,3}}(,\\d{{3}})*(\\.\\d+)?$') THEN 'comma-number' WHEN regexp_matches(raw, '^\\d+\\.\\d+$') THEN 'decimal' WHEN regexp_matches(raw, '^[₹$€£¥]\\d+') THEN 'currency' WHEN regexp_matches(raw, '^\\d{{2,4}}[/-]\\d{{1,2}}[/-]\\d{{1,2}}') THEN 'date' ELSE 'other' END AS format,
 CASE WHEN regexp_matches(raw, '^\\d+(\\.\\d+)?$') THEN 'number' WHEN regexp_matches(raw, '^\\d{{2,4}}[/-]\\d{{1,2}}[/-]\\d{{1,2}}') THEN 'date' WHEN trim(raw) = '' THEN 'blank' ELSE 'text' END AS type,
 regexp_matches(raw, '[\\s,₹$€£¥()/\\[\\]{{}}#@!%^&*_=+|;:''"<>?]') OR (regexp_matches(raw, '[A-Z]') AND raw <> upper(raw)) AS dirty, count(*) AS n FROM noisy WHERE {_null_like(r)} IS NOT NULL GROUP BY ALL""",
        "type_predicates": f"""WITH {NOISY}, c AS (SELECT {_cell(r)} AS v FROM noisy) SELECT {count(is_("^\\d{4}-\\d{2}-\\d{2}$"))} AS date, {count(is_("^\\d{4}-\\d{2}-\\d{2}[Tt\\s]\\d{2}:\\d{2}(:\\d{2})?"))} AS datetime, {count(is_(NUMBER))} AS "numeric",
 {count("regexp_matches(regexp_replace(v, '[₹$€£¥,\\s]', '', 'g'), '^[-+]?\\d+(\\.\\d{1,4})?$')")} AS amount, {count("regexp_matches(upper(v), '^[A-Z]{3}$')")} AS currency, {count(is_("^(?:\\d[\\s-]*){13,19}$") + " OR " + is_(m))} AS card, {count(is_(m))} AS masked,
 {count(is_(m) + " OR (" + is_("\\*{2,}|[xX]{2,}") + " AND " + is_("\\d{2,}") + ")")} AS masked_run, {count(is_("(?i)^(dr|cr|debit|credit|d|c)$"))} AS drcr, {count(is_("(?i)^(approved|declined|failed|pending|success|error|reversed|00|01|05|09|12)$"))} AS status,
 {count(f"{digits} BETWEEN 8 AND 18 AND NOT {is_(m)}")} AS account, {count(is_("^[A-Za-z0-9\\-_/]{8,}$") + " AND " + is_("[A-Za-z]"))} AS txn_id, {count(is_("[A-Za-z]"))} AS text, {count(is_("\\S\\s+\\S") + " OR length(v) >= 15")} AS long_text FROM c WHERE v IS NOT NULL""",
        "header_normalize": f"WITH h AS (SELECT p_partkey, {SHAPES}[p_partkey % 8 + 1] || '_' || p_brand AS header FROM part) SELECT p_partkey, array_to_string({_tokens('header')}, ' ') AS normalized, len({_tokens('header')}) AS n_tokens, {_expected('header')} AS expected FROM h",
        "column_profile": f"""WITH {_dict("customer", "d")} SELECT col_idx, sum(cnt)::BIGINT AS n_rows, (sum(cnt) FILTER (WHERE value IS NOT NULL))::BIGINT AS n_values, count(value) AS n_distinct, round(coalesce(sum(cnt) FILTER (WHERE value IS NULL), 0)::DOUBLE / sum(cnt), 6) AS null_ratio,
 round(count(value)::DOUBLE / sum(cnt) FILTER (WHERE value IS NOT NULL), 6) AS uniqueness_ratio, round((sum(cnt) FILTER (WHERE value IS NOT NULL) - count(value))::DOUBLE / sum(cnt) FILTER (WHERE value IS NOT NULL), 6) AS repeated_ratio, round(sum(length(value) * cnt)::DOUBLE / sum(cnt) FILTER (WHERE value IS NOT NULL), 6) AS avg_length,
 round((max(cnt) FILTER (WHERE value IS NOT NULL))::DOUBLE / sum(cnt) FILTER (WHERE value IS NOT NULL), 6) AS top_share, {share(val(NUMBER))} AS r_numeric, {share(val("^[-+]?\\d+$"))} AS r_integer, {share(val("^[-+]?\\d*\\.\\d+$"))} AS r_decimal, {share(val("\\d{2,4}[/-]\\d{1,2}[/-]\\d{1,2}"))} AS r_date_like, {share(val("\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}"))} AS r_datetime_like,
 {share(val("[A-Za-z]{3,}"))} AS r_text_like, {share("value = upper(value)")} AS r_uppercase, {share(val("[*xX#]"))} AS r_masked_like, {share(val("[A-Za-z]"))} AS r_text,
 {share("regexp_matches(regexp_replace(value, '[₹$€£¥,\\s]', '', 'g'), '^[-+]?\\d+(\\.\\d{1,4})?$')")} AS r_amount, {share(val("\\S\\s+\\S") + " OR length(value) >= 15")} AS r_long_text, min(length(value)) AS min_length, max(length(value)) AS max_length FROM d GROUP BY col_idx""",
        "top_values": f"""WITH c AS (SELECT 1 AS col_idx, c_custkey AS k, c_nationkey::VARCHAR AS raw FROM customer UNION ALL SELECT 2, c_custkey, c_mktsegment FROM customer), d AS (SELECT col_idx, {_cell(r)} AS value, count(*) AS cnt, min(k) AS first FROM c GROUP BY ALL)
 SELECT col_idx, rank, value, cnt FROM (SELECT *, row_number() OVER (PARTITION BY col_idx ORDER BY cnt DESC, first, value) AS rank FROM d WHERE value IS NOT NULL) WHERE rank <= 5""",
        "column_overlap": f"WITH {_over()} SELECT col_a, col_b, view, shared, size_a, size_b, round(shared::DOUBLE / size_a, 6) AS coverage_a, round(shared::DOUBLE / size_b, 6) AS coverage_b, round(shared::DOUBLE / (size_a + size_b - shared), 6) AS jaccard, round(shared::DOUBLE / least(size_a, size_b), 6) AS overlap_ratio FROM o",
        "best_target": f"WITH {_over()} SELECT col_a, col_b, round(shared::DOUBLE / size_a, 6) AS coverage FROM o WHERE view = 'raw' QUALIFY row_number() OVER (PARTITION BY col_a ORDER BY shared::DOUBLE / size_a DESC, shared::DOUBLE / size_b DESC, col_b) = 1",
        "numeric_similarity": f"WITH {_dict('customer', 'da')}, {_dict('supplier', 'db')}, a AS ({_moments('da', 'col_idx')}), b AS ({_moments('db', 'col_idx')}) SELECT a.col_idx AS col_a, b.col_idx AS col_b, round({_numeric('a', 'b')}, 5)::DOUBLE AS \"numeric\" FROM a, b",
        "numeric_spread": "SELECT col_idx, count(x) AS n, round(avg(x), 4) AS mean, round(stddev_pop(x - lo), 4) AS std FROM (SELECT *, min(x) OVER (PARTITION BY col_idx) AS lo FROM (SELECT 0 AS col_idx, (1000000000000 + o_orderkey)::DOUBLE AS x FROM orders UNION ALL SELECT 1, o_totalprice FROM orders UNION ALL SELECT 2, o_custkey::DOUBLE FROM orders)) GROUP BY col_idx",
        "double_texts": f"SELECT l_orderkey, l_linenumber, {_double('(l_extendedprice * l_discount / 1e7)')} AS rate, {_double('(l_extendedprice * 1e36)')} AS large, {_double('(l_extendedprice / -3e0)')} AS third, {_double('(l_quantity / 1e308 / 1e12)')} AS tiny, {_double('l_tax')} AS tax FROM lineitem",
        "rows_equal": "SELECT 'a' AS a, 'b' AS b, 1.0::DOUBLE AS share UNION ALL SELECT 'a', 'c', round(avg(CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 1 END)::DOUBLE, 6) FROM orders",
        "feedback_latest": "SELECT user_id AS source_id, event_type AS verdict, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
        "preview": f"SELECT {_cell('k')} AS o_orderkey, {_cell('o_orderpriority')} AS o_orderpriority, {_cell('p')} AS o_totalprice FROM (SELECT o_orderkey::VARCHAR AS k, o_orderpriority, {_double('o_totalprice')} AS p FROM orders ORDER BY o_orderkey LIMIT 10)",
        "row_and_column_counts": "SELECT count(*) AS row_count, 11::BIGINT AS column_count FROM lineitem",
    }


def _reconciliation() -> str:
    """cells(side, col_idx, k, raw): the two files made from orders."""
    words = "o_orderpriority || ' cust' || o_custkey || ' shop' || (o_custkey % 97)"
    ref, card = "'ORD-' || lpad(k::VARCHAR, 9, '0')", "'4' || lpad(k::VARCHAR, 15, '7')"
    a = [("Txn Ref", ref), ("Amount", "price"), ("Account Number", "price"), ("Txn Datetime", "strftime(o_orderdate, '%Y-%m-%d 10:22:33')"), ("Card", card), ("Narration", f"'POS purchase ' || {words}"), ("Status", "o_orderstatus"), ("Other", "'own' || k")]
    b = [
        ("Transaction Identifier", f"lower({ref})"), ("Authorized Amount", "'$' || price || '00'"), ("Posting Date", "strftime(CASE WHEN k % 5 = 0 THEN o_orderdate::DATE + 20000 ELSE o_orderdate::DATE END, '%d/%m/%Y')"), ("Tran Date", "strftime(o_orderdate, '%d/%m/%Y')"), ("Value Date", "strftime(o_orderdate, '%d/%m/%Y')"),
        ("Masked Card", f"substr({card}, 1, 8) || 'xxxx' || right({card}, 4)"), ("Description", f"{words} || ' withdrawal atm'"), ("Response Code", "lpad((k % 4)::VARCHAR, 2, '0')"), ("Other Target", "'x' || md5(k::VARCHAR)"),
    ]
    cells = " UNION ALL ".join(f"SELECT '{side}' AS side, {i} AS col_idx, k, {x} AS raw FROM src" for side, cols in (("A", a), ("B", b)) for i, (_, x) in enumerate(cols))
    names = ", ".join(f"('{side}', {i}, '{n}')" for side, cols in (("A", a), ("B", b)) for i, (n, _) in enumerate(cols))
    return f"src AS (SELECT *, o_orderkey AS k, o_totalprice::DECIMAL(18,2)::VARCHAR AS price FROM orders), cells AS ({cells}), names(side, col_idx, name) AS (VALUES {names})"


NOTHING, WEAKER, WEAKER_TARGET = "No accepted match found after strict validation", "Near-identical source column detected; weaker duplicate rejected", "Near-identical target column detected; weaker duplicate rejected"


def _mapping() -> str:
    """Common table expressions of the whole mapping of the reconciliation pair."""
    cov = lambda view, side: f"coalesce(max(shared::DOUBLE / size_{side}) FILTER (WHERE view = '{view}'), 0)"
    trust = lambda low, medium, high: f"CASE s.trust WHEN 'low' THEN {low} WHEN 'medium' THEN {medium} ELSE {high} END"
    near_b = "(view = 'raw' AND ratio >= 0.97) OR (view = 'amount' AND ratio >= 0.98) OR (view = 'date' AND ratio >= 0.98) OR (view = 'pan' AND ratio >= 0.95)"
    near_a = "(view = 'raw' AND ratio >= 0.999) OR (view = 'amount' AND ratio >= 0.999)"
    dates, money, cards = "('date', 'datetime')", "('amount', 'generic_numeric')", "('card_number', 'masked_pan')"
    texts = "('narration', 'narration_text', 'merchant_name', 'merchant_text', 'generic_text', 'reference_number', 'transaction_id')"
    rules = [
        ("s_dup AND t_type = 'amount'", "'REJECT_DUPLICATE'", "Source column is duplicate/suspicious and not the canonical amount representative"),
        ("t_dup", "'REJECT_DUPLICATE'", "Duplicate target column rejected; canonical target retained"),
        (f"s_type IN {dates} AND t_type IN {dates} AND regexp_matches(lower(t_name), '{DERIVED}')", "'REJECT_WEAK'", "Target date column is treated as derived date-part mapping"),
        ("type_score < 45 AND rs > 0.7", "CASE WHEN shifted THEN 'REJECT_SHIFTED_HEADER' ELSE 'REJECT_WEAK' END", "Raw overlap is high but observed business types are incompatible"),
        ("(trust = 'low' OR shifted) AND rs > 0.72 AND plausibility < 50", "'REJECT_SHIFTED_HEADER'", "Shifted/misleading header likely; rejected despite overlap"),
        (f"s_type IN {money} AND t_type IN {money} AND amount_s >= 0.94 AND amount_t >= 0.94 AND plausibility >= 55 AND NOT risk", "'ACCEPT_EXACT'", None),
        ("rs >= 0.9 AND rt >= 0.83 AND type_score >= 60 AND plausibility >= 55 AND NOT risk", "'ACCEPT_EXACT'", None),
        ("rs >= 0.75 AND rt >= 0.58 AND type_score >= 55 AND plausibility >= 52 AND NOT risk", "'ACCEPT_EXACT_PARTIAL'", None),
        (f"(s_type IN {dates} AND t_type IN {dates} AND date_s >= 0.82) OR (rs >= 0.6 AND rt >= 0.5 AND type_score >= 68 AND header_score >= 30 AND plausibility >= 55)", "'ACCEPT_STRONG_DOMAIN_MATCH'", None),
        (f"(pan_s >= 0.85 AND pan_t >= 0.85 AND (s_type IN {cards} OR s_type = 'datetime' OR t_type IN {cards})) OR (most >= 0.8 AND type_score >= 55)", "'ACCEPT_TRANSFORMED'", None),
        (f"s_type IN {texts} AND t_type IN {texts} AND token_j >= 0.62", "'ACCEPT_SEMANTIC'", None),
        ("confidence < 40", "'UNMATCHED'", "No reliable evidence found"),
    ]
    decision = "CASE " + " ".join(f"WHEN {c} THEN {d}" for c, d, _ in rules) + " ELSE 'REJECT_WEAK' END"
    why = "CASE " + " ".join(f"WHEN {c} THEN {'NULL' if r is None else repr(r)}" for c, _, r in rules) + " ELSE 'Evidence too weak for conservative acceptance' END"
    category = "CASE WHEN {0} IN ('ACCEPT_EXACT', 'ACCEPT_EXACT_PARTIAL', 'ACCEPT_STRONG_DOMAIN_MATCH') THEN 'exact' WHEN {0} = 'ACCEPT_TRANSFORMED' THEN 'transformed' WHEN {0} = 'ACCEPT_SEMANTIC' THEN 'semantic' END"
    reasons = """[x FOR x IN [CASE WHEN rs >= 0.9 AND rt >= 0.83 THEN 'High unique-set overlap supports same business field' END, CASE WHEN tr >= 0.8 THEN 'Transformed signatures strongly overlap' END, CASE WHEN sem >= 75 THEN 'Semantic token overlap indicates related business meaning' END,
 CASE WHEN t_dup THEN 'Target is in duplicate cluster and receives heavy penalty' END, CASE WHEN plausibility < 45 THEN 'Business plausibility is weak for this candidate' END, CASE WHEN risk THEN 'Low-cardinality repetition risk detected' END] IF x IS NOT NULL]"""
    return f"""{_reconciliation()}, raws AS (SELECT side, col_idx, raw, count(*) AS cnt FROM cells GROUP BY ALL), vals AS MATERIALIZED (SELECT side, col_idx, raw, cnt, {_cell('raw')} AS value FROM raws),
d AS MATERIALIZED (SELECT side, col_idx, value, sum(cnt)::BIGINT AS cnt FROM vals GROUP BY ALL), {_typed('d', 'names', 'ty')},
lows AS (SELECT *, expected_type <> 'unknown' AND observed_type <> 'unknown' AND {_compatible('expected_type', 'observed_type')} < 50 AS low FROM ty),
runs AS (SELECT *, coalesce(lag(low) OVER (PARTITION BY side ORDER BY col_idx), false) AND low AS run FROM lows),
shift AS (SELECT side, sum(low::INT) >= greatest(2, floor(count(*) * 0.35)) OR bool_or(run) AS shifted FROM runs GROUP BY side),
ck AS MATERIALIZED (SELECT runs.*, shifted, CASE WHEN low THEN 'low' WHEN expected_type = 'unknown' OR shifted THEN 'medium' ELSE 'high' END AS trust FROM runs JOIN shift USING (side)),
sg AS MATERIALIZED (SELECT * FROM ({_views('d', 'raw date amount pan padded token', 'side, col_idx')}) WHERE sig IS NOT NULL), sz AS (SELECT side, col_idx, view, count(*) AS n FROM sg GROUP BY ALL),
sh AS (SELECT x.side AS side_a, x.col_idx AS a, y.side AS side_b, y.col_idx AS b, x.view, count(*) AS shared FROM sg x JOIN sg y ON x.view = y.view AND x.sig = y.sig AND (x.side < y.side OR (x.side = y.side AND x.col_idx < y.col_idx)) GROUP BY ALL),
ov AS MATERIALIZED (SELECT sh.*, p.n AS size_a, q.n AS size_b, shared::DOUBLE / least(p.n, q.n) AS ratio FROM sh JOIN sz p ON p.side = side_a AND p.col_idx = a AND p.view = sh.view JOIN sz q ON q.side = side_b AND q.col_idx = b AND q.view = sh.view),
byrow AS (SELECT c.k, c.col_idx, v.value FROM cells c JOIN vals v USING (side, col_idx, raw) WHERE side = 'A'),
eq AS (SELECT x.col_idx AS a, y.col_idx AS b FROM byrow x JOIN byrow y ON x.k = y.k AND x.col_idx < y.col_idx GROUP BY ALL HAVING avg((x.value IS NOT DISTINCT FROM y.value)::INT) >= 0.999),
near AS (SELECT side_a AS side, a, b FROM ov WHERE side_a = side_b AND side_a = 'B' AND ({near_b}) UNION SELECT side_a, a, b FROM ov WHERE side_a = side_b AND side_a = 'A' AND ({near_a}) UNION SELECT 'A', a, b FROM eq),
both_ways AS (SELECT side, a, b FROM near UNION SELECT side, b, a FROM near),
adj AS (SELECT n.side, list(coalesce(l, []) ORDER BY n.col_idx) AS adj, count(*) AS n FROM names n LEFT JOIN (SELECT side, a, list(b) AS l FROM both_ways GROUP BY side, a) e ON e.side = n.side AND e.a = n.col_idx GROUP BY n.side),
star(side, i, cl) AS (SELECT side, 0, list_transform(range(0, n), lambda x: -1) FROM adj UNION ALL SELECT s.side, i + 1, CASE WHEN cl[i + 1] >= 0 THEN cl ELSE list_transform(cl, lambda c, j: CASE WHEN c < 0 AND (j - 1 = i OR list_contains(adj[i + 1], j - 1)) THEN i ELSE c END) END FROM star s JOIN adj USING (side) WHERE i < n),
cl AS (SELECT star.side, unnest(range(0, n)) AS col_idx, unnest(cl) AS cluster FROM star JOIN adj USING (side) WHERE i = n),
canon AS (SELECT cl.*, row_number() OVER w AS rk, first_value(cl.col_idx) OVER w AS canonical_idx FROM cl JOIN ck USING (side, col_idx) WINDOW w AS (PARTITION BY side, cluster ORDER BY
  CASE WHEN uniqueness > 0.55 THEN 10 ELSE -5 END + alignment + CASE WHEN observed_type = 'amount' AND regexp_matches(lower(name), 'amount|authorized|replaced|posted|value') THEN 30 ELSE 0 END - CASE WHEN observed_type = 'amount' AND regexp_matches(lower(name), 'account|acct') THEN 35 ELSE 0 END
  - CASE WHEN observed_type = 'card_number' AND regexp_matches(lower(name), 'date|time|datetime') THEN 12 ELSE 0 END - null_ratio * 10 DESC, cl.col_idx)),
dups AS (SELECT side, col_idx, canonical_idx FROM canon WHERE rk > 1),
wide AS (SELECT a, b, {cov('raw', 'a')} AS raw_s, {cov('raw', 'b')} AS raw_t, {cov('date', 'a')} AS date_s, {cov('amount', 'a')} AS amount_s, {cov('amount', 'b')} AS amount_t, {cov('pan', 'a')} AS pan_s, {cov('pan', 'b')} AS pan_t, {cov('padded', 'a')} AS padded_s,
  coalesce(max(shared::DOUBLE / (size_a + size_b - shared)) FILTER (WHERE view = 'token'), 0) AS token_j FROM ov WHERE side_a = 'A' AND side_b = 'B' GROUP BY a, b),
pr0 AS (SELECT s.col_idx AS s, t.col_idx AS t, s.col_id AS s_id, t.col_id AS t_id, s.name AS s_name, t.name AS t_name, s.observed_type AS s_type, t.observed_type AS t_type, s.alignment AS s_al, t.alignment AS t_al, s.null_ratio AS s_null, t.null_ratio AS t_null, s.trust,
  s.shifted OR t.shifted AS shifted, greatest(s.top_share, t.top_share) >= 0.55 AS risk, EXISTS (FROM dups WHERE side = 'A' AND col_idx = s.col_idx) AS s_dup, EXISTS (FROM dups WHERE side = 'B' AND col_idx = t.col_idx) AS t_dup,
  {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('raw_s', 'raw_t', 'date_s', 'amount_s', 'amount_t', 'pan_s', 'pan_t', 'padded_s', 'token_j'))}, {_compatible('s.observed_type', 't.observed_type')} AS type_score, {_header_score('s', 't')} AS header_score,
  {trust(3, 12, 20)} AS hw, {trust(0.2, 0.55, 1)} AS hf FROM (FROM ck WHERE side = 'A') s CROSS JOIN (FROM ck WHERE side = 'B') t LEFT JOIN wide ON a = s.col_idx AND b = t.col_idx),
pr AS MATERIALIZED (SELECT *, greatest(date_s, amount_s, pan_s, padded_s) AS most, raw_s * 50 + greatest(date_s, amount_s, pan_s, padded_s) * 28 + type_score / 100 * 20 + header_score / 100 * hw AS quick,
  floor(type_score * 0.55 + (s_al + t_al) / 2 * 0.35 + header_score * 0.1 * hf + 0.5)::BIGINT AS plausibility FROM pr0),
short AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY quick DESC, t) AS quick_rank FROM pr WHERE NOT (type_score < 30 AND raw_s < 0.12 AND most < 0.2)),
sc0 AS (SELECT *, round(raw_s, 4) AS rs, round(raw_t, 4) AS rt, round(most, 4) AS tr, round(token_j * 100, 2) AS sem FROM short WHERE quick_rank <= 7),
sc AS (SELECT *, greatest(0, least(100, floor(rs * 48 + rt * 20 + tr * 18 + sem / 100 * 14 + type_score / 100 * 16 + plausibility / 100 * 16 - CASE WHEN t_dup THEN 45 ELSE 0 END - CASE WHEN risk THEN 12 ELSE 0 END - CASE WHEN plausibility < 45 THEN 15 ELSE 0 END + 0.5)))::BIGINT AS confidence, {reasons} AS rsn FROM sc0),
dc0 AS (SELECT *, CASE WHEN len(rsn) > 0 THEN rsn ELSE ['Evidence remains limited'] END AS reason, CASE WHEN confidence >= 80 THEN 'matched' WHEN confidence >= 40 THEN 'weak' ELSE 'unmatched' END AS status, {decision} AS decision, {why} AS why FROM sc),
dc1 AS (SELECT *, decision LIKE 'ACCEPT%' AS accepted, row_number() OVER (PARTITION BY s ORDER BY confidence DESC, quick_rank) AS place, confidence - lead(confidence) OVER (PARTITION BY s ORDER BY confidence DESC, quick_rank) AS gap FROM dc0),
dc AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY s ORDER BY accepted::INT DESC, confidence DESC, quick_rank) AS rank, coalesce(bool_or(place = 1 AND gap < 8) OVER (PARTITION BY s), false) OR sum(accepted::INT) OVER (PARTITION BY s) > 1 AS ambiguous FROM dc1),
rv AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY t ORDER BY confidence + 0.4 * s_al DESC, list_position(['ACCEPT_EXACT', 'ACCEPT_EXACT_PARTIAL', 'ACCEPT_STRONG_DOMAIN_MATCH', 'ACCEPT_TRANSFORMED', 'ACCEPT_SEMANTIC'], decision), s) = 1 AS wins,
  min(list_position(['ACCEPT_EXACT', 'ACCEPT_EXACT_PARTIAL', 'ACCEPT_STRONG_DOMAIN_MATCH', 'ACCEPT_TRANSFORMED', 'ACCEPT_SEMANTIC'], decision) * 1000000000000 + s * 1000000 + place) OVER (PARTITION BY t) AS turn FROM dc WHERE accepted),
ls AS (SELECT l.*, 'Weaker duplicate candidate for ' || l.t_name || '; ' || w.s_name || ' is the stronger business mapping' AS lost FROM rv l JOIN rv w ON w.t = l.t AND w.wins WHERE NOT l.wins),
rj AS (SELECT s, t, confidence, CASE WHEN decision = 'UNMATCHED' THEN 'REJECT_WEAK' ELSE decision END AS decision, why, reason, rs, rt FROM dc WHERE NOT accepted UNION ALL SELECT s, t, confidence, 'REJECT_DUPLICATE', lost, reason, rs, rt FROM ls),
dv AS (SELECT pr.s, pr.t, floor(date_s * 100 + 0.5)::BIGINT AS confidence FROM pr WHERE s_type IN {dates} AND t_type IN {dates} AND date_s >= 0.78 AND (regexp_matches(lower(t_name), '{DERIVED}') OR NOT EXISTS (FROM rv WHERE rv.s = pr.s AND rv.t = pr.t))),
bs AS (SELECT dc.*, lost FROM dc LEFT JOIN ls ON ls.s = dc.s AND ls.t = dc.t WHERE dc.accepted AND dc.rank = 1),
rs0 AS (SELECT ck.col_idx AS s, ck.col_id AS source_id, ck.name AS source_name, ck.observed_type AS source_type, bs.t AS best, CASE WHEN lost IS NULL THEN bs.t_id END AS target_id, CASE WHEN lost IS NULL THEN bs.t_name END AS target_name, CASE WHEN lost IS NULL THEN bs.t_type END AS target_type,
  coalesce(CASE WHEN lost IS NULL THEN bs.confidence END, 0) AS confidence, coalesce(CASE WHEN lost IS NULL THEN bs.status END, 'unmatched') AS status, coalesce(CASE WHEN lost IS NULL THEN {category.format('bs.decision')} END, 'unmatched') AS category,
  CASE WHEN bs.s IS NULL THEN 'UNMATCHED' WHEN lost IS NULL THEN bs.decision ELSE 'REJECT_DUPLICATE' END AS decision, CASE WHEN bs.s IS NULL THEN ['{NOTHING}'] WHEN lost IS NULL THEN bs.reason ELSE [lost] END AS reason, bs.header_score, bs.rs, bs.rt, bs.type_score FROM ck LEFT JOIN bs ON bs.s = ck.col_idx WHERE side = 'A'),
res AS MATERIALIZED (SELECT rs0.*, coalesce((SELECT list(t_id ORDER BY place)[1:3] FROM dc WHERE dc.s = rs0.s AND dc.t IS DISTINCT FROM rs0.best), []) AS alternatives, coalesce((SELECT bool_or(ambiguous) FROM dc WHERE dc.s = rs0.s), false) AS ambiguous FROM rs0),
um AS (SELECT source_id, source_name, decision, confidence, rejection_reason FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY o, tt DESC) AS nth FROM (
  SELECT source_id, source_name, 'UNMATCHED' AS decision, 0 AS confidence, '{NOTHING}' AS rejection_reason, 1 AS o, 0 AS tt FROM res WHERE decision = 'UNMATCHED'
  UNION ALL SELECT col_id, name, 'REJECT_DUPLICATE', 0, '{WEAKER}', 2, 0 FROM dups JOIN ck USING (side, col_idx) WHERE side = 'A'
  UNION ALL SELECT s_id, s_name, 'REJECT_DUPLICATE', confidence, lost, 3, turn FROM ls WHERE NOT EXISTS (FROM rv WHERE rv.s = ls.s AND rv.wins))) WHERE nth = 1),
over_ AS (SELECT source_id, CASE WHEN s % 4 = 0 THEN 'B_1' END AS override_id FROM res WHERE (s + 1) % 4 < 2)"""


def mapping_sql() -> dict[str, str]:
    counts = ", ".join(f"('{b}', (SELECT count(*) FROM rv WHERE wins AND decision = '{b}'))" for b in ("ACCEPT_EXACT", "ACCEPT_EXACT_PARTIAL", "ACCEPT_STRONG_DOMAIN_MATCH", "ACCEPT_TRANSFORMED", "ACCEPT_SEMANTIC"))
    finals = {
        "schema_check": "SELECT side, col_idx::INT AS col_idx, observed_type, column_type, expected_type, trust, shifted, alignment FROM ck",
        "schema_warnings": """SELECT side, 'HEADER_VALUE_INCONSISTENT' AS code, 'warning' AS severity, 'Header ' || name || ' is inconsistent with observed values' AS message, col_id AS affected FROM ck WHERE low
 UNION ALL SELECT side, 'SCHEMA_SHIFT_SUSPECTED', 'critical', 'Multiple adjacent header/value mismatches indicate possible schema shift', string_agg(col_id, ',' ORDER BY col_idx) FROM ck WHERE low AND shifted GROUP BY side""",
        "duplicate_columns": f"SELECT d.side, d.col_idx::INT AS col_idx, x.col_id, x.name AS original_name, canonical_idx::INT AS canonical_idx, y.col_id AS canonical_id, y.name AS canonical_name, CASE WHEN d.side = 'A' THEN '{WEAKER}' ELSE '{WEAKER_TARGET}' END AS reason FROM dups d JOIN ck x ON x.side = d.side AND x.col_idx = d.col_idx JOIN ck y ON y.side = d.side AND y.col_idx = canonical_idx",
        "candidates": "SELECT s AS s_col_idx, t AS t_col_idx, round(quick, 6) AS quick_score, quick_rank::INT AS quick_rank, plausibility, type_score, header_score FROM short WHERE quick_rank <= 7",
        "decisions": "SELECT s AS s_col_idx, t AS t_col_idx, decision, confidence, status, rank::INT AS rank, ambiguous, array_to_string(reason, ' | ') AS reason FROM dc",
        "rejected_pairs": "SELECT s AS s_col_idx, t AS t_col_idx, CASE WHEN decision = 'REJECT_DUPLICATE' THEN 'duplicate_or_suspicious' ELSE 'rejected' END AS category, decision, confidence, CASE WHEN decision = 'REJECT_DUPLICATE' THEN 100 ELSE 0 END AS duplicate_penalty, why AS rejection_reason, array_to_string(reason, ' | ') AS reason, round(rs, 4) AS source_coverage, round(rt, 4) AS target_coverage FROM rj",
        "match_buckets": "SELECT decision AS bucket, CASE WHEN decision = 'ACCEPT_TRANSFORMED' THEN 'transformed' WHEN decision = 'ACCEPT_SEMANTIC' THEN 'semantic' ELSE 'exact' END AS category, s AS s_col_idx, t AS t_col_idx, confidence, round((rs + rt) / 2 * 100, 2) AS overlap_score, round(tr * 100, 2) AS transformed_score, sem AS semantic_score, risk AS low_cardinality, floor((rs + rt) / 2 * 100 + 0.5)::BIGINT AS evidence_exact FROM rv WHERE wins",
        "derived_dates": "SELECT s AS s_col_idx, t AS t_col_idx, confidence, 'DERIVED_MATCH' AS decision FROM dv",
        "resolved_conflicts": "SELECT s AS s_col_idx, t AS t_col_idx, decision, wins FROM rv",
        "mapping_results": "SELECT source_id AS \"sourceColumnId\", source_name AS \"sourceColumnName\", source_type AS \"sourceObservedType\", category AS \"mappingCategory\", decision AS \"finalMappingDecision\", coalesce(target_id, '') AS \"targetColumnId\", coalesce(target_name, '') AS \"targetColumnName\", coalesce(target_type, 'unknown') AS \"targetObservedType\", confidence, status, array_to_string(reason, ' | ') AS reason FROM res",
        "alternatives": "SELECT source_id, array_to_string(alternatives, ',') AS alternatives, ambiguous FROM res",
        "unmatched_sources": "SELECT * FROM um",
        "reverse_check": "SELECT col_id AS target_id, name AS target_name, b.source_id, b.source_name, coalesce(b.confidence, 0) AS confidence, coalesce(b.status, 'unmatched') AS status FROM (FROM ck WHERE side = 'B') c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY confidence DESC, s) AS r FROM res WHERE target_id IS NOT NULL) b ON b.target_id = c.col_id AND r = 1",
        "mapping_summary": f"SELECT * FROM (VALUES ('TOTAL', (SELECT count(*) FROM res)), {counts}, ('DERIVED_MATCH', (SELECT count(*) FROM dv)), ('DUPLICATE', (SELECT count(*) FROM rj WHERE decision = 'REJECT_DUPLICATE')), ('UNMATCHED', (SELECT count(*) FROM um))) v(bucket, n)",
        "final_mappings": "SELECT source_id, source_name, target_id, target_name, confidence, status, CASE WHEN confidence >= 80 THEN 'Strong' WHEN confidence >= 60 THEN 'Medium' WHEN confidence < 40 THEN 'Low' ELSE 'Weak' END AS label FROM res",
        "explanations": "SELECT source_id, CASE WHEN target_id IS NULL THEN 'No confident candidate was found.' ELSE 'Header score ' || header_score::BIGINT || ', Value score ' || floor((rs * 70 + rt * 30) * 100 + 0.5)::BIGINT || ', Type score ' || type_score::BIGINT || ', Total score ' || confidence || '. Reasons: ' || array_to_string(reason, '; ') END AS explanation FROM res",
        "accepted_results": "SELECT source_id, target_id, category FROM res WHERE category IN ('exact', 'transformed', 'semantic')",
        "overridden_targets": "SELECT res.source_id, CASE WHEN o.source_id IS NOT NULL AND o.override_id IS NULL THEN 'Unmatched (manual)' WHEN o.source_id IS NOT NULL THEN coalesce(ck.name, o.override_id) ELSE coalesce(target_name, '-') END AS effective_target FROM res LEFT JOIN over_ o USING (source_id) LEFT JOIN ck ON ck.col_id = o.override_id",
        "feedback_entries": "SELECT res.source_id, CASE WHEN o.source_id IS NOT NULL THEN o.override_id ELSE target_id END AS target_id, 'correct' AS verdict, TIMESTAMP '2026-01-01 00:00:00' AS updated_at FROM res LEFT JOIN over_ o USING (source_id)",
    }
    return {name: f"WITH RECURSIVE {_mapping()} {final}" for name, final in finals.items()}


def more_sql() -> dict[str, str]:
    events = f"SELECT 0 AS col_idx, event_id AS k, event_id::VARCHAR AS raw FROM events UNION ALL SELECT 1, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') FROM events UNION ALL SELECT 2, event_id, user_id::VARCHAR FROM events UNION ALL SELECT 3, event_id, event_type FROM events UNION ALL SELECT 4, event_id, {_double('value')} FROM events UNION ALL SELECT 5, event_id, props FROM events"
    noisy = "SELECT 0 AS col_idx, o_orderkey AS k, o_orderkey::VARCHAR AS raw FROM noisy UNION ALL SELECT 1, o_orderkey, raw FROM noisy"
    values = lambda cells: f"v AS MATERIALIZED (SELECT col_idx, k, value FROM ({cells}) JOIN (SELECT DISTINCT raw, {_cell('raw')} AS value FROM ({cells})) USING (raw))"
    hints = f"""dv AS (SELECT col_idx, value, count(*) AS cnt, min(k) AS first FROM v WHERE value IS NOT NULL GROUP BY ALL), tot AS (SELECT col_idx, count(*) AS n, count(value) AS nv, count(DISTINCT value) AS nd FROM v GROUP BY col_idx),
 smp AS (SELECT col_idx, list(value ORDER BY first) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY col_idx ORDER BY first, value) AS r FROM dv) WHERE r <= 8 GROUP BY col_idx),
 hn AS (SELECT tot.*, array_to_string(sample, '|') AS sample, concat_ws(',', CASE WHEN nd::DOUBLE / nv > 0.9 THEN 'mostly_unique' END, CASE WHEN (n - nv)::DOUBLE / n > 0.5 THEN 'sparse' END, CASE WHEN len(list_filter(sample, lambda x: regexp_matches(x, '{NUMBER}'))) > 0 THEN 'contains_numeric' END, CASE WHEN len(list_filter(sample, lambda x: regexp_matches(x, '[A-Za-z]{{3,}}'))) > 0 THEN 'contains_text' END) AS hints FROM tot LEFT JOIN smp USING (col_idx))"""
    score = r"""ff AS (SELECT *, CASE WHEN regexp_matches(value, '^\d{1,3}(,\d{3})*(\.\d+)?$') THEN 'comma-number' WHEN regexp_matches(value, '^\d+\.\d+$') THEN 'decimal' WHEN regexp_matches(value, '^[₹$€£¥]\d+') THEN 'currency' WHEN regexp_matches(value, '^\d{2,4}[/-]\d{1,2}[/-]\d{1,2}') THEN 'date' ELSE 'other' END AS fc,
 CASE WHEN regexp_matches(value, '^\d+(\.\d+)?$') THEN 'number' WHEN regexp_matches(value, '^\d{2,4}[/-]\d{1,2}[/-]\d{1,2}') THEN 'date' WHEN trim(value) = '' THEN 'blank' ELSE 'text' END AS tc, regexp_matches(value, '[\s,₹$€£¥()/\[\]{}#@!%^&*_=+|;:''"<>?]') OR (regexp_matches(value, '[A-Z]') AND value <> upper(value)) AS dirty
 FROM (SELECT *, row_number() OVER (PARTITION BY col_idx ORDER BY k) AS r FROM v WHERE value IS NOT NULL) WHERE r <= 50),
 ns AS (SELECT *, 0.4 * format_difference + 0.3 * mixed_type + 0.3 * dirty_value AS score FROM (SELECT col_idx, 1 - max(nf)::DOUBLE / sum(nf) AS format_difference FROM (SELECT col_idx, count(*) AS nf FROM ff GROUP BY col_idx, fc) GROUP BY col_idx) JOIN (SELECT col_idx, 1 - max(nt)::DOUBLE / sum(nt) AS mixed_type FROM (SELECT col_idx, count(*) AS nt FROM ff GROUP BY col_idx, tc) GROUP BY col_idx) USING (col_idx) JOIN (SELECT col_idx, avg(dirty::INT)::DOUBLE AS dirty_value FROM ff GROUP BY col_idx) USING (col_idx)),
 nl AS (SELECT *, CASE WHEN score > 0.4 THEN 'strong' WHEN score >= 0.2 THEN 'light' ELSE 'none' END AS level FROM ns)"""
    shape, other = f"{SHAPES}[p_partkey % 8 + 1]", f"{SHAPES}[floor(p_partkey / 3)::BIGINT % 8 + 1]"
    feats = f"hd AS (SELECT name, toks, norm, {_groups('norm')} AS grps, {_family('name')} AS family, {_alignment('name', repr('amount'))} AS alignment FROM (SELECT *, array_to_string(toks, ' ') AS norm FROM (SELECT name, {_tokens('name')} AS toks FROM (SELECT unnest({SHAPES}) AS name))))"
    why = f"CASE WHEN x.norm = '' OR y.norm = '' THEN 'Header missing on one side' ELSE concat_ws('; ', CASE WHEN x.norm = y.norm THEN 'Normalized headers match exactly' END, CASE WHEN {_jaccard('x.toks', 'y.toks')} > 0.35 THEN 'Meaningful header token overlap detected' END, CASE WHEN {_jaccard('x.grps', 'y.grps')} > 0 THEN 'Financial synonym groups overlap' END) END"
    both = "dd AS MATERIALIZED (SELECT 'A' AS side, * FROM da UNION ALL SELECT 'B', * FROM db)"
    names = ", ".join(f"('{s}', {i}, '{c.split(':')[0]}')" for s, t in (("A", "customer"), ("B", "supplier")) for i, c in enumerate(TABLES[t]))
    stat = f"st AS (SELECT * FROM ({_moments('dd', 'side, col_idx')}) JOIN (SELECT side, col_idx, count(value) AS nd FROM dd GROUP BY ALL) USING (side, col_idx))"
    reasons = "concat_ws('; ', CASE WHEN o > 0.8 THEN 'High normalized value overlap' WHEN o > 0.45 THEN 'Partial value overlap found' END, CASE WHEN nm > 0.65 THEN 'Numeric distribution appears aligned' END, CASE WHEN px > 0.5 THEN 'Common value prefix/suffix patterns detected' END, CASE WHEN few THEN 'Low distinct value volume; confidence reduced' END)"
    kinds = "CASE type_score WHEN 100 THEN 'Inferred types are identical' WHEN 72 THEN 'Inferred financial types are compatible' WHEN 40 THEN 'One side has uncertain type inference' ELSE 'Inferred types appear incompatible' END"
    return {
        "pattern_hints": f"WITH {values(events)}, {hints} SELECT col_idx, coalesce(sample, '') AS sample, hints FROM hn",
        "normalization_score": f"WITH {NOISY}, {values(noisy)}, {score} SELECT col_idx, round(format_difference, 6) AS format_difference, round(mixed_type, 6) AS mixed_type, round(dirty_value, 6) AS dirty_value, round(score, 6) AS score, level FROM nl",
        "header_similarity": f"WITH {feats} SELECT p_partkey, {_header_score('x', 'y')} AS score, {why} AS reasons, array_to_string(x.grps, ',') AS \"groups\", y.family, x.alignment FROM part JOIN hd x ON x.name = {shape} JOIN hd y ON y.name = {other}",
        "profile_records": f"""WITH {NOISY}, {values(noisy)}, {hints}, {score}, pd AS (SELECT 'A' AS side, col_idx, value, count(*) AS cnt FROM v GROUP BY ALL), pn(side, col_idx, name) AS (VALUES ('A', 0, 'o_orderkey'), ('A', 1, 'raw')), {_typed('pd', 'pn', 'ty')},
 tp AS (SELECT col_idx, string_agg(value, '|' ORDER BY r) AS top FROM (SELECT *, row_number() OVER (PARTITION BY col_idx ORDER BY cnt DESC, first, value) AS r FROM dv) WHERE r <= 5 GROUP BY col_idx), fv AS (SELECT col_idx, string_agg(lower(trim(value)), '|' ORDER BY r) AS first FROM ff GROUP BY col_idx)
 SELECT col_id, name AS original_name, norm AS normalized_name, observed_type, column_type, nv AS n_values, nd AS n_distinct, sample, hints, top, first, round(score, 6) AS score, level FROM ty JOIN hn USING (col_idx) JOIN tp USING (col_idx) JOIN fv USING (col_idx) JOIN nl USING (col_idx)""",
        "value_similarity": f"""WITH {_dict('customer', 'da')}, {_dict('supplier', 'db')}, {both}, pn(side, col_idx, name) AS (VALUES {names}), {_typed('dd', 'pn', 'ty')}, {stat},
 sg AS (SELECT DISTINCT side, col_idx, value, substr(value, 1, 3) AS pre FROM dd WHERE value IS NOT NULL), pre AS (SELECT DISTINCT side, col_idx, pre FROM sg), np AS (SELECT side, col_idx, count(*) AS n FROM pre GROUP BY ALL),
 sv AS (SELECT x.col_idx AS a, y.col_idx AS b, count(*) AS c FROM sg x JOIN sg y ON x.value = y.value AND x.side = 'A' AND y.side = 'B' GROUP BY ALL), sp AS (SELECT x.col_idx AS a, y.col_idx AS b, count(*) AS c FROM pre x JOIN pre y ON x.pre = y.pre AND x.side = 'A' AND y.side = 'B' GROUP BY ALL),
 w AS (SELECT *, least(100, floor((o * 45 + j * 25 + px * 10 + nm * 20) * CASE WHEN few THEN 0.85 ELSE 1 END + 0.5))::DOUBLE AS value_score, {reasons} AS value_reasons FROM (SELECT p.col_idx AS col_a, q.col_idx AS col_b, coalesce(sv.c::DOUBLE / least(p.nd, q.nd), 0) AS o, coalesce(sv.c::DOUBLE / (p.nd + q.nd - sv.c), 0) AS j, coalesce(sp.c::DOUBLE / (np.n + nq.n - sp.c), 0) AS px, {_numeric('p', 'q')} AS nm, p.nd < 5 OR q.nd < 5 AS few
   FROM (FROM st WHERE side = 'A') p CROSS JOIN (FROM st WHERE side = 'B') q JOIN np ON np.side = 'A' AND np.col_idx = p.col_idx JOIN np nq ON nq.side = 'B' AND nq.col_idx = q.col_idx LEFT JOIN sv ON sv.a = p.col_idx AND sv.b = q.col_idx LEFT JOIN sp ON sp.a = p.col_idx AND sp.b = q.col_idx))
 SELECT col_a, col_b, value_score, value_reasons, {kinds} AS type_reason, header_score, type_score, metadata_score, round(0.30 * header_score + 0.45 * value_score + 0.20 * type_score + 0.05 * metadata_score, 6)::DOUBLE AS weighted_total FROM (SELECT w.*, {_header_score('s', 't')} AS header_score, {_compatible('s.observed_type', 't.observed_type')} AS type_score, floor((1 - abs(s.null_ratio - t.null_ratio)) * 100 + 0.5)::BIGINT AS metadata_score
  FROM w JOIN ty s ON s.side = 'A' AND s.col_idx = col_a JOIN ty t ON t.side = 'B' AND t.col_idx = col_b)""",
    }
