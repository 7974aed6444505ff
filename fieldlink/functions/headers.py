"""Headers: normal forms, synonyms, expected types and similarity."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations, stop words and synonym groups of headers (fixed values).
ABBREVIATIONS = {"txn": "transaction", "ref": "reference", "no": "number", "num": "number", "amt": "amount", "dr": "debit", "cr": "credit", "ccy": "currency", "curr": "currency", "acct": "account", "a": "account", "desc": "description", "dt": "date", "ts": "timestamp"}
STOP_WORDS = ["column", "field", "value"]
SYNONYM_GROUPS = {
    "transaction_id": ["txn ref", "transaction ref", "transaction id", "trace id", "stan", "rrn", "reference no", "transaction identifier"],
    "reference_number": ["ref", "reference", "reference number", "ref no", "retrieval ref"],
    "amount": ["amount", "txn amount", "auth amount", "clearing amount", "posted amount"],
    "debit_amount": ["dr", "debit", "withdrawal", "debit amount"],
    "credit_amount": ["cr", "credit", "deposit", "credit amount"],
    "currency": ["curr", "ccy", "currency code", "currency"],
    "date": ["txn date", "value date", "posting date", "settlement date", "book date"],
    "datetime": ["txn datetime", "timestamp", "transaction timestamp"],
    "account_number": ["acct", "a/c", "account no", "account number", "iban"],
    "masked_pan": ["masked pan", "card", "card number", "pan"],
    "merchant_name": ["merchant", "merchant name", "acceptor name"],
    "narration": ["narration", "description", "remarks", "details"],
    "status_code": ["status", "status code", "response code"],
    "auth_code": ["auth", "auth code", "authorization code"],
    "customer_id": ["customer", "customer id", "cust id"],
    "branch_code": ["branch", "branch code", "sol id"],
}
#: A second dictionary: families of header texts (fixed values).
FAMILIES = {
    "amount": ["txn amount", "auth amount", "posted amount", "replaced amount", "amt", "transaction amount"],
    "transaction_id": ["txn id", "trace id", "reference id", "rrn", "stan", "trans id"],
    "card_number": ["pan", "masked pan", "card no", "card #"],
    "date": ["transaction date", "posting date", "entry date", "value date"],
    "merchant_text": ["merchant", "merchant name", "merchant desc", "merchant description"],
    "narration_text": ["narration", "description", "particulars", "details"],
    "response_code": ["auth code", "status code", "resp code"],
    "currency": ["ccy", "currency code", "currency"],
    "debit_amount": ["debit", "dr"],
    "credit_amount": ["credit", "cr"],
}
#: Expected type by what the original header contains, first hit wins (fixed values).
EXPECTED = [
    ("amount|amt|value", "amount"), ("date|datetime|timestamp|time", "datetime"), (r"part[_\s-]?tran[_\s-]?type|tran[_\s-]?type|debit[_\s-]?credit|drcr", "debit_credit"),
    ("account|acct|iban", "account_number"), ("card|pan", "card_number"), ("rrn|stan|trace|ref|transaction id|txn id", "transaction_id"),
    ("narration|description|merchant|particular", "narration_text"), ("currency|ccy|curr", "currency"), ("status|response", "status_code"),
]


def split_tokens(c: Column) -> Column:
    spaced = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(spaced, r"[_.\-/\s]+"), lambda t: t != "")


def tokens_of(c: Column) -> Column:
    """Lower-case tokens, abbreviations written out, stop words dropped."""
    full = F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv))
    bare = F.filter(F.transform(split_tokens(c), lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9]", "")), lambda t: t != "")
    return F.filter(F.transform(bare, lambda t: F.coalesce(full[t], t)), lambda t: ~t.isin(STOP_WORDS))


def normalize(c: Column) -> Column:
    return F.array_join(tokens_of(c), " ")


def _term(text: str) -> str:
    """normalize() of a fixed term, while the plan is built."""
    parts = [re.sub("[^a-z0-9]", "", t.lower()) for t in re.split(r"[_.\-/\s]+", text)]
    return " ".join(x for t in parts if t for x in [ABBREVIATIONS.get(t, t)] if x not in STOP_WORDS)


def synonym_groups(norm: Column) -> Column:
    """Groups of which a term stands in the normalized header."""
    hit = lambda terms: F.coalesce(norm.rlike("|".join(f"{re.escape(t)}" for t in dict.fromkeys(map(_term, terms)))), F.lit(False))
    return F.array_compact(F.array(*(F.when(hit(terms), group) for group, terms in SYNONYM_GROUPS.items())))


def family(c: Column) -> Column:
    """The header's families with all their texts; the normalized header alone if it has none."""
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]", " "), r"\s+", " "))
    found = F.concat(*(F.when(norm.isin([key, *terms]), F.array(*map(F.lit, [key, *terms]))).otherwise(F.array().cast("array<string>")) for key, terms in FAMILIES.items()))
    return F.when(F.size(found) > 0, found).otherwise(F.array(norm))


def expected_type(c: Column) -> Column:
    out = F.lit("unknown")
    for pattern, kind in reversed(EXPECTED):
        out = F.when(F.lower(c).rlike(pattern), kind).otherwise(out)
    return out


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """0 to 100 for two headers, each given by its norm, tokens and groups."""
    x, y = a["norm"], b["norm"]
    score = F.when(x == y, 60.0).otherwise(0.0) + jaccard(a["tokens"], b["tokens"]) * 25 + jaccard(a["groups"], b["groups"]) * 15
    return F.when((x == "") | (y == ""), F.lit(0.0)).otherwise(F.least(F.lit(100.0), F.floor(score + 0.5).cast("double")))


def similarity_reasons(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Why two headers are alike; the texts are fixed values."""
    x, y = a["norm"], b["norm"]
    given = F.array_compact(F.array(
        F.when(x == y, "Normalized headers match exactly"), F.when(jaccard(a["tokens"], b["tokens"]) > 0.35, "Meaningful header token overlap detected"),
        F.when(jaccard(a["groups"], b["groups"]) > 0, "Financial synonym groups overlap"),
    ))
    return F.when((x == "") | (y == ""), F.array(F.lit("Header missing on one side"))).otherwise(given)
