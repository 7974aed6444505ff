"""Operator 4: license scans by diagonal voting.

All rolling word k-grams of all texts are joined in Spark, by hash, to the k-grams of
license templates at their positions. A hit votes for the diagonal text position -
template position; a diagonal holds each template position at most once, so votes are
distinct positions.

Phrases and short notices are exact templates: a diagonal that all their k-grams vote
for is a place. For whole texts, the diagonals up to `slack` words to either side of a
diagonal merge (words put in or left out shift the rest of a text), and the span is
verified by aligning it: the template's words that hits in it cover, each counted
once, must be `share` of the template. A diagonal that is as good as any other within
`slack` stands for a span, the first one of equals, so a dense run of places gives a
span for every `slack` words at least and hides none of another diagonal. Of whole
texts of equal first word the fullest counts, then the longer, then the earlier in the
list.

Templates are a fixed table, broadcast; exploded k-grams are never shuffled, only hits
are. Hashes are 64 bits over words; a false hit among 10^14 words is not to be
expected. A null or empty text has 0 words and no label; very long texts are scanned whole. Repeated rows each get a row;
rows with the same id and text share their hits. Only the id and the text of a row are
read: further columns don't take part, whatever their names. An empty table gives no
rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .license_texts import NOTICES, PHRASES, TEXTS

K = 4
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before letters are lowered.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLACK, SHARE = 12, 0.75


def lower_words(text: str) -> list[str]:
    """The words of a template."""
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def word_hashes(text: Column) -> Column:
    words = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda x: F.xxhash64(x))


def _paired(first: str, then: str, apart: int) -> Column:
    """Hashes of first[i] and then[i + apart] for each place i that has both."""
    n = f"greatest(size({then}) - {apart}, 0)"
    return F.expr(f"zip_with(slice({first}, 1, {n}), slice({then}, {apart + 1}, {n}), (a, b) -> xxhash64(a, b))")


def _hash(*values: str | int) -> int:
    """Spark's xxhash64 of a word, or of two hashes."""
    import xxhash

    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode("utf-8", "surrogatepass") if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def gram_hashes(words: list[str]) -> tuple[list[int], list[int], list[int]]:
    """64-bit hashes of each word, of each two and of each K = 4 words that follow one another."""
    one = [_hash(w) for w in words]
    two = [_hash(a, b) for a, b in zip(one, one[1:])]
    return one, two, [_hash(a, b) for a, b in zip(two, two[2:])]


PLACES = "array<struct<template:int,t_pos:int,k:int>>"


def template_places(spark: SparkSession, templates: list[tuple]) -> dict[int, DataFrame]:
    """For each width 1, 2 and K the table (h, places): where in the templates (words, label, kind) a k-gram stands."""
    found: dict[int, dict[int, list]] = {1: {}, 2: {}, K: {}}
    for i, (words, _, kind) in enumerate(templates):
        k = K if kind == "text" and len(words) >= K else min(2, len(words))
        for at, h in enumerate(dict(zip((1, 2, K), gram_hashes(words)))[k]):
            found[k].setdefault(h, []).append((i, at, k))
    return {k: spark.createDataFrame([(h, p) for h, p in rows.items()], f"h{k} long, p{k} {PLACES}") for k, rows in found.items() if rows}


def hits(docs: DataFrame, places: dict[int, DataFrame]) -> DataFrame:
    """(key, template, t_pos, k, pos): every k-gram place of docs that agrees with a template place."""
    # explode(array(x)) holds x as computed once
    own = docs.select("key", F.explode(F.array(word_hashes(F.col("text")))).alias("h1"))
    own = own.select("key", "h1", F.explode(F.array(_paired("h1", "h1", 1))).alias("h2"))
    own = own.select("key", "h1", "h2", F.explode(F.array(_paired("h2", "h2", 2))).alias(f"h{K}"))
    found = own.select("key", F.posexplode(F.arrays_zip(*(f"h{k}" for k in places))).alias("pos", "_h")).select("key", "pos", "_h.*")
    for k, table in places.items():
        found = found.join(F.broadcast(table), f"h{k}", "left")
    some = reduce(lambda a, b: a | b, (F.col(f"p{k}").isNotNull() for k in places))
    both = F.concat(*(F.coalesce(f"p{k}", F.array().cast(PLACES)) for k in places))
    return found.where(some).select("key", "pos", F.inline(both)).dropDuplicates(["key", "template", "pos", "t_pos"])


def diagonals(found: DataFrame, templates: list[tuple]) -> DataFrame:
    """Votes by offset diagonal: the template positions, of which there are no more than the template has words."""
    rows = [(i, label, kind, len(words)) for i, (words, label, kind) in enumerate(templates)]
    named = found.join(F.broadcast(found.sparkSession.createDataFrame(rows, "template int, label string, kind string, n_words int")), "template")
    return named.groupBy("key", "template", "label", "kind", "n_words", "k", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.array_sort(F.collect_set("t_pos")).alias("at"))


def spans(votes: DataFrame, slack: int, share: float) -> DataFrame:
    """(key, template, label, kind, first, last, score): places of exact templates, and verified spans of whole texts."""
    exact = votes.where((F.col("kind") != "text") & (F.size("at") == F.col("n_words") - F.col("k") + 1))
    places = exact.select("key", "template", "label", "kind", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("n_words") - 1).alias("last"), F.lit(1.0).alias("score"))
    near = Window.partitionBy("key", "template").orderBy("diagonal").rangeBetween(-slack, slack)
    merged = votes.where("kind = 'text'").withColumn("_near", F.collect_list(F.struct("diagonal", "at")).over(near))
    covered = F.expr("size(array_distinct(flatten(transform(flatten(transform(_near, x -> x.at)), p -> sequence(p, p + k - 1)))))")
    aligned = merged.withColumn("score", covered / F.col("n_words")).where(F.col("score") >= share)
    rank = F.struct("score", F.size("at").alias("_own"), (-F.col("diagonal")).alias("_d"))
    tops = aligned.withColumn("_rank", rank).withColumn("_best", F.max("_rank").over(near)).where(F.col("_rank") == F.col("_best"))
    ends = F.expr("array_min(transform(_near, x -> x.diagonal + x.at[0]))").alias("first"), F.expr("array_max(transform(_near, x -> x.diagonal + element_at(x.at, -1))) + k - 1").alias("last")
    whole = tops.select("key", "template", "label", "kind", *ends, "score", "n_words")
    fullest = Window.partitionBy("key", "first").orderBy(F.col("score").desc(), F.col("n_words").desc(), "template")
    return places.unionByName(whole.withColumn("_nth", F.row_number().over(fullest)).where("_nth = 1").drop("_nth", "n_words"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases=None, notices=None, texts=None, slack: int = SLACK, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """(found, rows): found has each span (key, label, kind, first, last, score), rows has each row's id, key and number of words. kind: phrase, notice or text."""
    given = [(phrases if phrases is not None else PHRASES, "phrase"), (notices if notices is not None else NOTICES, "notice"), (texts if texts is not None else TEXTS, "text")]
    templates = [(lower_words(t), label, kind) for some, kind in given for t, label in some]
    if not all(ws for ws, _, _ in templates):
        raise ValueError("a phrase or template has no word")
    key = F.struct(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("h"))
    keyed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), key.alias("key"), F.col(f"`{text}`").alias("text"))
    found = spans(diagonals(hits(keyed, template_places(docs.sparkSession, templates)), templates), slack, share)
    n_words = F.coalesce(F.regexp_count("text", F.lit(ANY_WORD)), F.lit(0)).cast("long")
    return found.select("key", "label", "kind", "first", "last", "score"), keyed.select("doc_id", "key", n_words.alias("n_words"))


def labelled(docs: DataFrame, **how) -> DataFrame:
    """A row for each row of docs with what stands in it: doc_id, n_words, the places and labels of phrases, all labels and the best score."""
    found, rows = scan(docs, **how)
    own = F.when(F.col("kind") == "phrase", F.col("first"))
    per = found.groupBy("key").agg(
        F.count(own).alias("n_base"), F.min(own).cast("long").alias("first_word"), F.max(own).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "phrase", F.col("label")))).alias("base"), F.array_sort(F.collect_set("label")).alias("all"), F.max("score").alias("score"),
    )
    both = rows.join(per, rows["key"].eqNullSafe(per["key"]), "left")
    return both.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce(F.array_join("base", ","), F.lit("")).alias("base_labels"), F.coalesce(F.array_join("all", ","), F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
