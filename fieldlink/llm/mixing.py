"""Operator 10: mixing sources to target weights by Sainte-Laguë apportionment.

Documents are dealt by a seeded hash of id and text to shards, those of a smaller source to fewer of them,
so that its lines are long; in a shard, a source's documents
stand in seeded order on one line of words, cut into blocks. A shard has blocks of one size,
in which its shortest line still has LEAST_BLOCKS. It
allots them to sources one by one to the highest quotient
weight / (2 * blocks so far + 1), which gives each (shard, source) a whole number
of blocks. Those are drawn from its line: full passes first, then a seeded
systematic draw of the rest, so a block is taken at most once more than another
and nothing is sorted or listed by block.

Targets: `epochs` times all words, shared by the sources' weights; no source gets
more than `most` times its words, and what that leaves over is shared again.

Sizes are whole numbers and all orders are by hash and id, so reruns agree. A null
source is one of its own, last in order. A null or empty text has size 0 and is
never taken; very long texts count whole. Rows that repeat an id, or have none, each have a place of their own; where more than
a shard's documents are the same in id and text they are dealt out by row. Only
id, text and source are read by plan(); mixed() gives back all columns. Empty input
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: A line of fewer blocks halves its shard's blocks, down to one word.
LEAST_BLOCKS = 64


def size_of(text: Column) -> Column:
    """Number of words, as runs that start at the text's start or after a space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, epochs: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target) from (source, size); a row for each source.

    Sources fill up to `most` times their size in the order of size / weight; the
    level at which the others stand is that of the first that doesn't fill up.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    names = per.withColumn("_at", F.row_number().over(by_name) - 1)
    chosen = F.array(*(F.lit(float(w)) for w in weights))
    weighted = names.withColumn("weight", F.element_at(chosen, (F.col("_at") % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") * 1.0 / F.col("weight"), "_at")
    all_ = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = weighted.withColumn("_total", F.sum("source_size").over(all_) * epochs).withColumn("_full", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most)
    open_ = filled.withColumn("_open", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = open_.withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_open"))
    fits = level.withColumn("_fits", F.when(F.col("_level") * F.col("weight") <= F.col("source_size") * most, F.struct(F.col("source_size") * 1.0 / F.col("weight"), "_at", "_level")))
    water = fits.withColumn("_water", F.min("_fits").over(all_)["_level"])
    return water.select("source", "source_size", "weight", F.coalesce(F.least(F.col("_water") * F.col("weight"), F.col("source_size") * F.lit(float(most))), F.col("source_size") * F.lit(float(most))).alias("target"))


def block_of(words: Column, block: int) -> Column:
    """Words in a block of a line of so many words."""
    sizes = [block >> k for k in range(block.bit_length() - 1)]
    return F.coalesce(*(F.when(words >= LEAST_BLOCKS * b, F.lit(b)) for b in sizes), F.lit(1)).cast("long")


def quotas(lines: DataFrame, block: int, most: int) -> DataFrame:
    """(shard, source, words, block, blocks, quota) from (shard, source, words, share): Sainte-Laguë in each shard, over blocks of one size.

    share is what the source should take in the shard, in words. A shard's seats are
    its shares' sum in blocks. Were the divisor one block, a party would get
    floor(share / block + 1/2) seats, and all of them half the parties more or less
    than there are. The divisor that fits is off by a share (parties + 1) / (2 seats)
    at most, and so each party's seats by that share of them and one. Seats below
    that range are given, those in it go by highest quotient.
    """
    own, party = Window.partitionBy("shard"), F.col("share") / F.col("block")
    cut = lines.withColumn("block", F.min(block_of(F.col("words"), block)).over(own)).withColumn("blocks", F.ceil(F.col("words") / F.col("block")))
    n = cut.withColumn("_seats", F.round(F.sum("share").over(own) / F.col("block"))).withColumn("_parties", F.count("*").over(own))
    ranged = n.withColumn("_off", F.ceil(party * (F.col("_parties") + 1) / F.greatest(2 * F.col("_seats"), F.lit(1))) + 1)
    based = ranged.withColumn("_base", F.greatest(F.floor(party + 0.5) - F.col("_off"), F.lit(0)))
    left = based.withColumn("_left", F.col("_seats") - F.sum("_base").over(own))
    tried = left.withColumn("_next", F.explode(F.sequence(F.lit(0), (2 * F.col("_off") + 1).cast("int"))))
    quotient = party / (2 * (F.col("_base") + F.col("_next")) + 1)
    ranked = tried.withColumn("_rank", F.row_number().over(own.orderBy(quotient.desc(), F.col("source").asc_nulls_last(), F.col("_next"))))
    seats = ranked.groupBy("shard", "source", "words", "block", "blocks", "_base").agg(F.count_if(F.col("_rank") <= F.col("_left")).alias("_more"))
    return seats.select("shard", "source", "words", "block", "blocks", F.least(F.col("_base") + F.col("_more"), most * F.col("blocks")).cast("long").alias("quota"))


def seeded(*parts: Column, seed: int) -> Column:
    """A whole number from 0 to 2^32 - 1."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts))), 1, 8), 16, 10).cast("long")


def drawn_before(at: Column) -> Column:
    """Blocks before block `at` that the systematic draw takes, of _rest among `blocks`, from the start _from."""
    return F.floor((at + F.col("_from")) * F.col("_rest") / F.col("blocks")) - F.floor(F.col("_from") * F.col("_rest") / F.col("blocks"))


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, epochs: float = 1.5, most: int = 2, block: int = 64, shard_docs: int = 1_000, seed: int = 42, key: str | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, source, size, source_size, target, taken, and where it stands:
    start (on its line), block, blocks, quota, _passes, _rest and _from of its line. A `key` that no two rows share goes through."""
    row = F.monotonically_increasing_id() if key is None else F.col(f"`{key}`")
    sized = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size_of(F.col(f"`{text}`")).alias("size"), F.md5(F.col(f"`{text}`").cast("binary")).alias("_h"), row.alias("_key"))
    rows = common.written(sized, "sizes")
    aim = common.written(targets(rows, weights, epochs, float(most)), "targets")
    shards = max(1, -(-rows.count() // shard_docs))
    # a source's shards: as many as give it lines of LEAST_BLOCKS blocks
    lines = aim.select(F.col("source").alias("_source"), F.greatest(F.lit(1), F.least(F.lit(shards), F.floor(F.col("source_size") / (LEAST_BLOCKS * block)))).alias("_lines"), (seeded(F.col("source"), seed=seed + 3) % shards).alias("_first"))
    many = rows.groupBy("doc_id", "_h").count().where(F.col("count") > shard_docs).select(F.col("doc_id").alias("_id"), F.col("_h").alias("_same"), F.lit(True).alias("_many"))
    copies = common.written(rows.join(many, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_h").eqNullSafe(F.col("_same")), "left").drop("_id", "_same"), "sizes")
    known = [F.col("doc_id"), F.col("_h")]
    place = F.when(F.col("_many"), seeded(*known, F.col("_key"), seed=seed)).otherwise(seeded(*known, seed=seed)) % F.col("_lines")
    dealt = copies.join(lines, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", ((F.floor(place * shards / F.col("_lines")) + F.col("_first")) % shards).cast("int")).drop("_source", "_lines", "_first", "_many")
    dealt = common.written(dealt, "dealt")
    common.deleted(docs.sparkSession, [rows._written_at, copies._written_at])
    words = dealt.groupBy("shard", "source").agg(F.sum("size").alias("words")).where("words > 0")
    shared = words.join(aim, words["source"].eqNullSafe(aim["source"])).select("shard", words["source"], "words", (F.col("target") * F.col("words") / F.col("source_size")).alias("share"))
    given = common.written(quotas(shared, block, most), "quotas")
    line = Window.partitionBy("shard", "source").orderBy(seeded(*known, seed=seed + 1), F.col("doc_id").asc_nulls_first(), "_h", "size", "_key")
    placed = dealt.withColumn("start", F.sum("size").over(line) - F.col("size"))
    g = given.select(F.col("shard").alias("_shard"), F.col("source").alias("_source"), "block", "blocks", "quota")
    joined = placed.join(g, (F.col("shard") == F.col("_shard")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_shard", "_source")
    own = joined.withColumn("block", F.coalesce("block", F.lit(1))).withColumn("blocks", F.coalesce("blocks", F.lit(1)).cast("long")).withColumn("quota", F.coalesce("quota", F.lit(0)))
    drawn = own.withColumn("_passes", F.floor(F.col("quota") / F.col("blocks"))).withColumn("_rest", F.col("quota") % F.col("blocks")).withColumn("_from", seeded(F.col("shard"), F.col("source"), seed=seed + 2) % F.col("blocks"))
    # words of the document in drawn blocks: whole blocks by their number, less what lies outside at either end
    block = F.col("block")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    at_end = lambda b: drawn_before(b + 1) - drawn_before(b)
    some = (drawn_before(last + 1) - drawn_before(first)) * block - at_end(first) * (F.col("start") - first * block) - at_end(last) * ((last + 1) * block - F.col("start") - F.col("size"))
    taken = F.col("_passes") * F.col("size") + F.when(F.col("size") > 0, some).otherwise(0)
    full = drawn.withColumn("taken", taken.cast("long"))
    a = aim.select(F.col("source").alias("_source"), "source_size", "target")
    out = full.join(a, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_h")
    return out if key is not None else out.drop("_key")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = 64, seed: int = 42, **how) -> DataFrame:
    """The mix as documents: a row with the whole text for each full pass, and one with the words of its drawn blocks if any.

    Columns are those of docs, whatever their names. Rows of docs that share an id each
    get the words of their own place.
    """
    plain, names = common.positional(docs)
    own = names[text]
    rows = common.numbered(plain, "rows")
    where = plan(rows, doc_id=names[doc_id], text=own, source=names[source], block=block, seed=seed, key="_row", **how).where("taken > 0")
    where = where.select(F.col("_key").alias("_row"), "size", "start", "taken", F.col("block").alias("_block"), "blocks", "_passes", "_rest", "_from")
    both = rows.join(where, "_row")
    part = F.col("taken") - F.col("_passes") * F.col("size")
    copies = both.withColumn("_part", part).withColumn("_copy", F.explode(F.sequence(F.lit(1), (F.col("_passes") + (F.col("_part") > 0).cast("long")).cast("int"))))
    words = F.regexp_extract_all(F.col(own), F.lit(WORD), F.lit(0))
    at = lambda i: F.floor((F.col("start") + i) / F.col("_block"))
    some = F.array_join(F.filter(words, lambda w, i: drawn_before(at(i) + 1) - drawn_before(at(i)) == 1), " ")
    whole = (F.col("_copy") <= F.col("_passes")) | (F.col("_part") == F.col("size"))
    out = copies.withColumn(own, F.when(whole, F.col(own)).otherwise(some))
    if "n_chars" in docs.columns:
        out = out.withColumn(names["n_chars"], F.char_length(F.col(own)).cast(docs.schema["n_chars"].dataType))
    return common.named_back(out, names)
