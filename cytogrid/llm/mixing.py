"""Mixing sources to target weights with hash thresholds.

Every document has a hash; a source takes whole passes over its documents and,
for what is left of its target, the documents whose hash lies below a threshold.
Thresholds are found by histograms: sizes are summed by source and hash bucket,
the running sums name the bucket where the budget ends, and only that bucket is
divided again. A larger budget moves the threshold up, so its documents contain
those of a smaller one. Nothing is sorted and no source is gathered.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cytogrid.llm.common import WORD, durable, join_small, salted_rank, stored
from cytogrid.operators.ordering import OrderedBlocks, global_rank

HASH_BITS = 60
STEP_BITS = 12
WEIGHTS = (3, 1, 2)


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    """32 digits of the MD5 of id and text; nulls count as empty."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.md5(F.concat(part(doc_id), F.lit("|"), F.md5(part(text))))


def places(digest: Column) -> Column:
    """The first 60 bits of a digest."""
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def numbered(rows: DataFrame, key: str, digest: str, name: str) -> DataFrame:
    """Adds ``name``, the 60 bits that decide over each row. Rows alike in ``key`` and ``digest`` are numbered, and but for the first get bits of their own, so that a hot row can be cut."""
    again = stored(rows.groupBy(key, digest).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, digest))
    single = join_small(rows, again, [key, digest], "left_anti").withColumn(name, places(F.col(digest)))
    if again.isEmpty():
        return single
    repeated = stored(join_small(rows, again, [key, digest], "left_semi").withColumn("__at", F.monotonically_increasing_id()))
    ranked = salted_rank(repeated, [key, digest], [F.col("__at")], "__copy", F.col("__at"))
    own = F.when(F.col("__copy") == 0, F.col(digest)).otherwise(F.md5(F.concat(F.col(digest), F.lit("#"), F.col("__copy").cast("string"))))
    return single.unionByName(ranked.withColumn(name, places(own)).drop("__at", "__copy"))


def source_key(source: str = "source") -> Column:
    """A join key in which null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Target of each source (key, source, source_size): weights repeat over sources in code-point order, null last.

    Raising all targets in proportion to their weights until the sum is reached,
    each stopping at ``most`` times its source's size, is the same as resharing
    the excess again and again. The common factor is the largest of the factors
    that hold if the sources with the smallest room per weight have stopped.
    """
    ranked = global_rank(sources, [F.col("source").asc_nulls_last()], "rank")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("room", F.lit(float(most)) * F.col("source_size")).withColumn("per_weight", F.col("room") / F.col("weight"))
    blocks = OrderedBlocks(ranked, ["per_weight", "rank"]).running("rooms", "sum", "room").running("weights", "sum", "weight")
    rows = durable(blocks.df)
    total = rows.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    budget = share * (total["size"] or 0)
    factor = rows.agg(F.max((F.lit(budget) - (F.col("rooms") - F.col("room"))) / (F.lit(total["weight"] or 1.0) - (F.col("weights") - F.col("weight"))))).first()[0] or 0.0
    return rows.select("key", "source", "source_size", F.least("room", F.lit(factor) * F.col("weight")).alias("target"))


def thresholds(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each source key the whole passes and the hash up to which a further copy is taken.

    ``sized`` (key, size, hash) is durable, ``wanted`` has key, source_size and target.
    """
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = wanted.select("key", full.alias("passes"), (F.col("target") - full * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("prefix"),
                          F.lit(False).alias("done"))
    bits = 0
    while bits < HASH_BITS:
        state = durable(state)
        if bits and state.where(~F.col("done")).isEmpty():
            break
        shift = HASH_BITS - bits - STEP_BITS
        rows = join_small(sized, state.where(~F.col("done")), ["key"], "inner").where(F.shiftright("hash", HASH_BITS - bits) == F.col("prefix"))
        buckets = rows.groupBy("key", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        upto = F.sum("n").over(W.partitionBy("key").orderBy("bucket"))
        crossing = (join_small(buckets.withColumn("upto", upto), state.select("key", "left"), ["key"], "inner").where(F.col("upto") > F.col("left"))
                    .groupBy("key").agg(F.min(F.struct("bucket", "n", "lo", "hi", (F.col("upto") - F.col("n")).alias("below"))).alias("b")))
        after = F.col("left") - F.col("b.below")
        single = (F.col("b.lo") == F.col("b.hi"))
        # a single hash is taken if that ends nearer to the target than leaving it
        take = (after > 0) & (F.col("b.n") - after < after)
        state = join_small(state, crossing, ["key"]).select(
            "key", "passes", F.when(F.col("done"), F.col("left")).when(F.col("b").isNull(), 0.0).otherwise(after).alias("left"),
            F.when(F.col("done"), F.col("prefix")).when(F.col("b").isNull(), F.shiftleft(F.col("prefix") + 1, HASH_BITS - bits) - 1)
            .when(single, F.when(take, F.col("b.lo")).otherwise(F.col("b.lo") - 1)).otherwise(F.col("b.bucket")).alias("prefix"),
            (F.col("done") | F.col("b").isNull() | single).alias("done"))
        bits += STEP_BITS
    return durable(state.select("key", "passes", F.col("prefix").alias("threshold")))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, most: float = 2.0, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken of every document.

    A document is taken as often as its source passes over all of its documents,
    and once more if its hash is within the threshold. Repeated rows, null ids
    and null texts are documents of their own; a null source is a source. Other
    columns do not matter, and an empty table has no rows.
    """
    rows = stored(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(f"`{text}`").alias("size"), document_hash(f"`{doc_id}`", f"`{text}`").alias("digest"),
                              source_key(f"`{source}`").alias("key")))
    sized = stored(numbered(rows, "key", "digest", "hash").drop("digest"))
    wanted = durable(targets(sized.groupBy("key", "source").agg(F.sum("size").alias("source_size")), share, most, weights))
    plan = thresholds(sized, wanted)
    copies = F.col("passes") + (F.col("hash") <= F.col("threshold")).cast("long")
    return (join_small(sized, wanted.drop("source").join(plan, "key"), ["key"], "inner")
            .select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **parameters) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, as in ``mix``; columns as they were.

    ``docs`` is read twice. Of rows alike in id, text and source it does not matter which is taken.
    """
    marked = docs.withColumns({"__key": source_key(f"`{source}`"), "__digest": document_hash(f"`{doc_id}`", f"`{text}`")})
    keyed = numbered(marked, "__key", "__digest", "__hash")
    sized = stored(keyed.select(F.col(f"`{source}`").alias("source"), word_count(f"`{text}`").alias("size"), F.col("__hash").alias("hash"), F.col("__key").alias("key")))
    wanted = durable(targets(sized.groupBy("key", "source").agg(F.sum("size").alias("source_size")), **parameters))
    plan = thresholds(sized, wanted).select(F.col("key").alias("__key"), F.col("passes").alias("__passes"), F.col("threshold").alias("__threshold"))
    copies = (F.col("__passes") + (F.col("__hash") <= F.col("__threshold")).cast("long")).cast("int")
    taken = join_small(keyed, plan, ["__key"], "inner").where(copies > 0)
    return taken.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*[F.col(f"`{c}`") for c in docs.columns])
