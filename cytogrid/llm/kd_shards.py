"""Shards by a k-d tree over document metadata, with DataFrame functions alone.

Documents larger than an equal share get a shard each. The root holds all others.
A node that owes several shards is split along its widest metadata dimension at the
weighted median of bytes (the weighted quantile, where the shards do not divide
evenly) until each leaf is one shard. Medians are found by histograms: bytes are
summed over the cells between a node's bounds, and the cell that holds the median is
narrowed to its keys and divided again until it is one key. Nodes are a table that
rows are joined with, so the tree may have as many leaves as that table has room for.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cytogrid.llm.common import join_small, release, salted_rank, stored
from cytogrid.operators.ordering import global_rank

CELLS = 1024
VALUE_BITS = 30
TIE_BITS = 32


def div(a: Column, b: Column | int) -> Column:
    """Whole-number quotient; dividing as doubles would lose the low bits of a key."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def dense_rank(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the rank of each value among the distinct values of ``column``, from 1; null has 0."""
    ranks = stored(global_rank(rows.select(F.col(column)).where(F.col(column).isNotNull()).distinct(), [F.col(column)], name))
    return join_small(rows, ranks, [column]).withColumn(name, F.coalesce(name, F.lit(0)))


def with_keys(rows: DataFrame, values: list[Column]) -> DataFrame:
    """Adds k, an array of a key for each dimension: the value scaled to VALUE_BITS over its range, and below that a tie drawn from ``tie``."""
    named = rows.withColumns({f"v{i}": v.cast("double") for i, v in enumerate(values)})
    ends = named.agg(*[f(f"v{i}").alias(f"{n}{i}") for i in range(len(values)) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    scale = lambda i: F.lit(((1 << VALUE_BITS) - 1) / max((ends[f"hi{i}"] or 0) - (ends[f"lo{i}"] or 0), 1e-9))
    keys = [F.shiftleft(F.floor((F.col(f"v{i}") - F.lit(float(ends[f"lo{i}"] or 0))) * scale(i)).cast("long"), TIE_BITS) + F.col("tie") for i in range(len(values))]
    return named.withColumn("k", F.array(*keys)).drop(*[f"v{i}" for i in range(len(values))])


def set_apart(rows: DataFrame, shards: int) -> tuple[DataFrame | None, int]:
    """row and shard of the documents larger than an equal share of what the others and they leave, and how many there are (fewer than ``shards``)."""
    total, limit, n = rows.agg(F.sum("size")).first()[0] or 0, None, 0
    while True:
        share = (total - (limit[1] if limit else 0)) / max(shards - n, 1)
        found = rows.where(F.col("size") > share).agg(F.count(F.lit(1)), F.sum("size")).first()
        if found[0] == n:
            break
        n, limit = found[0], (share, found[1])
    if not n:
        return None, 0
    large = rows.where(F.col("size") > limit[0]).select("row")
    return stored(global_rank(large, ["row"], "rank").select("row", (F.lit(shards - 1) - (F.col("rank") - 1)).cast("int").alias("shard"))), n


def medians(placed: DataFrame, nodes: DataFrame, dims: int) -> DataFrame:
    """Each open node (node, first, leaves) with the dimension and the key it is cut at, and the leaves that go left.

    ``placed`` has node, size and k. A row goes left if its key is smaller than the cut.
    """
    opened = join_small(placed, nodes.select("node"), ["node"], "inner")
    value = lambda d: F.col("k")[d]
    ends = opened.groupBy("node").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), *[f(value(d)).alias(f"{m}{d}") for d in range(dims) for m, f in (("lo", F.min), ("hi", F.max))])
    width = lambda d: F.shiftright(f"hi{d}", TIE_BITS) - F.shiftright(f"lo{d}", TIE_BITS)
    widest = -F.greatest(*[F.struct(width(d).alias("w"), F.lit(-d).alias("d")) for d in range(dims)])["d"]
    state = nodes.join(ends, "node").withColumn("dim", widest)
    pick = lambda m: reduce(lambda other, d: F.when(F.col("dim") == d, F.col(f"{m}{d}")).otherwise(other), range(1, dims), F.col(f"{m}0"))
    goal = F.col("size") * div(F.col("leaves"), 2) / F.col("leaves")
    zero = F.lit(0).cast("long")
    state = stored(state.select("node", "first", "leaves", "n", "dim", goal.alias("goal"), pick("lo").alias("low"), (pick("hi") + 1).alias("high"), zero.alias("before"), zero.alias("n_before"),
                                F.lit(None).cast("long").alias("cut")))
    while not state.where("cut is null").isEmpty():
        step = F.greatest(F.lit(1).cast("long"), div(F.col("high") - F.col("low") + (CELLS - 1), CELLS))
        within = join_small(placed, state.where("cut is null").select("node", "dim", "low", "high", step.alias("step")), ["node"], "inner").withColumn("key", F.element_at("k", F.col("dim") + 1))
        cells = (within.where("key >= low and key < high").groupBy("node", div(F.col("key") - F.col("low"), F.col("step")).alias("cell"))
                 .agg(F.sum("size").alias("own"), F.count(F.lit(1)).alias("n_own"), F.min("key").alias("lo"), F.max("key").alias("hi")))
        over = W.partitionBy("node").orderBy("cell")
        sums = cells.withColumn("upto", F.sum("own").over(over)).withColumn("n_upto", F.sum("n_own").over(over))
        crossing = join_small(sums, state.select("node", "goal", "before"), ["node"], "inner").where(F.col("before") + F.col("upto") > F.col("goal"))
        crossing = crossing.groupBy("node").agg(F.min(F.struct("cell", "own", "n_own", "lo", "hi", (F.col("upto") - F.col("own")).alias("below"), (F.col("n_upto") - F.col("n_own")).alias("n_below"))).alias("c"))
        one, before = F.col("c.lo") == F.col("c.hi"), F.col("before") + F.col("c.below")
        n_before = F.col("n_before") + F.col("c.n_below")
        # a single key goes to the side that ends nearer to the goal
        left = one & (F.col("goal") - before >= before + F.col("c.own") - F.col("goal"))
        cut = F.when(F.col("cut").isNotNull(), F.col("cut")).when(F.col("c").isNull(), F.col("high")).when(one, F.col("c.lo") + left.cast("long"))
        moves = F.col("cut").isNull() & F.col("c").isNotNull()
        state, old = stored(join_small(state, crossing, ["node"]).select(
            "node", "first", "leaves", "n", "dim", "goal", F.when(moves, F.col("c.lo")).otherwise(F.col("low")).alias("low"), F.when(moves, F.col("c.hi") + 1).otherwise(F.col("high")).alias("high"),
            F.when(moves, before).otherwise(F.col("before")).alias("before"),
            F.when(moves, n_before + F.when(left, F.col("c.n_own")).otherwise(0)).when(F.col("cut").isNull(), F.col("n")).otherwise(F.col("n_before")).cast("long").alias("n_before"),
            cut.alias("cut"))), state
        release(old)
    # a side never owes more shards than it has rows, as long as the other can take them
    half = div(F.col("leaves"), 2)
    mine = F.least(F.col("leaves") - 1, F.greatest(F.lit(1), F.least(F.col("n_before"), F.greatest(half, F.col("leaves") - (F.col("n") - F.col("n_before"))))))
    return stored(state.select("node", "dim", "cut", "first", "leaves", mine.cast("long").alias("mine")))


def grow(rows: DataFrame, shards: int, dims: int) -> DataFrame:
    """row and shard (from 0) of every row; ``rows`` is durable and has row, size and k. Nodes are numbered as in a heap."""
    one = lambda v: F.lit(v).cast("long")
    placed = rows.select("row", "size", "k", one(1).alias("node"))
    nodes = rows.sparkSession.range(1).select(one(1).alias("node"), one(0).alias("first"), one(shards).alias("leaves"))
    while not nodes.where("leaves > 1").isEmpty():
        cuts = medians(placed, nodes.where("leaves > 1"), dims)
        right = F.element_at("k", F.col("dim") + 1) >= F.col("cut")
        now = F.when(F.col("cut").isNull(), F.col("node")).otherwise(2 * F.col("node") + right.cast("long"))
        moved = stored(join_small(placed, cuts.select("node", "dim", "cut"), ["node"]).select("row", "size", "k", now.alias("node")))
        halves = F.array(F.struct((2 * F.col("node")).alias("node"), F.col("first"), F.col("mine").alias("leaves")),
                         F.struct((2 * F.col("node") + 1).alias("node"), (F.col("first") + F.col("mine")).alias("first"), (F.col("leaves") - F.col("mine")).alias("leaves")))
        nodes = stored(nodes.where("leaves = 1").union(cuts.select(F.explode(halves).alias("h")).select("h.*")))
        if hasattr(placed, "_stored_at"):
            release(placed)
        placed = moved
    return join_small(placed, nodes.select("node", "first"), ["node"]).select("row", F.col("first").cast("int").alias("shard"))


def shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, doc_id: str = "doc_id", text: str = "text",
           metadata: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document.

    Size is the UTF-8 bytes of the text (null: none) plus 16. Shards are given by
    number or by target bytes. Dimensions are the size, the metadata columns (each
    value by its rank) and the doc_id; nulls sort first. Rows alike in every
    dimension are parted by a hash of id, text and, among repeated rows, their number.
    An empty table has no rows; other columns do not matter.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    names = [f"m{i}" for i in range(len(metadata))]
    rows = stored(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.xxhash64(body).alias("text_hash"), *[F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(metadata, names)]).withColumn("id_hash", F.xxhash64("doc_id")))
    if n_shards is None:
        n_shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // (target_bytes or 1 << 30)))
    large, n_large = set_apart(rows, n_shards)
    rest = rows if large is None else join_small(rows, large.select("row"), ["row"], "left_anti")
    numbered = salted_rank(rest, ["id_hash", "text_hash"], [F.col("row")], "copy", F.col("row"))
    for n in names:
        numbered = dense_rank(numbered, n, f"r{n}")
    tie = F.pmod(F.xxhash64("id_hash", "text_hash", "copy"), F.lit(1 << TIE_BITS))
    values = [F.log("size"), *[F.col(f"r{n}") for n in names], F.coalesce("doc_id", F.lit(-1))]
    keyed = stored(with_keys(numbered.select("row", "doc_id", "size", *[f"r{n}" for n in names], tie.alias("tie")), values).select("row", "size", "k"))
    leaves = grow(keyed, n_shards - n_large, len(values))
    placed = stored(rows.select("row", "doc_id", "size", "text_crc32").join(leaves if large is None else leaves.union(large), "row").drop("row"))
    return salted_rank(placed, ["shard"], [F.col("doc_id"), F.col("text_crc32")], "slot", F.xxhash64("doc_id", "text_crc32"))
