"""Near-duplicates by SimHash fingerprints and pigeonhole blocks.

A fingerprint of 64 bits falls into four blocks of 16. Two fingerprints that
differ in at most two bits agree on at least two whole blocks, so each is dealt
out under the six pairs of its blocks, and only fingerprints under one key are
compared. A key with more than CROWD distinct fingerprints is dealt out again by
the bytes of its two other blocks, again two of four; 48 bits are then fixed, so
no group exceeds 65,536. A group gives a spanning forest of its links, never all
pairs.
"""
from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from cytogrid.llm.common import durable, join_small, map_text, stored
from cytogrid.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
CROWD = 4096
SLICE = 1 << 15


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of ``text``; 0 without words, as for null."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # both on ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends.tolist()
    n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, n, SLICE):
        stop = min(n, i + SLICE)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i:stop], ends[i + width - 1:stop + width - 1])], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns and ``fp``, the fingerprint as a signed long."""
    def make():
        return lambda texts: {"fp": np.array([fingerprint(t) for t in texts.to_pylist()], dtype=np.uint64).view(np.int64)}

    return map_text(docs, make, [T.StructField("fp", T.LongType(), False)], text, keep)


def forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between distinct fingerprints at ``distance`` or fewer bits."""
    out, rest = [], values
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                out += [(at, x) for x in rest[near]]
                queue += list(rest[near])
                rest = rest[~near]
    return out


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links that connect exactly the fingerprints at ``distance`` (at most 2) or fewer bits: src, dst.

    ``prints`` has one row per distinct ``fp``.
    """
    assert distance <= 2, "two of four blocks agree only if at most two differ"
    part = lambda bits, k: F.shiftrightunsigned("fp", bits * k).bitwiseAND(F.lit((1 << bits) - 1))
    keys = F.array(*[F.lit(c << 32) + F.shiftleft(part(16, i), 16) + part(16, j) for c, (i, j) in enumerate(combinations(range(4), 2))])
    dealt = prints.select("fp", F.explode(keys).alias("key"))
    crowded = durable(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("key", F.lit(True).alias("crowded")))
    dealt = join_small(dealt, crowded, ["key"])
    sub = None
    for c, (i, j) in enumerate(combinations(range(4), 2)):
        other = [b for k in range(4) if k not in (i, j) for b in (2 * k, 2 * k + 1)]
        subs = F.array(*[F.lit((d << 16) + 1) + F.shiftleft(part(8, x), 8) + part(8, y) for d, (x, y) in enumerate(combinations(other, 2))])
        of = F.shiftright("key", 32) == c
        sub = F.when(of, subs) if sub is None else sub.when(of, subs)
    placed = dealt.select("key", F.explode(F.when(F.col("crowded"), sub).otherwise(F.array(F.lit(0).cast("long")))).alias("sub"), "fp")

    def compare(batches):
        tail = None
        for batch in batches:
            table = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            table = table if tail is None else np.concatenate([tail, table])
            new = np.flatnonzero((table[1:, :2] != table[:-1, :2]).any(axis=1)) + 1
            whole = new[-1] if len(new) else 0
            tail = table[whole:]
            yield from emit(table[:whole], new[:-1])
        if tail is not None:
            yield from emit(tail, np.zeros(0, np.int64))

    def emit(table, cuts):
        if not len(table):
            return
        at = np.concatenate([[0], cuts, [len(table)]])
        size, fp = np.diff(at), table[:, 2].view(np.uint64)
        two = at[:-1][size == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
        pairs = list(zip(fp[near], fp[near + 1]))
        for k in np.flatnonzero(size > 2).tolist():
            pairs += forest(fp[at[k]:at[k + 1]], distance)
        ends = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["src", "dst"])

    return placed.repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(compare, "src long, dst long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns, ``fp``, ``root`` (one fingerprint of the component) and ``component_id``: the smallest doc_id among texts joined by a chain of links.

    Null doc_ids name no component unless it has no other id. Equal texts,
    repeated rows and texts without words share a fingerprint and so a component.
    """
    found = durable(fingerprints(docs, text, list(dict.fromkeys([doc_id] + (keep or [])))))
    prints = durable(found.groupBy("fp").agg(F.min(doc_id).alias("first_id")))
    roots = components(links(prints.select("fp"))).withColumnRenamed("node", "fp")
    smallest = prints.join(roots, "fp").groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = roots.join(smallest, "root")
    # written first: the last join then shuffles both sides for itself, and Spark splits the partition of a fingerprint that many rows share
    every = durable(prints.join(labels, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id")))
    return found.join(every, "fp").select(*[c for c in found.columns if c != "fp"], "fp", "root", "component_id")


def hex16(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", find: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """One row of each component that ``find`` names, the one with the smallest doc_id; all columns of ``docs`` as they were.

    Rows are told apart by a number, so of repeated rows one stays. The numbered
    rows are stored first: numbered anew for the last join, they would change
    with the splits of a scan.
    """
    numbered = stored(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = stored(find(numbered.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("text"), "__row"), "__id", "text", ["__row"]).select("root", "__id", "__row"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__row")).alias("best"))
    gone = stored(found.join(first, "root").where(F.col("__row") != F.col("best.__row")).select("__row"))
    return join_small(numbered, gone, ["__row"], "left_anti").drop("__row")
