"""Packing token sequences into windows of a fixed length by minimum bin slack.

Documents are cut at the window length; what remains is at most ``capacity``
tokens long, so the lengths of all pieces of any corpus fit in a histogram of
``capacity`` counts. The plan is made on that histogram: the longest remaining
length opens a window, a subset-sum over the remaining counts (a bitset, one bit
for each reachable sum) finds the multiset that fills it closest to capacity, and
that pattern is repeated as often as the counts allow. Pieces then look up their
window by their rank among the pieces of their length.
"""
from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cytogrid.llm.common import TOKEN_CHUNK_BYTES, TokenTable, durable, map_text, salted_rank

CAPACITY = 2048
PIECE = [T.StructField("start", T.LongType(), False), T.StructField("length", T.LongType(), False), T.StructField("ids_crc32", T.LongType(), False),
         T.StructField("doc_tokens", T.LongType(), False)]
IDS = T.StructField("ids", T.ArrayType(T.IntegerType()), False)


def token_pieces(docs: DataFrame, vocabulary: str, end: int = 1, capacity: int = CAPACITY, text: str = "text", keep: list[str] | None = None,
                 with_ids: bool = False, size: int = TOKEN_CHUNK_BYTES, remembered: int = 120_000) -> DataFrame:
    """One row for each piece of a tokenised document: kept columns, start, length, ids_crc32, doc_tokens (and ids).

    Texts are read in slices of ``size`` bytes; a worker remembers ``remembered``
    parts of words. Smaller figures take less memory and more time. Null text counts as empty; every document ends with ``end``, so each has a
    piece. Repeated rows are documents of their own.
    """
    def make():
        table = TokenTable(vocabulary, remembered)

        def pieces(texts):
            ids, at = table.rows(texts, end)
            n = np.diff(at)
            parts = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), parts)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * capacity
            length = np.minimum(capacity, n[row] - start)
            lo = at[row] + start
            view = memoryview(ids.astype("<u4").tobytes())
            crc = np.fromiter((zlib.crc32(view[4 * a:4 * b]) for a, b in zip(lo.tolist(), (lo + length).tolist())), np.int64, len(row))
            out = {"__rows": row, "start": start, "length": length, "ids_crc32": crc, "doc_tokens": n[row]}
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([lo, at[-1:]]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            return out
        return pieces

    return map_text(docs, make, PIECE + [IDS] * with_ids, text, keep, size)


@dataclass
class Pattern:
    """``repeats`` windows that each hold ``items``: (length, copies), longest first."""
    items: list[tuple[int, int]]
    repeats: int


def closest_fill(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """Multiset of lengths within ``counts`` whose sum is as near to ``room`` as possible without exceeding it."""
    reach, layers = 1, []
    inside = (1 << (room + 1)) - 1
    for length in np.flatnonzero(counts[:room + 1])[::-1].tolist():
        layers.append((length, reach))
        left, step = min(int(counts[length]), room // length), 1
        while left:
            step = min(step, left)
            reach |= (reach << (length * step)) & inside
            left, step = left - step, 2 * step
        if reach >> room & 1:
            break
    total, items = reach.bit_length() - 1, []
    for length, before in reversed(layers):
        copies = 0
        while not before >> total & 1:
            total, copies = total - length, copies + 1
        if copies:
            items.append((length, copies))
    return items


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that use every piece of ``histogram`` (length -> number) exactly once."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    patterns = []
    while (longest := int(np.max(np.flatnonzero(counts), initial=0))):
        counts[longest] -= 1
        used = dict(closest_fill(counts, capacity - longest))
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        repeats = min(int(counts[length]) // n for length, n in used.items())
        for length, n in used.items():
            counts[length] -= n * repeats
        patterns.append(Pattern(sorted(used.items(), reverse=True), repeats))
    return patterns


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to durable ``pieces`` with a ``length`` of 1 to ``capacity``.

    ``order`` names the columns that rank pieces of one length; equal rows are
    interchangeable. No rows in, no rows out.
    """
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    if not histogram:
        return pieces.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    entries, used, base = [], {}, 0
    for p in plan(histogram, capacity):
        offset = 0
        for length, copies in p.items:
            begin = used.get(length, 0)
            entries.append((length << 44 | begin, begin, copies, base, offset))
            used[length] = begin + copies * p.repeats
            offset += length * copies
        base += p.repeats
    key, begin, copies, first, offset = (np.array(x, dtype=np.int64) for x in zip(*sorted(entries)))
    ranked = salted_rank(pieces, ["length"], [F.col(c) for c in order], "__at", F.xxhash64(*order))
    schema = T.StructType([f for f in ranked.schema if f.name != "__at"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        for b in batches:
            length, at = b.column("length").to_numpy(), b.column("__at").to_numpy()
            e = np.searchsorted(key, length << 44 | at, side="right") - 1
            k = at - begin[e]
            b = b.drop_columns(["__at"])
            yield pa.RecordBatch.from_arrays(b.columns + [pa.array(first[e] + k // copies[e]), pa.array(offset[e] + k % copies[e] * length)],
                                             names=b.schema.names + ["sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary: str, end: int = 1, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False,
                   size: int = TOKEN_CHUNK_BYTES, remembered: int = 120_000) -> DataFrame:
    """Tokenise, cut and pack ``docs``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    pieces = durable(token_pieces(docs, vocabulary, end, capacity, text, [doc_id], with_ids, size, remembered))
    return pack(pieces, [doc_id, "start", "ids_crc32"], capacity)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """Token ids of every packed sequence, padded to ``capacity``: sequence_id, ids, n_padding (``packed`` needs ids)."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n"))
    ids = F.flatten(F.col("parts.ids"))
    return parts.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad), (F.lit(capacity) - F.col("n")).cast("int"))).alias("ids"),
                        (F.lit(capacity) - F.col("n")).alias("n_padding"))
