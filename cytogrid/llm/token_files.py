"""Token-id files of patched frame-of-reference blocks.

A file set holds the ids of all documents in ascending doc_id order. Each shard
is one range of doc_id; its rows are chunks of consecutive documents. A chunk's
payload is a run of blocks of BLOCK ids: the block minimum is subtracted, the
differences are packed at the width that a chosen percentile of them needs, and
the few wider ones stand whole in an exception list behind the packed bits.
``block_starts`` gives the byte where each block begins, so that a document in
the middle of a chunk is read without its neighbours. Rows are written by Spark's
committer, so a lost executor's tasks are redone without a trace.
"""
from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cytogrid.llm.common import TOKEN_CHUNK_BYTES, TokenTable, join_small, text_chunks
from cytogrid.session import shared_dir

BLOCK = 512
PERCENTILE = 0.95
HEADER = np.dtype([("minimum", "<u4"), ("width", "u1"), ("exceptions", "<u2")])
FILE_SCHEMA = "shard int, chunk int, first long, n_ids long, doc_ids array<long>, n_tokens array<long>, block_starts array<int>, payload binary"


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """Payload and block starts of an array of unsigned 32-bit ids; the last block is filled up with its last id."""
    if not len(ids):
        return b"", np.zeros(0, np.int32)
    n = -(-len(ids) // BLOCK)
    full = np.concatenate([ids.astype(np.uint32), np.full(n * BLOCK - len(ids), ids[-1], np.uint32)]).reshape(n, BLOCK)
    minimum = full.min(axis=1)
    delta = full - minimum[:, None]
    at = min(BLOCK - 1, int(percentile * BLOCK))
    width = np.ceil(np.log2(np.partition(delta, at, axis=1)[:, at].astype(np.float64) + 1)).astype(np.int64)
    outside = delta >> width.astype(np.uint64)[:, None] != 0
    parts: list[bytes] = [b""] * n
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w % 8 == 0:  # whole bytes
            packed = delta[rows].astype("<u4").view(np.uint8).reshape(len(rows), BLOCK, 4)[:, :, :w // 8].reshape(len(rows), BLOCK * w // 8)
        else:
            bits = ((delta[rows][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
            packed = np.packbits(bits.reshape(len(rows), BLOCK * w), axis=1, bitorder="little")
        for r, body in zip(rows.tolist(), packed):
            where = np.flatnonzero(outside[r])
            head = np.array([(minimum[r], w, len(where))], dtype=HEADER)
            parts[r] = head.tobytes() + body.tobytes() + where.astype("<u2").tobytes() + delta[r, where].astype("<u4").tobytes()
    sizes = np.fromiter(map(len, parts), np.int64, n)
    return b"".join(parts), (np.cumsum(sizes) - sizes).astype(np.int32)


def decode_blocks(payload: bytes, starts: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Ids ``lo`` to ``hi`` (exclusive) of a chunk; only the blocks that hold them are read."""
    if hi <= lo:
        return np.zeros(0, np.uint32)
    first, last = lo // BLOCK, (hi - 1) // BLOCK
    blocks = np.asarray(starts[first:last + 1], dtype=np.int64)
    raw = np.frombuffer(payload, dtype=np.uint8)
    heads = raw[blocks[:, None] + np.arange(HEADER.itemsize)].copy().view(HEADER)[:, 0]
    out = np.empty((len(blocks), BLOCK), dtype=np.uint32)
    body = blocks + HEADER.itemsize
    for w in np.unique(heads["width"]).tolist():
        rows = np.flatnonzero(heads["width"] == w)
        packed = raw[body[rows][:, None] + np.arange(BLOCK * w // 8)]
        if w % 8 == 0:
            whole = np.zeros((len(rows), BLOCK, 4), np.uint8)
            whole[:, :, :w // 8] = packed.reshape(len(rows), BLOCK, w // 8)
            out[rows] = whole.view("<u4")[:, :, 0]
            continue
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
        value = np.zeros((len(rows), BLOCK), dtype=np.uint32)
        for k in range(w):
            value |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
        out[rows] = value
    for r in np.flatnonzero(heads["exceptions"]).tolist():
        n, at = int(heads["exceptions"][r]), int(body[r]) + BLOCK * int(heads["width"][r]) // 8
        out[r, np.frombuffer(payload, "<u2", n, at)] = np.frombuffer(payload, "<u4", n, at + 2 * n)
    out += heads["minimum"][:, None]
    return out.reshape(-1)[lo - first * BLOCK:hi - first * BLOCK]


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end: int = 2, doc_id: str = "doc_id", text: str = "text", percentile: float = PERCENTILE) -> None:
    """Tokenise ``docs`` (null text: empty) and write the file set to ``path``.

    Null doc_ids come first; rows with one doc_id are ordered by a hash of the
    text, so a doc_id that many rows share is spread over shards.
    """
    def encode(batches):
        table, shard, first = TokenTable(vocabulary, 350_000), TaskContext.get().partitionId(), 0
        for number, chunk in enumerate(text_chunks(batches, "text", TOKEN_CHUNK_BYTES)):
            ids, at = table.rows(chunk.column("text"), end)
            payload, starts = encode_blocks(ids, percentile)
            row = {"shard": [shard], "chunk": [number], "first": [first], "n_ids": [len(ids)], "doc_ids": [chunk.column("doc_id").to_pylist()],
                   "n_tokens": [np.diff(at)], "block_starts": [starts], "payload": [payload]}
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(row.values(), kinds)], names=list(row))
            first += len(ids)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(encode, FILE_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a file set: doc_id, start (ids before it in the set), n_tokens, ids_crc32 (and ids)."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # one row for each shard
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    schema = "shard int, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def decode(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = {n: b.column(n)[k] for n in b.schema.names}
                n = row["n_tokens"].values.to_numpy(zero_copy_only=False)
                ids = decode_blocks(row["payload"].as_py(), row["block_starts"].values.to_numpy(zero_copy_only=False), 0, row["n_ids"].as_py())
                at = np.concatenate([[0], np.cumsum(n)])
                view = memoryview(ids.astype("<u4").tobytes())
                crc = np.fromiter((zlib.crc32(view[4 * i:4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())), np.int64, len(n))
                columns = [pa.array(np.full(len(n), row["shard"].as_py(), np.int32)), row["doc_ids"].values, pa.array(at[:-1] + row["first"].as_py()),
                           pa.array(n), pa.array(crc)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "doc_id", "within", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    found = files.select("shard", "first", "n_ids", "doc_ids", "n_tokens", "block_starts", "payload").mapInArrow(decode, schema)
    return (join_small(found, bases, ["shard"]).select("doc_id", (F.col("within") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids))


def round_trip(docs: DataFrame, vocabulary: str, end: int = 2, path: str | None = None) -> DataFrame:
    """Write ``docs`` as token files below the shared folder and read them back."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, vocabulary, path, end)
    return read_token_files(spark, path)
