"""Benchmark passages in a training corpus by a distributed positional inverted index.

The index is stored in segments of some megabytes of text. A segment has a row for
each of its terms: the term, its number of places and the places themselves, as
variable-length gaps; a place is a number in the segment, with one left free behind
each document. The row of the empty term holds those free places and names the
documents. Test windows are sent to the segments that hold their rarest term;
there the list of that term, moved back by its offset in the window, is
intersected with the lists of the other terms, rarest first.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from cytogrid.llm.common import byte_table, byte_tokens, join_small, ragged, rows_of, stored, text_chunks

SEGMENT_BYTES = 8 << 20
WIDTH = 10
PLACE_BITS = 40
WINDOWS = 100_000  # sent to a task at a time
CANDIDATES = 1 << 21
WORD = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)


def gaps_out(places: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Each segment of ascending ``places`` as base-128 gaps, low digits first, the top bit set on all but the last."""
    gaps = np.diff(places, prepend=0)
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    gaps[first] = places[first]
    size = 1 + sum((gaps >> (7 * k) > 0).astype(np.int64) for k in range(1, 6))
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(ends[-1], np.uint8)
    for k in range(6):
        some = size > k
        out[ends[:-1][some] + k] = gaps[some] >> (7 * k) & 127 | np.where(size[some] > k + 1, 128, 0)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(ends[offsets]), pa.py_buffer(out)])


def gaps_in(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The places of all lists and the offsets of each."""
    data = np.frombuffer(b"".join(lists.to_pylist()), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(lists) + 1, np.int64)
    last = np.flatnonzero(data < 128)
    begin = np.concatenate([[0], last[:-1] + 1])
    digit = np.arange(len(data)) - np.repeat(begin, np.diff(np.append(begin, len(data))))
    gaps = np.add.reduceat((data & 127).astype(np.int64) << (7 * digit), begin)
    at = np.searchsorted(last, np.concatenate([[0], np.cumsum(pc.binary_length(lists).to_numpy())]))
    total = np.concatenate([[0], np.cumsum(gaps)])
    return total[1:] - np.repeat(total[at[:-1]], np.diff(at)), at


@dataclass
class Index:
    """``rows``: segment, term, n, places; ``documents``: segment, doc, doc_id, n_words."""
    rows: DataFrame

    @property
    def documents(self) -> DataFrame:
        own = self.rows.where("term = ''").select("segment", F.posexplode(F.arrays_zip("ids", "sizes")).alias("doc", "d"))
        return own.select("segment", "doc", F.col("d.ids").alias("doc_id"), F.col("d.sizes").alias("n_words"))


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", segment_bytes: int = SEGMENT_BYTES) -> Index:
    """Index of all words of all documents, written to the shared folder. Null texts have no words; repeated rows are documents of their own."""
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("segment", T.LongType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("places", T.BinaryType()),
                           T.StructField("ids", T.ArrayType(kind)), T.StructField("sizes", T.ArrayType(T.LongType()))])

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for chunk in text_chunks(batches, "text", segment_bytes):
            words, at, _, _ = byte_tokens(chunk.column("text"), WORD)
            found = words.dictionary_encode()
            codes = found.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            place = order + np.repeat(np.arange(len(at) - 1), np.diff(at))[order]
            offsets = np.searchsorted(codes[order], np.arange(len(found.dictionary) + 1))
            free = at[1:] + np.arange(len(at) - 1)
            lists = pa.concat_arrays([gaps_out(free, np.array([0, len(free)])), gaps_out(place, offsets)]).cast(pa.binary())
            n = len(lists)
            only = pa.array(np.arange(n) > 0)  # the ids and sizes belong to the empty term
            ids = pa.ListArray.from_arrays(pa.array([0] + [len(free)] * n, pa.int32(), mask=None), chunk.column("doc_id"))
            sizes = pa.ListArray.from_arrays(pa.array([0] + [len(free)] * n, pa.int32()), pa.array(np.diff(at)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.concat_arrays([pa.array([""]), found.dictionary.cast(pa.string())]), pa.array(np.append(len(free), np.diff(offsets))), lists,
                                              pc.if_else(only, pa.scalar(None, ids.type), ids), pc.if_else(only, pa.scalar(None, sizes.type), sizes)], names=schema.names)
            number += 1

    return Index(stored(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)))


def windows(items: DataFrame, width: int, item_id: str, text: str) -> DataFrame:
    """item_id and terms of every run of ``width`` words of an item; an item of fewer words, but not none, is one run."""
    def run(batches):
        for chunk in text_chunks(batches, "text"):
            words, at, _, _ = byte_tokens(chunk.column("text"), WORD)
            n = np.diff(at)
            times = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
            row = np.repeat(np.arange(len(n)), times)
            first = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            length = np.minimum(n[row], width)
            ends = np.concatenate([[0], np.cumsum(length)])
            index = np.repeat(first - ends[:-1], length) + np.arange(ends[-1])
            yield pa.RecordBatch.from_arrays([chunk.column("item_id").take(pa.array(row)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words.take(pa.array(index)).cast(pa.string()))],
                                             names=["item_id", "terms"])

    kind = T.StructType([T.StructField("item_id", items.schema[item_id].dataType), T.StructField("terms", T.ArrayType(T.StringType()))])
    return items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, kind)


def exact(codes: np.ndarray, sizes: np.ndarray, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``codes`` (the terms of a window each) and the places where they occur word for word."""
    order = np.argsort(sizes[codes], axis=1, kind="stable")
    rarest = np.take_along_axis(codes, order[:, :1], axis=1)[:, 0]
    rows, starts = [], []
    cuts = np.searchsorted(np.cumsum(sizes[rarest]), np.arange(CANDIDATES, sizes[rarest].sum() + CANDIDATES, CANDIDATES)) + 1
    for a, b in zip(np.concatenate([[0], cuts[:-1]]), cuts):
        part = np.arange(a, min(b, len(codes)))
        if not len(part):
            continue
        list_of, ends = ragged(keys, at, rarest[part])
        row = np.repeat(part, np.diff(ends))
        start = (list_of & ((1 << PLACE_BITS) - 1)) - order[row, 0]
        for j in range(1, codes.shape[1]):
            offset = order[row, j]
            want = (codes[row, offset].astype(np.int64) << PLACE_BITS) + start + offset
            here = keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want
            row, start = row[here], start[here]
        rows.append(row)
        starts.append(start)
    return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(starts or [np.zeros(0, np.int64)])


def close(codes: np.ndarray, sizes: np.ndarray, keys: np.ndarray, at: np.ndarray, free: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``codes``, places and lengths of the stretches of at most ``reach`` words of one document that begin with a term of the window and hold all of them."""
    order = np.argsort(sizes[codes], axis=1, kind="stable")
    out = []
    for w in range(len(codes)):
        terms = codes[w, order[w]]
        anchor = keys[at[terms[0]]:at[terms[0] + 1]] & ((1 << PLACE_BITS) - 1)
        start = np.unique((anchor[:, None] - np.arange(reach)).reshape(-1))
        start = start[start >= 0]
        stop, opens = start.copy(), np.zeros(len(start), bool)
        for t in np.unique(terms).tolist():
            want = (t << PLACE_BITS) + start
            i = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            here = (keys[i] >= want) & (keys[i] < want + reach)
            start, stop, opens, next_at = start[here], stop[here], opens[here], (keys[i] & ((1 << PLACE_BITS) - 1))[here]
            opens |= next_at == start
            stop = np.maximum(stop, next_at)
        whole = opens & (np.searchsorted(free, start) == np.searchsorted(free, stop))
        out.append((np.full(int(whole.sum()), w), start[whole], (stop - start + 1)[whole]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def search(index: Index, asked: DataFrame, reach: int | None = None) -> DataFrame:
    """segment, doc, word, length and window_id of every occurrence of the windows ``asked`` (window_id, terms; durable).

    An occurrence has the terms one behind the other; with ``reach`` it is any stretch of at
    most that many words that begins with one of the terms and holds all of them, in
    any order (a term that the window repeats need not repeat).
    """
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    lists = stored(join_small(index.rows.select("term", "segment", "n", "places"), terms.union(terms.sparkSession.createDataFrame([("",)], "term string")), ["term"], "inner"))
    weights = lists.where("term != ''").groupBy("term").agg(F.sum("n").alias("weight"))
    weighed = asked.select("window_id", F.size("terms").alias("length"), F.explode("terms").alias("term")).join(weights, "term")
    rarest = weighed.groupBy("window_id", "length").agg(F.count(F.lit(1)).alias("known"), F.min(F.struct("weight", "term")).alias("r")).where("known = length").select("window_id", F.col("r.term").alias("term"))
    sent = rarest.join(lists.select("term", "segment"), "term").join(asked, "window_id").select("segment", "window_id", "terms")
    parts = max(1, -(-rows_of(asked) // WINDOWS))
    sent = sent.withColumn("part", F.pmod(F.xxhash64("window_id"), F.lit(parts).cast("long")))
    held = lists.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def look_up(key, held: pa.Table, sent: pa.Table) -> pa.Table:
        out = []
        if sent.num_rows and held.num_rows:
            held, sent = held.combine_chunks(), sent.combine_chunks()
            names = held.column("term").combine_chunks()
            places, at = gaps_in(held.column("places").combine_chunks())
            sizes = np.diff(at)
            keys = (np.repeat(np.arange(len(sizes)), sizes) << PLACE_BITS) + places
            mark = names.index("").as_py()
            free = places[at[mark]:at[mark + 1]]
            lists = sent.column("terms").combine_chunks()
            code = pc.fill_null(pc.index_in(lists.flatten(), value_set=names), -1).to_numpy().astype(np.int64)
            length = pc.list_value_length(lists).to_numpy()
            begin = np.concatenate([[0], np.cumsum(length)])[:-1]
            ids = sent.column("window_id").to_numpy()
            for n in np.unique(length).tolist():
                some = np.flatnonzero(length == n)
                codes = code[begin[some][:, None] + np.arange(n)]
                fine = (codes >= 0).all(axis=1)
                some, codes = some[fine], codes[fine]
                if reach is None:
                    row, start = exact(codes, sizes, keys, at)
                    long = np.full(len(row), n)
                else:
                    row, start, long = close(codes, sizes, keys, at, free, reach)
                doc = np.searchsorted(free, start)
                out.append((doc, start - np.concatenate([[0], free + 1])[doc], long, ids[some][row]))
        doc, word, long, window = (np.concatenate(c) for c in zip(*out)) if out else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(np.full(len(doc), key[0].as_py()), pa.int64()), pa.array(doc.astype(np.int32)), pa.array(word.astype(np.int64)), pa.array(long.astype(np.int64)), pa.array(window.astype(np.int64))],
                        names=["segment", "doc", "word", "length", "window_id"])

    both = held.select("segment", "part", "term", "places").groupBy("segment", "part").cogroup(sent.groupBy("segment", "part"))
    return both.applyInArrow(look_up, "segment long, doc int, word long, length long, window_id long")


def passages(index: Index, items: DataFrame, width: int = WIDTH, reach: int | None = None, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Occurrences of all windows of the items (segment, doc, word, length, window_id), and the items of each window (window_id, item_id); both stored."""
    found = stored(windows(items, width, item_id, text))
    asked = stored(found.select("terms").distinct().withColumn("window_id", F.monotonically_increasing_id()))
    of = stored(found.join(asked, "terms").select("window_id", "item_id").distinct())
    return stored(search(index, asked, reach)), of


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence of a window), n_items, items_sha256 and contaminated of every document.

    Items are told apart by item_id; a null one is named by the empty string. Null
    texts have no words. Every row of ``docs`` has a row. Ties and the order of rows
    do not matter; without items nothing is hit.
    """
    index = build(docs, doc_id, text)
    items = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item_id"), F.col(f"`{text}`").alias("text"))
    found, of = passages(index, items, width)
    spans = found.select("segment", "doc", "word", "length").distinct()
    upto = F.max(F.col("word") + F.col("length")).over(W.partitionBy("segment", "doc").orderBy("word", "length").rowsBetween(W.unboundedPreceding, -1))
    own = spans.withColumn("upto", F.coalesce(upto, F.lit(0)))
    hits = own.groupBy("segment", "doc").agg(F.sum(F.greatest(F.lit(0), F.col("word") + F.col("length") - F.greatest("word", "upto"))).alias("n_hit"))
    names = found.select("segment", "doc", "window_id").distinct().join(of, "window_id").groupBy("segment", "doc").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    rows = index.documents.join(hits.join(names, ["segment", "doc"]), ["segment", "doc"], "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
