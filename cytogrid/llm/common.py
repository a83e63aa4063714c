"""Helpers shared by the text operators: word batches, token tables, salted ranks, size-checked joins."""
from __future__ import annotations

import ctypes
import os
import sys
import types
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from cytogrid.session import cut, shared_dir

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 2 << 20
TOKEN_CHUNK_BYTES = 8 << 20  # more words at a time repeat more often
BROADCAST_ROWS = 100_000


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, so that later tasks find what earlier ones loaded."""
    return sys.modules.setdefault("_cytogrid_worker", types.ModuleType("_cytogrid_worker")).__dict__


# ----------------------------------------------------------------- batches

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, size: str = "8m", usual: str = "67108864b") -> None:
    """Lets Spark hand workers at most ``size`` of Arrow data at a time, unless the session has a limit of its own: long texts make
    large batches, which the executor and its worker both hold."""
    if spark.conf.get(BATCH, usual) == usual:
        spark.conf.set(BATCH, size)


def give_back() -> None:
    """Freed memory goes back to the system; a worker lives on between tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim:
        trim(0)


def text_chunks(batches: Iterator[pa.RecordBatch], text: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of at most ``size`` bytes of text each; a longer single text stays whole in a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.cumsum(sizes) - sizes
        start = 0
        while start < len(sizes):
            stop = max(start + 1, int(np.searchsorted(before, before[start] + size)))
            yield batch.slice(start, stop - start)
            start = stop


def map_text(df: DataFrame, make: Callable[[], Callable[[pa.Array], dict]], fields: Sequence[T.StructField], text: str = "text",
             keep: Sequence[str] | None = None, size: int = CHUNK_BYTES) -> DataFrame:
    """Columns ``keep`` (all by default) of every row plus the columns computed from its text.

    ``make()`` runs once per task and returns a function from a string array to
    one array per field. An entry ``__rows`` in its result gives the input row of
    each output row, where their number differs. A kept column with the name of a
    field is replaced.
    """
    names = [f.name for f in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + list(fields))
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))

    def run(batches):
        compute = make()
        for chunk in text_chunks(batches, "__text", size):
            give_back()
            made = compute(pc.fill_null(chunk.column("__text"), ""))
            if "__rows" in made:
                chunk = chunk.take(pa.array(made["__rows"]))
            columns = [chunk.column(i) for i in range(len(kept))] + [pa.array(made[n]) if not isinstance(made[n], pa.Array) else made[n] for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=kept + names)
        give_back()

    return source.mapInArrow(run, schema)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a string array: ``codes`` of all words, row ``offsets``, distinct ``words``."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts)
        encoded = lists.flatten().dictionary_encode()
        self.words = encoded.dictionary
        codes = encoded.indices.to_numpy(zero_copy_only=False)
        at = lists.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        full = pc.binary_length(self.words).to_numpy(zero_copy_only=False) > 0
        if not full.all():  # splitting at white space leaves an empty string at either end
            mask = full[codes]
            at = np.concatenate([[0], np.cumsum(mask)])[at]
            codes = codes[mask]
        self.codes, self.offsets = codes, at

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def sums(self, per_word: np.ndarray) -> np.ndarray:
        """Sum of a per-distinct-word quantity over each row."""
        return segment_sums(per_word[self.codes], self.offsets)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the segments; of floats each by itself, so that a row's sum does not depend on the rows around it."""
    if values.dtype.kind == "f":
        n = len(offsets) - 1
        return np.bincount(np.repeat(np.arange(n), np.diff(offsets)), values, minlength=n)
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def ragged(values: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of ``values[offsets[c]:offsets[c+1]]`` over ``codes`` and the running lengths."""
    lens = (offsets[1:] - offsets[:-1])[codes]
    ends = np.concatenate([[0], np.cumsum(lens)])
    small = np.int32 if max(len(values), ends[-1]) < 1 << 31 else np.int64
    index = np.repeat((offsets[codes] - ends[:-1]).astype(small), lens)
    index += np.arange(ends[-1], dtype=small)
    return values[index], ends


# ------------------------------------------------------------------ tokens

def tokenizer(path: str):
    """The tokenizer file, loaded once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = worker_state().setdefault("tokenizers", {})
    if path not in loaded:
        loaded[path] = Tokenizer.from_file(path)
    return loaded[path]


ENDS = ".,;:!?"


class TokenTable:
    """Token ids of words, each distinct word encoded once per worker.

    The vocabulary drops white space and never merges across it, so the ids of a
    text are those of its words in order. Nor does it merge an ASCII letter with
    the punctuation behind it, and it folds case: a word that ends in ENDS after
    such a letter is put together from its two parts, and ASCII parts are looked
    up in lower case. The first ``limit`` parts, which hold the frequent ones,
    are remembered; later ones are encoded again for each batch.
    """

    def __init__(self, path: str, limit: int = 120_000):
        self.encoder, self.limit = tokenizer(path), limit
        self.known = worker_state().setdefault("token_tables", {}).setdefault(path, {})
        self.dot = self.encoder.encode(".", add_special_tokens=False).ids

    def encode(self, words: list[str]) -> dict[str, bytes]:
        """Little-endian ids of each word. Plain Latin words go many to a call, with a full stop between them: it is a token of its own
        behind a letter, and of these letters only U+0130 ends in something else when its case is folded."""
        plain = [w for w in words if w.isalpha() and (w.isascii() or max(w) < "\u0250" and "\u0130" not in w)] if len(self.dot) == 1 else []
        out = {}
        for i in range(0, len(plain), 50):
            some = plain[i:i + 50]
            ids = np.array(self.encoder.encode(".".join(some), add_special_tokens=False).ids, dtype="<u4")
            stops = np.flatnonzero(ids == self.dot[0]).tolist() + [len(ids)]
            raw, at = ids.tobytes(), 0
            for word, stop in zip(some, stops):
                out[word] = raw[4 * at:4 * stop]
                at = stop + 1
        rest = [w for w in words if w not in out]
        for i in range(0, len(rest), 20_000):
            some = rest[i:i + 20_000]
            for word, found in zip(some, self.encoder.encode_batch(some, add_special_tokens=False)):
                out[word] = np.array(found.ids, dtype="<u4").tobytes()
        return out

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        core = pc.utf8_rtrim(words, ENDS)
        apart = pc.match_substring_regex(core, "[A-Za-z]$")
        tail = pc.if_else(apart, pc.struct_field(pc.extract_regex(words, f"(?P<t>[{ENDS}]*)$"), "t"), "")
        core = pc.if_else(apart, core, words)
        core = pc.if_else(pc.string_is_ascii(core), pc.ascii_lower(core), core).dictionary_encode()
        tail = tail.dictionary_encode()
        texts = core.dictionary.to_pylist() + tail.dictionary.to_pylist()
        ids = list(map(self.known.get, texts))
        missing = [i for i, x in enumerate(ids) if x is None]
        new = self.encode(list({texts[i]: None for i in missing}))
        for i in missing:
            ids[i] = new[texts[i]]
        if len(self.known) < self.limit:
            self.known.update(new)
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)])
        both = np.stack([core.indices.to_numpy(), tail.indices.to_numpy().astype(np.int64) + len(core.dictionary)], axis=1).reshape(-1)
        out, at = ragged(np.frombuffer(b"".join(ids), dtype=np.uint32), offsets, both)
        return out, at[::2]

    def rows(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every text, one after the other with ``end`` behind each, and where each text begins and ends."""
        w = Words(texts)
        ids, at = ragged(*self(w.words), w.codes)
        at = at[w.offsets]
        if end is None:
            return ids, at
        n = len(at) - 1
        out = np.empty(len(ids) + n, dtype=np.uint32)
        stops = at[1:] + np.arange(n)
        is_end = np.zeros(len(out), dtype=bool)
        is_end[stops] = True
        out[is_end], out[~is_end] = end, ids
        return out, at + np.arange(n + 1)


# ------------------------------------------------------------------- joins

def rows_of(df: DataFrame) -> int:
    return df.count()


def join_small(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a table that is usually small: broadcast only after counting at most ``limit`` rows,
    else a shuffled join whose hot partitions Spark splits."""
    return big.join(F.broadcast(small) if rows_of(small) <= limit else small, list(keys), how)


def salted_rank(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str, salt: Column, per_salt: int = 50_000) -> DataFrame:
    """0-based gapless rank within groups of any size; no task sees more than about ``per_salt`` rows of a group.

    ``df`` must be durable: it is read twice. Ranks run salt by salt, in ``order`` within a salt.
    """
    salts = max(32, -(-rows_of(df) // per_salt))
    salted = df.withColumn("__salt", F.pmod(salt, F.lit(salts)).cast("int"))
    counts = salted.groupBy(*group, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*group).orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*group, "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = salted.withColumn("__rank", F.row_number().over(W.partitionBy(*group, "__salt").orderBy(*order)) - 1)
    return (local.join(starts, [*group, "__salt"]).withColumn(name, (F.col("__rank") + F.col("__before")).cast("long"))
            .drop("__salt", "__rank", "__before"))


def durable(df: DataFrame) -> DataFrame:
    return cut(df)


# ------------------------------------------------------------- byte tokens

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_table(inside: Callable[[int], bool]) -> np.ndarray:
    return np.array([inside(b) for b in range(256)])


def byte_tokens(texts: pa.Array, inside: np.ndarray, lead: int | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of the table ``inside`` within each text (null: none), A-Z in lower case.

    A byte behind the byte ``lead`` is inside too. Gives the tokens, the offsets of
    the rows among them, the UTF-8 bytes of all rows and the place of each
    token's first byte there. Valid only for tables that never part a character.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0]:at[-1]] if len(texts) and texts.buffers()[2] else np.zeros(0, np.uint8)
    at = at - at[0]
    mask = inside[data]
    if lead is not None:
        mask[1:] |= data[:-1] == lead
    some = at[:-1] < at[1:]
    begins, stops = mask.copy(), mask.copy()
    begins[1:] &= ~mask[:-1]
    stops[:-1] &= ~mask[1:]
    for edge, places in ((begins, at[:-1][some]), (stops, at[1:][some] - 1)):  # a token ends with its text
        edge[places] = mask[places]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    del begins
    kept = _LOWER[data[mask]]
    ends = np.concatenate([[0], np.cumsum(stops - starts)])
    tokens = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(kept)])
    return tokens, np.searchsorted(starts, at), data, starts


# ------------------------------------------------------------------ storage

_paths: dict[str, SparkSession] = {}


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read from there: every reader sees the same rows with the same values."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _paths[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, whatever file system holds it."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def release(*tables: DataFrame) -> None:
    """Deletes tables made by ``stored`` that nothing will read again."""
    for df in tables:
        remove_folder(_paths.pop(df._stored_at), df._stored_at)


@contextmanager
def releasing():
    """Deletes at its end all tables that were stored within it; what was made of them must be written by then."""
    before = set(_paths)
    yield
    for path in [p for p in _paths if p not in before]:
        remove_folder(_paths.pop(path), path)
