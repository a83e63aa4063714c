"""Phrase collocations by set-oriented mining of occurrence relations (SETM).

The relation of level k holds, in order of piece and position, the number of the
frequent k-word phrase that begins there. It is kept in blocks of some megabytes
of text: a block is a sorted run of positions, a gap parts its pieces. Joining a
relation with itself at the next position (a merge of two sorted runs) gives the
phrases of k + 1 words; blocks count theirs, the counts are added up over all
blocks by a shuffle on the phrase, and the frequent ones go back to their blocks
(semi-join) before the next level is begun. Blocks and relations are written to
the shared folder.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cytogrid.llm.common import byte_table, byte_tokens, release, rows_of, stored, text_chunks
from cytogrid.operators.ordering import OrderedBlocks

HELD_BYTES = 12 << 20
BLOCK_WORDS = 2_000_000
COUNTER_BITS, INDEX_BITS = 16, 27  # a phrase's number: task, block of the task, place in the block
UND = "und"
BREAKS = byte_table(lambda b: b in b".,;:!?\n\x0b\x0c\r")
INSIDE = byte_table(lambda b: b not in b" \t") & ~BREAKS
PER_PART, FAN = 50_000, 25
BATCH_ROWS = 50_000


def packed(codes: np.ndarray) -> bytes:
    return pa.compress(codes.astype("<i4").tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), "<i4")


def blocks(texts: pa.Array, size: int):
    """Blocks of the words of ``texts``: word codes with -1 between pieces, the distinct words, and the counts of each."""
    words, rows, data, starts = byte_tokens(texts, INSIDE)
    if not len(words):
        return
    broken = np.searchsorted(np.flatnonzero(BREAKS[data]), starts)
    new = np.diff(broken, prepend=broken[0]) > 0
    del data, starts, broken
    new[rows[:-1][(rows[:-1] > 0) & (rows[:-1] < len(words))]] = True  # a text is a piece of its own
    opens = np.flatnonzero(new)
    at = 0
    while at < len(words):  # cut where a piece begins
        later = opens[np.searchsorted(opens, at + size):]
        stop = int(later[0]) if len(later) else len(words)
        found = words.slice(at, stop - at).dictionary_encode()
        codes = found.indices.to_numpy(zero_copy_only=False)
        gaps = np.flatnonzero(new[at:stop])
        yield np.insert(codes, gaps[gaps > 0], -1), found.dictionary, np.bincount(codes, minlength=len(found.dictionary))
        at = stop


def relation(docs: DataFrame, text: str, lang: str, size: int = BLOCK_WORDS) -> DataFrame:
    """The words of all documents by block: block, lang, n_words, n_codes, codes, words, counts."""
    def run(batches):
        task, number, held, total = TaskContext.get().partitionId(), 0, {}, 0

        def flush(name):
            nonlocal number, total
            pa.default_memory_pool().release_unused()
            texts = pa.concat_arrays(held.pop(name))
            total -= texts.nbytes
            for codes, words, counts in blocks(texts, size):
                if number >> COUNTER_BITS or len(words) >> INDEX_BITS or task >> (63 - COUNTER_BITS - INDEX_BITS):
                    raise ValueError("more blocks or words in a task than a phrase number can tell apart")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task << COUNTER_BITS | number]), pa.array([name], pa.string()), pa.array([int(counts.sum())]), pa.array([len(codes)]), pa.array([packed(codes)], pa.binary()),
                     pa.array([words.cast(pa.string())], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))],
                    names=["block", "lang", "n_words", "n_codes", "codes", "words", "counts"])
                number += 1

        for chunk in text_chunks(batches, "text"):
            langs = chunk.column("lang").fill_null(UND).dictionary_encode()
            for k, name in enumerate(langs.dictionary.to_pylist()):
                own = chunk.column("text").filter(pc.equal(langs.indices, k))
                held.setdefault(name, []).append(own)
                total += own.nbytes
            while total > HELD_BYTES:  # the language that holds most
                yield from flush(max(held, key=lambda name: sum(x.nbytes for x in held[name])))
        for name in sorted(held):
            yield from flush(name)

    source = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    return stored(source.mapInArrow(run, "block long, lang string, n_words long, n_codes long, codes binary, words array<string>, counts array<long>"))


def frequent(counted: DataFrame, key: list[str], least: int) -> DataFrame:
    """The rows of ``counted`` (key, block, idx, n) whose key occurs ``least`` times in all blocks, with gid, total and whether the row is the key's first.

    A key has at most one row in a block, so the most common phrase has as many
    rows as there are blocks. ``gid`` names the key by its first place.
    """
    over = W.partitionBy(*key)
    place = F.shiftleft("block", INDEX_BITS) + F.col("idx")
    rows = (counted.withColumn("total", F.sum("n").over(over)).withColumn("gid", F.min(place).over(over)).where(F.col("total") >= least)
            .withColumn("first", place == F.col("gid")))
    # words are kept once
    return stored(rows.select("block", "idx", "gid", *[F.when(F.col("first"), F.col(c)).alias(c) for c in [*key, "total"]], "first"))


def steps(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Self-join of a sorted relation at the next position: positions, number of the pair at each, and the distinct pairs' left and right codes."""
    at = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
    pairs, which = np.unique(codes[at].astype(np.int64) << 32 | codes[at + 1], return_inverse=True)
    return at, which, pairs >> 32, pairs & 0xFFFFFFFF


def semi_join(level: DataFrame, marks: DataFrame, extended: bool) -> DataFrame:
    """The relation restricted to the groups in ``marks`` (block, idx, gid): block, n_codes, codes of the positions (-1: none) and the group number of each code.

    ``extended``: the groups are the steps of ``level``, not its own codes.
    """
    def restrict(key, rel: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        if rel.num_rows and found.num_rows:
            codes = unpacked(rel.column("codes")[0].as_py(), rel.column("n_codes")[0].as_py())
            idx = found.column("idx").to_numpy()
            order = np.argsort(idx)
            if extended:
                at, which, left, _ = steps(codes)
                own = np.full(len(left) + 1, -1, np.int32)
                own[idx[order]] = np.arange(len(idx))
                new = np.full(len(codes), -1, np.int32)
                new[at] = own[which]
            else:
                own = np.full(max(int(codes.max()), int(idx.max())) + 2, -1, np.int32)
                own[idx[order]] = np.arange(len(idx))
                new = own[codes]  # the last entry stands for -1
            gap = new < 0
            alone = ~gap & np.append(True, gap[:-1]) & np.append(gap[1:], True)
            gap |= alone  # joins nothing
            new = np.where(gap, -1, new)[~(gap & np.append(True, gap[:-1]))]  # one gap is as good as many
            out.append((key[0].as_py(), len(new), packed(new), found.column("gid").to_numpy()[order]))
        return pa.table([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary()),
                         pa.array([r[3] for r in out], pa.list_(pa.int64()))], names=["block", "n_codes", "codes", "gids"])

    both = level.select("block", "n_codes", "codes").groupBy("block").cogroup(marks.select("block", "idx", "gid").groupBy("block"))
    return stored(both.applyInArrow(restrict, "block long, n_codes long, codes binary, gids array<long>"))


def pairs(level: DataFrame) -> DataFrame:
    """Phrases one word longer, counted by block: left and right group, block, idx, n."""
    def run(batches):
        for batch in batches:
            for block, n, codes, gids in zip(*[batch.column(c).to_pylist() for c in ("block", "n_codes", "codes")], batch.column("gids")):
                _, which, left, right = steps(unpacked(codes, n))
                ids = gids.values.to_numpy()
                times = np.bincount(which, minlength=len(left))
                del which
                for i in range(0, len(left), BATCH_ROWS):
                    some = slice(i, min(i + BATCH_ROWS, len(left)))
                    place = np.arange(some.start, some.stop)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[left[some]]), pa.array(ids[right[some]]), pa.array(np.full(len(place), block)), pa.array(place), pa.array(times[some])],
                                                     names=["left", "right", "block", "idx", "n"])

    return level.mapInArrow(run, "left long, right long, block long, idx long, n long")


def cut_score(m: int) -> Column:
    """The lowest-scoring cut of a phrase of ``m`` words (ties to the shortest first part), in exact arithmetic up to counts of 10^15."""
    exact = lambda c: c.cast("decimal(15,0)")
    one = []
    for k in range(1, m):
        first, rest = F.col("pre")[k - 1], F.col("suf")[m - k - 1]
        whole = F.lit(1_000_000).cast("decimal(7,0)") * exact(F.col("total")) * exact(F.col("total"))
        one.append(F.struct(F.call_function("div", whole, exact(first) * exact(rest)).alias("score"), F.lit(k).alias("k"), first.alias("l"), rest.alias("r")))
    return F.array_min(F.array(*one))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, cover: int = 50, top: int | None = 2000,
                 block_words: int = BLOCK_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``top`` phrases of two to ``longest`` words of each language (None: all).

    Words are what blanks part within pieces, lower-cased A-Z; a null text is
    empty, a null language ``und``. A phrase needs ``least`` occurrences in its
    language, overlaps and repeated rows counted. It goes if a longer one that
    holds it occurs ``cover`` in 100 times as often. Ties in the score go to the more
    frequent phrase, then by bytes. Other columns do not matter; a table without
    words gives no rows.
    """
    base = relation(docs, text, lang, block_words)
    sizes = stored(base.groupBy("lang").agg(F.sum("n_words").alias("n")))
    words = base.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("idx", "w")).select("lang", F.col("w.words").alias("word"), "block", F.col("idx").cast("long").alias("idx"), F.col("w.counts").alias("n"))
    marks = frequent(words, ["lang", "word"], least)
    none = F.array().cast("array<long>")
    known = stored(marks.where("first").select("gid", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "total", none.alias("pre"), none.alias("suf")))
    level, scored = semi_join(base, marks, False), None
    release(base, marks)
    for m in range(2, longest + 1):
        counted = pairs(level)
        if m < longest:
            marks = frequent(counted, ["left", "right"], least)
            heads = marks.where("first").select("gid", "left", "right", "total")
        else:
            place = F.min(F.shiftleft("block", INDEX_BITS) + F.col("idx"))
            heads = counted.groupBy("left", "right").agg(F.sum("n").alias("total"), place.alias("gid")).where(F.col("total") >= least)
        one = known.select(F.col("gid").alias("left"), "lang", "phrase", F.col("total").alias("n_left"), "pre")
        two = known.select(F.col("gid").alias("right"), "last", F.col("total").alias("n_right"), "suf")
        longer = stored(heads.join(one, "left").join(two, "right").select(
            "gid", "left", "right", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "total",
            F.concat("pre", F.array("n_left")).alias("pre"), F.concat("suf", F.array("n_right")).alias("suf")))
        if m < longest:
            done, level = level, semi_join(level, marks, True)
            release(done, marks)
        else:
            release(level)
        if m > 2:  # of the longer phrases that hold one, those with one more word are the most frequent
            above = longer.select(F.explode(F.array("left", "right")).alias("gid"), F.col("total").alias("above")).groupBy("gid").agg(F.max("above").alias("above"))
            free = known.join(above, "gid", "left").where(F.col("above").isNull() | (100 * F.col("above") < cover * F.col("total")))
            own = free.withColumn("cut", cut_score(m - 1)).select("lang", "phrase", "total", "cut")
            scored = own if scored is None else scored.union(own)
        known = longer
    own = known.withColumn("cut", cut_score(longest)).select("lang", "phrase", "total", "cut")
    scored = stored((own if scored is None else scored.union(own)).select("lang", "phrase", F.col("total").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    if top is not None:  # the first of ever fewer parts
        parts, ranked = max(1, -(-rows_of(scored) // PER_PART)), scored
        while parts > 1:
            part = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
            ranked = ranked.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
            parts = -(-parts // FAN)
        ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    else:
        ranked = OrderedBlocks(scored, order, ["lang"]).row_number("rank").df
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
