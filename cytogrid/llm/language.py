"""Language identification by interpolated Kneser-Ney character models.

A language's model covers the characters of words, each word with its bounds, in
n-grams of up to ORDER characters. Counts of the longest n-grams come from all
training documents; shorter ones count the distinct continuations that
Kneser-Ney smoothing asks for. Tables are sorted arrays of packed n-grams that are
searched by interpolation. A text gets the language with the smallest cross-entropy
per character, and is rejected where that lies above a limit calibrated on the
training documents.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cytogrid.llm.common import Words, durable, join_small, map_text, segment_sums, text_chunks

ORDER = 4
BITS = 16  # of a character in a packed n-gram; characters beyond the basic plane share hashed codes
BOUND = 1  # a word's start and end
UND = "und"
FIELDS = [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("cross_entropy", T.DoubleType()),
          T.StructField("n_symbols_read", T.LongType(), False)]


def symbols(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters of each word between bounds, the offsets, and the number of letters.

    Characters that are no letters are left out; a word without letters is empty.
    """
    out, lens = [], np.zeros(len(words), np.int64)
    for i, word in enumerate(words.to_pylist()):
        letters = "".join(filter(str.isalpha, word.lower()))
        if letters:
            out.append(f"\x01{letters}\x01")
            lens[i] = len(letters) + 2
    points = np.frombuffer("".join(out).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points = np.where(points < 1 << BITS, points, points * np.uint64(40503) & np.uint64((1 << BITS) - 1) | np.uint64(1 << 15))
    return points, np.concatenate([[0], np.cumsum(lens)]), np.maximum(lens - 2, 0)


def grams(points: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The packed n-gram that ends at each position; places before the word's start are zero. Bounds that open a word give 0."""
    place = np.arange(len(points)) - np.repeat(offsets[:-1], np.diff(offsets))
    key = np.zeros(len(points), np.uint64)
    for k in range(order):
        prior = np.zeros(len(points), np.uint64)
        prior[k:] = points[:len(points) - k] if k else points
        key |= np.where(place >= k, prior, 0).astype(np.uint64) << np.uint64(BITS * k)
    return np.where(place > 0, key, 0)


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER) -> DataFrame:
    """Occurrences of the longest n-grams of each language: lang, gram (as signed long), n."""
    def count(batches):
        for chunk in text_chunks(batches, "text"):
            w = Words(chunk.column("text").fill_null(""))
            points, at, _ = symbols(w.words)
            key = grams(points, at, order)
            found, place = np.unique(key, return_inverse=True)
            langs = chunk.column("lang").dictionary_encode()
            which = langs.indices.to_numpy(zero_copy_only=False)[w.rows]
            for k, name in enumerate(langs.dictionary.to_pylist()):
                times = np.bincount(w.codes[which == k], minlength=len(w.words))
                n = np.bincount(place, np.repeat(times, np.diff(at)), minlength=len(found)).astype(np.int64)
                used = (n > 0) & (found > 0)
                yield pa.RecordBatch.from_arrays([pa.array([name] * int(used.sum()), pa.string()), pa.array(found[used].view(np.int64)), pa.array(n[used])], names=["lang", "gram", "n"])

    source = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    return source.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class KneserNey:
    """One language's model: for each order sorted n-grams with counts, and sorted contexts with totals and numbers of followers."""

    def __init__(self, key: np.ndarray, n: np.ndarray, order: int = ORDER):
        self.order, self.levels = order, {}
        order_of = np.argsort(key)
        key, n = key[order_of], n[order_of].astype(np.float64)
        for k in range(order, 0, -1):
            context, at = np.unique(key >> np.uint64(BITS), return_inverse=True)
            n1, n2 = np.count_nonzero(n == 1), np.count_nonzero(n == 2)
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            self.levels[k] = (key, n, context, np.bincount(at, n), np.bincount(at).astype(np.float64), discount)
            if k > 1:  # a shorter n-gram counts the distinct longer ones that end in it
                mask = np.uint64((1 << (BITS * (k - 1))) - 1)
                short, back = np.unique(key & mask, return_inverse=True)
                n = np.bincount(back).astype(np.float64)
                key = short
        self.letters = len(self.levels[1][0]) + 1

    @staticmethod
    def find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key in a sorted table and whether it is there, by interpolation search.

        A guess lies as far between the ends of what is left as the key lies between
        their values. n-grams come in clusters, so every other guess is the middle.
        """
        at, here = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        if not len(table):
            return at, here
        left = np.flatnonzero((key >= table[0]) & (key <= table[-1]))
        low, high, middle = np.zeros(len(left), np.int64), np.full(len(left), len(table) - 1), False
        while len(left):
            k, first, last = key[left], table[low], table[high]
            share = 0.5 if middle else (k - first).astype(np.float64) / np.maximum(last - first, 1)
            guess = np.minimum(low + (share * (high - low)).astype(np.int64), high)
            value = table[guess]
            at[left], here[left] = guess, value == k
            low, high = np.where(value < k, guess + 1, low), np.where(value > k, guess - 1, high)
            open_ = (value != k) & (low <= high)
            left, low, high, middle = left[open_], low[open_], high[open_], not middle
            inside = (key[left] >= table[low]) & (key[left] <= table[high])
            left, low, high = left[inside], low[inside], high[inside]
        return at, here

    def log_probability(self, key: np.ndarray) -> np.ndarray:
        """log2 of the probability of the last character of each packed n-gram after the others."""
        p = np.full(len(key), 1.0 / self.letters)
        for k in range(1, self.order + 1):
            table, n, context, total, kinds, discount = self.levels[k]
            own = key & np.uint64((1 << (BITS * k)) - 1) if k < 4 else key
            at, here = self.find(table, own)
            of, known = self.find(context, own >> np.uint64(BITS))
            count = np.where(here, n[at], 0.0)
            p = np.where(known, (np.maximum(count - discount, 0.0) + discount * kinds[of] * p) / total[of], p)
        return np.log2(p)


class Identifier:
    """Models of all languages, read by name."""

    def __init__(self, models: dict[str, KneserNey]):
        self.names = sorted(models)
        self.models = [models[n] for n in self.names]

    def judge(self, texts: pa.Array, reading: int = 50) -> dict:
        w = Words(texts)
        points, at, letters = symbols(w.words)
        key = grams(points, at, self.models[0].order if self.models else ORDER)
        found, place = np.unique(key, return_inverse=True)
        read = key > 0
        size = w.sums(segment_sums(read.astype(np.int64), at))
        none = (w.sums(letters) == 0) | (not self.models)
        bits = np.stack([-w.sums(segment_sums(np.where(found > 0, m.log_probability(found), 0.0)[place], at)) for m in self.models], axis=1) if self.models else np.zeros((len(texts), 1))
        entropy = bits / np.maximum(size, 1)[:, None]
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(best)), best]
        odds = np.exp2(-(entropy - low[:, None]) * np.minimum(size, reading)[:, None])
        names = np.array(self.names + [UND], dtype=object)
        return {"lang_pred": pa.array(names[np.where(none, len(self.names), best)].tolist(), pa.string()), "score": np.where(none, 0.0, 1.0 / odds.sum(axis=1)),
                "cross_entropy": pa.array(low, mask=none), "n_symbols_read": size}


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER) -> Identifier:
    """Models from all rows of ``docs`` with a language, with every n-gram that occurs: totals, followers and discounts are those of the complete counts."""
    counts = durable(gram_counts(docs, text, lang, order))
    models = {}
    for name in [r.lang for r in counts.select("lang").distinct().collect()]:  # a language at a time, so that its names do not travel with the rows
        found = counts.where(F.col("lang") == name).select("gram", "n").toArrow()
        models[name] = KneserNey(found.column("gram").to_numpy().view(np.uint64), found.column("n").to_numpy(), order)
    return Identifier(models)


def predict(docs: DataFrame, model: Identifier, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns, lang_pred, score (0 to 1), cross_entropy and n_symbols_read of every text.

    Null text and text without letters give ``und`` with score 0. Ties go to the first language by name.
    """
    # the whole tables are broadcast; a worker loads them once for all its tasks
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_text(docs, lambda: shared.value.judge, FIELDS, text, keep)


def calibrate(predicted: DataFrame, share: float = 0.999, slack: float = 1.25, reach: float = 4.0, weight: float = 4.0) -> DataFrame:
    """Largest cross-entropy accepted for each predicted language and length class: ``slack`` times the bound of training texts.

    A bound is the ``share`` quantile, or the median and ``reach`` interquartile
    ranges where that is less, so no single text sets it. It is averaged, as
    if of ``weight`` texts, with that of the nearest shorter class of the
    language, the first class with that of the language, and the language with
    that of all languages. Rows without a class hold for the whole language, the
    row without a language for all.
    """
    rows = predicted.where(F.col("cross_entropy").isNotNull()).select("lang_pred", length_class().alias("length_class"), "cross_entropy")
    sets = rows.groupingSets([["lang_pred", "length_class"], ["lang_pred"], []], "lang_pred", "length_class")
    found = sets.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("cross_entropy", [0.25, 0.5, 0.75, share], 1000).alias("q")).where("n > 0").collect()
    bound = {(r.lang_pred, r.length_class): (r.n, min(r.q[3], r.q[1] + reach * max(r.q[2] - r.q[0], 0.05 * r.q[1]))) for r in found}
    blend = lambda key, parent: (bound[key][0] * bound[key][1] + weight * parent) / (bound[key][0] + weight)
    limits = {}
    if bound:
        limits[None, None] = bound[None, None][1]
        for name in sorted({k[0] for k in bound} - {None}):
            parent = limits[name, None] = blend((name, None), limits[None, None])
            for c in sorted(k[1] for k in bound if k[0] == name and k[1] is not None):
                parent = limits[name, c] = blend((name, c), parent)
    return predicted.sparkSession.createDataFrame([(a, c, v * slack) for (a, c), v in limits.items()], "lang_pred string, length_class int, limit double")


def length_class():
    """Powers of four of the number of symbols read: short texts scatter more."""
    return F.floor(F.log2(F.greatest("n_symbols_read", F.lit(1))) / 2).cast("int")


def accept(predicted: DataFrame, limits: DataFrame, name: str = "accepted") -> DataFrame:
    """Adds whether each text is accepted: by the limit of its length class, else of the nearest shorter class, else of the language, else of all languages.

    Without any training text there is no limit.
    """
    rows = limits.collect()  # a few for each language
    whole = {r.lang_pred: r.limit for r in rows if r.length_class is None}
    marked = predicted.withColumn("__class", length_class())
    top = marked.sparkSession.createDataFrame([(n, c, max([(r.length_class, r.limit) for r in rows if r.lang_pred == n and r.length_class is not None and r.length_class <= c], default=(0, whole[n]))[1])
                                               for n in whole if n is not None for c in range(32)], "lang_pred string, __class int, __limit double")
    joined = join_small(marked, top, ["lang_pred", "__class"])
    limit = F.coalesce("__limit", F.lit(whole.get(None)).cast("double"))
    return joined.withColumn(name, (F.col("lang_pred") != UND) & F.coalesce(F.col("cross_entropy") <= limit, F.lit(True))).drop("__class", "__limit")
