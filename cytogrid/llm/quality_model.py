"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Documents with
the same votes are one pattern, and there are at most 3 ** LABELLERS patterns, so
expectation-maximisation runs on the pattern counts of the whole corpus: it
estimates how often each labeller is right and gives each pattern its probability
of being good. Those posteriors label a bounded sample of documents, on which a
linear scorer of hashed word and word-shape features is trained; the scorer then
judges every document.
"""
from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from cytogrid.llm.common import Words, map_text, rows_of, segment_sums

BUCKETS = 1 << 14
SAMPLE = 6_000

# name, statistic, bad below, bad above, good from, good to; several read the same fault in different ways
RULES = [("length", "n_words", 5, np.inf, 50, np.inf), ("symbols", "symbol_share", -1, 0.05, 1, 0), ("marks", "mark_share", -1, 0.15, 0, 0.06),
         ("plain words", "plain_share", 0.6, np.inf, 0.9, 1), ("capitals", "capital_share", -1, 0.4, 1, 0), ("shouting", "shout_share", -1, 0.1, 1, 0),
         ("bars", "bar_share", -1, 0.1, 1, 0), ("lines", "repeat_share", -1, 0.3, 1, 0), ("variety", "variety", 0.2, np.inf, 1, 0),
         ("echoes", "echo_share", -1, 0.1, 1, 0), ("stutter", "stutter_share", -1, 0.05, 1, 0), ("digits", "digit_share", -1, 0.3, 1, 0)]
LABELLERS = len(RULES)


PLAIN = r"^[\"'(\[]?[\p{L}\p{M}\p{N}]+([-'\x{2019}/][\p{L}\p{M}\p{N}]+)*[\"')\]]?[.,;:!?]?$"


def echoes(w: Words, times: int = 1) -> np.ndarray:
    """Words of each row that equal the ``times`` words before them."""
    same = np.zeros(len(w.codes), np.int64)
    if len(same) > times:
        rows = w.rows
        same[times:] = np.logical_and.reduce([(w.codes[times:] == w.codes[times - k:len(same) - k]) & (rows[times:] == rows[times - k:len(same) - k]) for k in range(1, times + 1)])
    return segment_sums(same, w.offsets)


def statistics(texts: pa.Array, w: Words) -> dict[str, np.ndarray]:
    """Shares and means that the labellers read; all are 0 for a text without words."""
    number = lambda x: x.to_numpy(zero_copy_only=False).astype(np.float64)
    count = lambda pattern: w.sums(number(pc.count_substring_regex(w.words, pattern)))
    chars, n = w.sums(number(pc.utf8_length(w.words))), w.counts.astype(np.float64)
    share = lambda x, of: x / np.maximum(of, 1)
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten().dictionary_encode()
    at = lists.offsets.to_numpy().astype(np.int64)
    at -= at[0]
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    own = np.bincount(np.unique(rows << 32 | lines.indices.to_numpy(zero_copy_only=False).astype(np.int64)) >> 32, minlength=len(at) - 1)
    distinct = np.bincount(np.unique(w.rows << 32 | w.codes.astype(np.int64)) >> 32, minlength=len(n))
    upper, letters = count(r"\p{Lu}"), count(r"\p{L}")
    return {"n_words": n, "symbol_share": share(count(r"[#*$%&<>{}|~^@\\]"), chars), "mark_share": share(count(r"[^\p{L}\p{M}\p{N}]"), chars),
            "plain_share": np.where(n > 0, share(count(PLAIN), n), 1.0), "capital_share": share(upper, letters), "shout_share": share(count(r"!!+"), n),
            "bar_share": share(count(r"^\|+$"), n), "repeat_share": share(np.diff(at) - own, np.diff(at)), "digit_share": share(count(r"\p{Nd}"), chars),
            "echo_share": share(echoes(w), n), "stutter_share": share(echoes(w, 2), n), "variety": np.where(n < 50, 1.0, share(distinct, np.minimum(n, 400)))}


def votes(texts: pa.Array, w: Words) -> np.ndarray:
    """One column per labeller: 2 good, 0 bad, 1 no vote. A text without words is bad by length and has no other vote."""
    stats = statistics(texts, w)
    out = np.ones((len(texts), LABELLERS), np.int64)
    for k, (_, name, low, high, good_from, good_to) in enumerate(RULES):
        x = stats[name]
        out[:, k] = np.where((x < low) | (x > high), 0, np.where((x >= good_from) & (x <= good_to), 2, 1))
    out[stats["n_words"] == 0, 1:] = 1
    return out


def pattern(vote: np.ndarray) -> np.ndarray:
    return vote @ 3 ** np.arange(LABELLERS)


def vote_patterns(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns and the vote pattern of every text (null text: empty)."""
    return map_text(docs, lambda: lambda texts: {"pattern": pattern(votes(texts, Words(texts)))}, [T.StructField("pattern", T.LongType(), False)], text, keep)


@dataclass
class LabelModel:
    """``accuracy[k]``: share of labeller k's votes that are right; ``posterior``: probability of good by pattern."""
    prior: float
    accuracy: np.ndarray
    posterior: dict[int, float]


def fit_labels(counts: dict[int, int], rounds: int = 100, prior: float = 0.8, trust: float = 0.02) -> LabelModel:
    """Expectation-maximisation over pattern counts.

    Each class has its own chance of every vote. Starting from labellers that are
    right nine times in ten keeps the classes from trading places, and a labeller
    may never vote bad more often on good documents than on bad ones. The start
    counts as ``trust`` times as many documents as there are, so that the classes
    stay apart where one pattern is nearly all of the corpus.
    """
    keys = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[k] for k in keys.tolist()], dtype=np.float64)
    vote = keys[:, None] // 3 ** np.arange(LABELLERS) % 3
    one = np.stack([vote == v for v in range(3)], axis=2).astype(np.float64)  # pattern, labeller, vote
    never = np.array([rule[4] > rule[5] for rule in RULES])[:, None]  # these vote bad or nothing
    bad = np.where(never, [0.3, 0.69, 0.01], [0.3, 0.3, 0.4])
    good = np.where(never, [0.02, 0.97, 0.01], [0.02, 0.2, 0.78])
    start = prior
    p = np.full(len(keys), prior)
    first = [c * trust * n.sum() + 1 for c in (good, bad)]
    for _ in range(rounds if len(keys) else 0):
        log = np.einsum("pkv,kv->p", one, np.log(good) - np.log(bad)) + np.log(prior) - np.log1p(-prior)
        new = 1 / (1 + np.exp(-np.clip(log, -500, 500)))
        good = np.einsum("pkv,p->kv", one, n * new) + first[0]
        bad = np.einsum("pkv,p->kv", one, n * (1 - new)) + first[1]
        good, bad = good / good.sum(axis=1, keepdims=True), bad / bad.sum(axis=1, keepdims=True)
        swap = good[:, 0] > bad[:, 0]
        good[swap] = bad[swap] = (good[swap] + bad[swap]) / 2
        prior = float(np.clip(((n @ new) / n.sum() + trust * start) / (1 + trust), 0.05, 0.99))
        done, p = np.abs(new - p).max() < 1e-6, new
        if done:
            break
    right = prior * good[:, 2] + (1 - prior) * bad[:, 0]
    wrong = prior * good[:, 0] + (1 - prior) * bad[:, 2]
    return LabelModel(prior, right / (right + wrong), dict(zip(keys.tolist(), p.tolist())))


# ------------------------------------------------------------------ scorer

def shapes(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Letter case, digits and punctuation of each word, with runs of one kind shortened to two: codes and distinct shapes."""
    for kind, mark in ((r"\p{Lu}", "A"), (r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}\p{M}]", "a"), (r"\p{N}", "0"), ("a{3,}", "aa"), ("A{3,}", "AA"), ("0{3,}", "00")):
        words = pc.replace_substring_regex(words, kind, mark)
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), [re.sub(r"(.)\1{2,}", r"\1\1", x, flags=re.S) for x in found.dictionary.to_pylist()]


def hashed(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: offsets, buckets and weights. A word gives one feature for itself and one for its shape; a row's weights of each kind add up to 1.
    The share of words that repeat the word before is a feature of its own, in the last bucket."""
    bucket = lambda x, n: zlib.crc32(x.encode("utf-8", "surrogatepass")) % n
    own = np.fromiter((bucket(x, BUCKETS // 2) for x in pc.utf8_lower(w.words).to_pylist()), np.int64, len(w.words))
    code, distinct = shapes(w.words)
    form = np.array([bucket(x, BUCKETS // 2 - 1) for x in distinct], dtype=np.int64)[code] + BUCKETS // 2
    rows = w.rows
    key = np.concatenate([rows * BUCKETS + own[w.codes], rows * BUCKETS + form[w.codes]])
    found, n = np.unique(key, return_counts=True)
    n = n.astype(np.float64)
    found = np.concatenate([found, np.arange(len(w.counts)) * BUCKETS + BUCKETS - 1])
    order = np.argsort(found, kind="stable")
    found, n = found[order], np.concatenate([n, echoes(w).astype(np.float64)])[order]
    row = found // BUCKETS
    return np.searchsorted(row, np.arange(len(w.counts) + 1)), found % BUCKETS, n / np.maximum(w.counts, 1)[row]


def train(offsets: np.ndarray, buckets: np.ndarray, weights: np.ndarray, target: np.ndarray, rounds: int = 200, ridge: float = 1e-4, rate: float = 2.0) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by full-batch adaptive gradient steps; both classes weigh the same."""
    w, b, square = np.zeros(BUCKETS), 0.0, np.full(BUCKETS + 1, 1e-8)
    row = np.repeat(np.arange(len(target)), np.diff(offsets))
    good, bad = target.sum(), (1 - target).sum()
    cost = (target / max(good, 1) + (1 - target) / max(bad, 1)) / 2
    for _ in range(rounds):
        z = segment_sums(w[buckets] * weights, offsets) + b
        error = cost * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target)
        grad = np.append(np.bincount(buckets, error[row] * weights, minlength=BUCKETS) + ridge * w / BUCKETS, error.sum())
        square += grad * grad
        step = rate * grad / np.sqrt(square)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


@dataclass
class Classifier:
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def judge(self, texts: pa.Array, threshold: float) -> dict:
        w = Words(texts)
        offsets, buckets, values = hashed(w)
        score = 1 / (1 + np.exp(-np.clip(segment_sums(self.weights[buckets] * values, offsets) + self.bias, -50, 50)))
        posterior = np.array([self.labels.posterior.get(k, self.labels.prior) for k in pattern(votes(texts, w)).tolist()])
        n = w.counts
        score[n == 0] = 0.0
        return {"n_words": n, "posterior": posterior, "score": score, "kept": score >= threshold}


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Classifier:
    """Label model from the votes on all documents, scorer from about ``sample`` of the distinct texts, picked by a hash.

    However often a text is repeated, it is one text of the sample; all are
    taken where there are no more than ``sample``. Without documents the prior
    stands and the scorer gives one half.
    """
    counts = {r["pattern"]: r["count"] for r in vote_patterns(docs, text, []).groupBy("pattern").count().collect()}  # at most 3 ** LABELLERS rows
    labels = fit_labels(counts)
    if not counts:
        return Classifier(labels, np.zeros(BUCKETS), 0.0)
    total = docs.select(F.xxhash64(F.col(text)).alias("h")).distinct().count()
    part = 1 << 30
    chosen = (docs.select(F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h")).where(F.pmod("h", F.lit(part)) < F.lit(int(min(1.0, sample / total) * part)))
              .distinct())  # copies of one text count once

    def features():
        def compute(texts):
            w = Words(texts)
            offsets, buckets, values = hashed(w)
            return {"pattern": pattern(votes(texts, w)), "buckets": pa.ListArray.from_arrays(offsets.astype(np.int32), buckets.astype(np.int32)),
                    "values": pa.ListArray.from_arrays(offsets.astype(np.int32), values.astype(np.float32))}
        return compute

    fields = [T.StructField("pattern", T.LongType()), T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.FloatType()))]
    rows = map_text(chosen, features, fields, "text", ["h"]).limit(2 * sample).toArrow().sort_by("h").combine_chunks()  # alike in every run
    buckets, values = (rows.column(c).combine_chunks() for c in ("buckets", "values"))
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(buckets).to_numpy(zero_copy_only=False))])
    target = np.array([labels.posterior.get(p, labels.prior) for p in rows.column("pattern").to_pylist()])
    return Classifier(labels, *train(offsets, buckets.flatten().to_numpy(), values.flatten().to_numpy().astype(np.float64), target))


FIELDS = [T.StructField("n_words", T.LongType(), False), T.StructField("posterior", T.DoubleType(), False), T.StructField("score", T.DoubleType(), False),
          T.StructField("kept", T.BooleanType(), False)]


def classify(docs: DataFrame, model: Classifier, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Kept columns, n_words, posterior of the votes, score and kept of every text.

    A text without words (null included) scores 0. Repeated rows are judged alike.
    """
    # the model travels with the function: BUCKETS weights and one posterior for each pattern seen
    return map_text(docs, lambda: lambda texts: model.judge(texts, threshold), FIELDS, text, keep)
