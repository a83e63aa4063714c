"""Quality rules from tokenizer fertility.

Two public vocabularies read every distinct word of a text: one gives characters
per token and the entropy of the text's token distribution, the other the share
of tokens that fall back to single bytes. Bands of normal values are taken per
language (or script, where no language is given) from all documents, leaning on
those of the script where documents are few, and texts outside the bands of their language are rejected. Base metrics count characters,
symbols, repeated lines and words in repeated five-word windows.
"""
from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from cytogrid.llm.common import TOKEN_CHUNK_BYTES, TokenTable, Words, durable, join_small, map_text, ragged, segment_sums, worker_state

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
# fixed values: Unicode script names and the code point ranges read as that script
SCRIPTS = [("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF),
           ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("hangul", 0xAC00, 0xD7A3), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF)]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FIELDS = ([T.StructField(n, T.LongType(), False) for n in BASE] + [T.StructField("base_failed", T.BooleanType(), False), T.StructField("n_tokens", T.LongType(), False)]
          + [T.StructField(n, T.DoubleType()) for n in ("chars_per_token", "byte_share", "token_entropy")] + [T.StructField("script", T.StringType(), False)])


def repeated_window_words(codes: np.ndarray, offsets: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """For each row the number of words inside windows of ``width`` words that occur twice or more in the row.

    Windows are matched by a 64-bit sum of odd multiples; every match is then
    compared word by word, and a row with a false match is counted by dictionary.
    """
    counts = np.diff(offsets)
    rows = np.repeat(np.arange(len(counts)), np.maximum(counts - width + 1, 0))
    per = np.maximum(counts - width + 1, 0)
    at = np.arange(len(rows)) + np.repeat(offsets[:-1] - (np.cumsum(per) - per), per)
    if not len(at):
        return np.zeros(len(counts), np.int64)
    odd = np.random.default_rng(11).integers(1, 2**63, width + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = rows.astype(np.uint64) * odd[width]
    for k in range(width):
        mixed += (codes[at + k].astype(np.uint64) + np.uint64(1)) * odd[k]
    mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed)
    same = mixed[order[1:]] == mixed[order[:-1]]
    a, b = order[:-1][same], order[1:][same]
    true = rows[a] == rows[b]
    for k in range(width):
        true &= codes[at[a] + k] == codes[at[b] + k]
    edge = np.zeros(len(codes) + 1, np.int64)
    hit = np.unique(np.concatenate([a[true], b[true]]))
    np.add.at(edge, at[hit], 1)
    np.add.at(edge, at[hit] + width, -1)
    out = segment_sums((np.cumsum(edge[:-1]) > 0).astype(np.int64), offsets)
    for r in np.unique(np.concatenate([rows[a[~true]], rows[b[~true]]])).tolist():
        own = codes[offsets[r]:offsets[r + 1]].tolist()
        seen = Counter(tuple(own[i:i + width]) for i in range(len(own) - width + 1))
        out[r] = len({i + k for i in range(len(own) - width + 1) if seen[tuple(own[i:i + width])] > 1 for k in range(width)})
    return out


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """For each text the number of lines with a word that equal an earlier line."""
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten().dictionary_encode()
    at = lists.offsets.to_numpy().astype(np.int64)
    at -= at[0]
    wordy = pc.binary_length(pc.ascii_trim_whitespace(lines.dictionary)).to_numpy(zero_copy_only=False) > 0
    codes = lines.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keep = wordy[codes]
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))[keep]
    key = np.sort(rows << 32 | codes[keep])
    again = key[1:][key[1:] == key[:-1]] >> 32
    return np.bincount(again, minlength=len(at) - 1)


def scripts_of(words: pa.Array) -> np.ndarray:
    """Letters of each script in each word: one column per entry of SCRIPTS and one for other letters."""
    texts = words.to_pylist()
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.full(len(points), -1)
    for k, (_, lo, hi) in enumerate(SCRIPTS):
        kind[(points >= lo) & (points <= hi)] = k
    kind[(kind < 0) & (points > 0x24F)] = len(SCRIPTS)
    kind[(points < 0xC0) & ~(((points | 32) >= 97) & ((points | 32) <= 122))] = -1
    out = np.zeros((len(texts), len(SCRIPTS) + 1), np.int64)
    word = np.repeat(np.arange(len(texts)), lens)
    np.add.at(out, (word[kind >= 0], kind[kind >= 0]), 1)
    return out


def entropies(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shannon entropy in bits of each row's token distribution; 0 for a row without tokens."""
    n = np.diff(offsets)
    key = np.sort(np.repeat(np.arange(len(n)), n) << 32 | ids.astype(np.int64))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([first, [len(key)]])).astype(np.float64)
    row = key[first] >> 32
    total = n[row].astype(np.float64)
    return np.bincount(row, -(count / total) * np.log2(count / total), minlength=len(n)) + 0.0


def byte_counts(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and byte-fallback tokens of each word in a vocabulary with byte fallback."""
    import sentencepiece

    state = worker_state().setdefault("pieces", {})
    if path not in state:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        state[path] = model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    model, is_byte = state[path]
    found = model.encode(words.to_pylist(), num_threads=1)
    n = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((i for ids in found for i in ids), np.int64, int(n.sum()))
    return n, segment_sums(is_byte[flat].astype(np.int64), np.concatenate([[0], np.cumsum(n)]))


def text_metrics(docs: DataFrame, vocabulary: str, pieces: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns and the metrics of every text.

    Null text counts as empty; a text without tokens has null fertility,
    byte share and entropy.
    """
    def make():
        table = TokenTable(vocabulary)

        def metrics(texts):
            w = Words(texts)
            out = {"n_words": w.counts, "word_chars": w.sums(pc.utf8_length(w.words).to_numpy(zero_copy_only=False).astype(np.int64)),
                   "n_symbols": pc.count_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64), "n_dup_lines": duplicate_lines(texts),
                   "n_repeat_words": repeated_window_words(w.codes.astype(np.int64), w.offsets)}
            out["base_failed"] = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
            ids, at = ragged(*table(w.words), w.codes)
            at = at[w.offsets]
            n = np.diff(at)
            none = n == 0
            units, fallback = (w.sums(x) for x in byte_counts(w.words, pieces))
            scripts = np.stack([w.sums(c) for c in scripts_of(w.words).T], axis=1)
            names = np.array([s[0] for s in SCRIPTS] + ["other", "none"])
            script = np.where(scripts.sum(axis=1) > 0, scripts.argmax(axis=1), len(SCRIPTS) + 1)
            return out | {"n_tokens": n, "chars_per_token": pa.array(out["word_chars"] / np.maximum(n, 1), mask=none), "byte_share": pa.array(fallback / np.maximum(units, 1), mask=none),
                          "token_entropy": pa.array(entropies(ids, at), mask=none), "script": pa.array(names[script].tolist())}
        return metrics

    return map_text(docs, make, FIELDS, text, keep, TOKEN_CHUNK_BYTES)


BOUNDS = ["cpt_low", "cpt_high", "byte_high", "entropy_low"]


def bands(metrics: DataFrame, group: str, reach: float = 4.0) -> DataFrame:
    """Normal range of the metrics per group over all documents that pass the base rules, and their number ``n``.

    A bound lies ``reach`` interquartile ranges outside the quartiles.
    """
    wide = lambda c, floor: F.greatest(F.col(f"{c}_q")[1] - F.col(f"{c}_q")[0], F.lit(floor)) * reach
    quartiles = (metrics.where(~F.col("base_failed") & F.col("chars_per_token").isNotNull()).groupBy(group)
                 .agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(c, [0.25, 0.75], 1000).alias(f"{c}_q") for c in ("chars_per_token", "byte_share", "token_entropy")]))
    return quartiles.select(group, "n", (F.col("chars_per_token_q")[0] - wide("chars_per_token", 0.1)).alias("cpt_low"), (F.col("chars_per_token_q")[1] + wide("chars_per_token", 0.1)).alias("cpt_high"),
                            (F.col("byte_share_q")[1] + wide("byte_share", 0.02)).alias("byte_high"), (F.col("token_entropy_q")[0] - wide("token_entropy", 0.25)).alias("entropy_low"))


# bounds of characters per token, byte share and entropy in bits by script, in the order of BOUNDS: about half and three times the characters per
# token, and 0.2 above the byte share, that the two public vocabularies give plain sentences (Latin: Vietnamese 0.76 to English 4.09)
FIXED = {"latin": (0.4, 12.0, 0.25, 2.0), "greek": (0.25, 1.5, 0.2, 2.0), "cyrillic": (0.4, 2.4, 0.2, 2.0), "hebrew": (0.25, 1.5, 0.2, 2.0), "arabic": (0.45, 2.9, 0.2, 2.0),
         "devanagari": (0.4, 2.4, 0.3, 2.0), "thai": (0.45, 2.7, 0.2, 2.0), "hangul": (0.25, 1.5, 0.25, 2.0), "kana": (0.25, 1.7, 0.35, 2.0), "han": (0.2, 1.3, 0.2, 2.0)}
OTHER = (0.2, 12.0, 0.9, 2.0)


def with_bounds(metrics: DataFrame, reach: float, weight: float = 25.0) -> DataFrame:
    """Adds BOUNDS: those of the text's group, averaged, as if of ``weight`` documents, with those of its script, and these likewise with FIXED.

    Every group is averaged by its number of documents; there is no size at which the verdict changes over.
    """
    joined = metrics
    for group, tag in (("band_group", "own"), ("script", "wide")):
        found = bands(metrics, group, reach)
        joined = join_small(joined, found.select(group, *[F.col(c).alias(f"{tag}_{c}") for c in ["n", *BOUNDS]]), [group])
    for k, name in enumerate(BOUNDS):
        bound = F.coalesce(F.create_map(*[F.lit(x) for s, v in FIXED.items() for x in (s, v[k])])[F.col("script")], F.lit(OTHER[k]))
        for tag in ("wide", "own"):
            n = F.coalesce(f"{tag}_n", F.lit(0))
            bound = (n * F.coalesce(f"{tag}_{name}", F.lit(0.0)) + weight * bound) / (n + weight)
        joined = joined.withColumn(name, bound)
    return joined


def judge(docs: DataFrame, vocabulary: str, pieces: str, text: str = "text", lang: str = "lang", keep: list[str] | None = None, reach: float = 4.0) -> DataFrame:
    """Kept columns, metrics, ``reason`` (null: none) and ``kept``.

    The group of a text is its language, or its script where that is null. Low
    entropy rejects only texts whose tokens also carry under half the bits that
    distinct tokens would, so short texts are not rejected for being short.
    """
    cols = list(dict.fromkeys((docs.columns if keep is None else keep) + [lang]))
    m = durable(text_metrics(docs, vocabulary, pieces, text, cols).withColumn("band_group", F.coalesce(F.col(lang), F.concat(F.lit("script:"), "script"))))
    joined = with_bounds(m, reach)
    reason = (F.when(F.col("base_failed"), "base").when(F.col("chars_per_token").isNull(), "no tokens")
              .when(~F.col("chars_per_token").between(F.col("cpt_low"), F.col("cpt_high")), "characters per token").when(F.col("byte_share") > F.col("byte_high"), "byte fallback")
              .when((F.col("token_entropy") < F.col("entropy_low")) & (F.col("token_entropy") < 0.5 * F.log2("n_tokens")), "token entropy"))
    kept = [c for c in cols if c in m.columns and (keep is None or c in keep)]
    return joined.withColumn("reason", reason).select(*kept, *[f.name for f in FIELDS if f.name not in kept], "band_group", "reason", F.col("reason").isNull().alias("kept"))
