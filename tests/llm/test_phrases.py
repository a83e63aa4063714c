import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cytogrid.llm import phrases

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_collocations(rows, longest=3, least=10, cover=50, top=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f.setdefault(lang, Counter())[tuple(words[i:i + m])] += 1
    out = []
    for lang, count in f.items():
        some = {p for p, a in count.items() if len(p) > 1 and a >= least}
        gone = {p[i:i + m] for p in some for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * count[p] >= cover * count[p[i:i + m]]}
        best = []
        for p in some - gone:
            score, k = min((1000000 * count[p] ** 2 // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -count[p], " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


def texts(seed=1, n=120):
    rng = random.Random(seed)
    words = ["the", "of", "The", "new", "york", "city", "hall", "\u00e9t\u00e9", "x\x1cy", "a", "b"]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(60)):
            parts += ["new", "york", "city"] if rng.random() < 0.2 else [rng.choice(words)]
            parts.append(rng.choice(["", "", "", ",", ".", "\n", "\x0b", " ;"]))
        out.append((" ".join(parts).replace(" ,", ","), rng.choice(["en", "de", None, "und"])))
    return out


@pytest.mark.parametrize("longest, least, cover, top, block", [(3, 10, 50, 2000, 2_000_000), (4, 3, 80, 7, 50), (2, 1, 50, 2000, 300), (5, 4, 30, None, 1)])
def test_against_counting_every_phrase(spark, longest, least, cover, top, block):
    rows = texts()
    docs = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, block long, word string").repartition(5)
    got = phrases.collocations(docs, longest=longest, least=least, cover=cover, top=top, block_words=block).collect()
    assert sorted(tuple(r) for r in got) == plain_collocations(rows, longest, least, cover, 10 ** 9 if top is None else top)


def test_counts_beyond_64_bits_are_exact(spark):
    big = 3_000_000_000_001
    rows = spark.createDataFrame([(big, [big + 7, big + 9], [big + 2, big + 1])], "total long, pre array<long>, suf array<long>")
    cut = rows.select(phrases.cut_score(3).alias("c")).first().c
    assert (cut.score, cut.k, cut.l, cut.r) == min((1000000 * big * big // (l * r), k, l, r) for k, l, r in ((1, big + 7, big + 1), (2, big + 9, big + 2)))


def test_odd_texts_and_repeated_rows(odd_docs, no_docs):
    got = phrases.collocations(odd_docs, least=2).collect()
    assert sorted(tuple(r) for r in got) == plain_collocations([(r.text, r.lang) for r in odd_docs.collect()], least=2)
    assert phrases.collocations(no_docs).collect() == []
    assert phrases.collocations(odd_docs.where("text = ''")).collect() == []


def test_result_does_not_depend_on_the_partitions(spark):
    docs = spark.createDataFrame(texts(2), "text string, lang string")
    one, two = (sorted(map(tuple, phrases.collocations(docs.repartition(n), least=5).collect())) for n in (1, 9))
    assert one == two and one


def test_one_language_and_one_phrase_hold_most_rows(spark):
    docs = spark.range(3000).select(F.lit("hot phrase here. " * 5).alias("text"), F.lit("en").alias("lang")).repartition(7)
    rows = phrases.collocations(docs, block_words=500).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.score) for r in rows] == [("hot phrase here", 15000, 15000, 15000, 1000000)]
