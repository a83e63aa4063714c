import random
import re
import zlib
from collections import Counter

import pytest

from cytogrid.llm import variants

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def plain_near(n):
    out = {}
    for a in n:
        own = [b for b in n if one_edit(a, b)]
        if own:
            best = min(own, key=lambda b: (-n[b], b))
            out[a] = (len(own), n[best], best)
    return out


def plain_words(rows, damage):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damage and h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def plain_spellings(rows, damage=None):
    n = plain_words(rows, damage)
    near = plain_near(n)
    form = {w: near[w][2] for w in n if w in near and near[w][1] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], near.get(w, (0,))[0], n[form[w]] if w in form else None))
    return sorted(out)


@pytest.mark.parametrize("letters, crowd", [("ab", 20_000), ("ab", 3), ("ab", 12), ("abcd\u00e9\u00ff", 20_000), ("abcd\u00e9\u00ff", 5), ("abcdefghijklmnop", 2)])
def test_pairs_against_all_pairs(spark, letters, crowd):
    rng = random.Random(len(letters) + crowd)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(5, 10))) for _ in range(400)} | {"aaaaa", "aaaaaa", "aaaaaaa", "baaaaa", "aaaaab", "abbbbb"}
    for w in list(words)[:150]:
        k = rng.randrange(len(w))
        words |= {w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1:]}
    n = {w: rng.randrange(3, 9) for w in words}
    got = variants.near(spark.createDataFrame(list(n.items()), "word string, n long").repartition(4), crowd).collect()
    assert {r.word: (r.n_near, r.best_n, r.best) for r in got} == plain_near(n)


def texts():
    rng = random.Random(4)
    base = ["colour", "color", "theatre", "theater", "th\u00e9atre", "Colours", "analyse", "analyze", "analyzes", "abcde", "abcd"]
    return [(i if i % 7 else None, " ".join(rng.choice(base) for _ in range(rng.randrange(80)))) for i in range(60)]


@pytest.mark.parametrize("damage", [None, 1, 3, 97])
def test_spellings_against_a_plain_version(spark, damage):
    rows = texts()
    docs = spark.createDataFrame([(d, t, "n", 0) for d, t in rows], "doc_id long, text string, word string, n long").repartition(3)
    assert sorted(map(tuple, variants.spellings(docs, damage=damage).collect()), key=str) == sorted(plain_spellings(rows, damage), key=str)


def test_chains_of_forms(spark):
    chain = [(f"{'a' * k}bcdef", f"{'a' * (k + 1)}bcdef") for k in range(41)]
    got = variants.roots(spark.createDataFrame(chain, "word string, form string")).collect()
    assert {r.word: r.root for r in got} == {w: "a" * 41 + "bcdef" for w, _ in chain}


def test_odd_texts(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, variants.spellings(odd_docs, damage=97).collect()), key=str) == sorted(plain_spellings(rows, 97), key=str)
    assert variants.spellings(no_docs).collect() == []
    assert variants.spellings(odd_docs.where("text is null or text = ''"), damage=97).collect() == []
