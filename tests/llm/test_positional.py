import hashlib
import random
import re

import numpy as np
import pytest

from cytogrid.llm import positional

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_windows(items, width):
    out = []
    for item, text in items:
        w = words(text)
        out += [(item, tuple(w[i:i + width])) for i in range(max(len(w) - width + 1, 1)) if w]
    return out


def plain_contamination(docs, items, width=10):
    asked, out = plain_windows(items, width), []
    for d, text in docs:
        own, hit, names = words(text), set(), set()
        for item, window in asked:
            for i in range(len(own) - len(window) + 1):
                if tuple(own[i:i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    names.add(str(item) if item is not None else "")
        out.append((d, len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "a1", "\u4e2d", "caf\u00e9", "x", "y", "z"]
    make = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "-"]) for _ in range(n))
    items = [(i, make(rng.randrange(0, 14))) for i in range(30)] + [(100, "the of"), (101, "the of"), (102, None), (None, "x y z x")]
    docs = [(i, " ".join([make(rng.randrange(30)), rng.choice(items)[1] or "", make(rng.randrange(30))])) for i in range(60)] + [(7, None), (8, ""), (9, "the the the the"), (9, "the the the the")]
    return docs, items


@pytest.mark.parametrize("width, size", [(10, 8 << 20), (4, 200), (3, 1), (1, 500)])
def test_against_every_place_of_every_window(spark, width, size, monkeypatch):
    docs, items = corpus(width)
    build = positional.build
    monkeypatch.setattr(positional, "build", lambda *a: build(*a, segment_bytes=size))
    got = positional.contamination(spark.createDataFrame([(d, t, "s", 0) for d, t in docs], "doc_id long, text string, segment string, n long").repartition(3),
                                   spark.createDataFrame([(i, t, "w") for i, t in items], "item_id long, text string, terms string"), width).collect()
    assert sorted(map(tuple, got), key=str) == plain_contamination(docs, items, width)


def test_windows_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(positional, "WINDOWS", 5)
    docs, items = corpus(5)
    got = positional.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 3).collect()
    assert sorted(map(tuple, got), key=str) == plain_contamination(docs, items, 3)


def plain_close(text, window, reach):
    own, terms, out = words(text), set(window), set()
    for i in range(len(own)):
        if own[i] in terms:
            left = set(terms)
            for k in range(i, min(i + reach, len(own))):
                left.discard(own[k])
                if not left:
                    out.add((i, k - i + 1))
                    break
    return out


@pytest.mark.parametrize("reach", [3, 6, 12])
def test_proximity_against_every_stretch(spark, reach):
    docs, items = corpus(11)
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    index = positional.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), segment_bytes=300)
    found, of = positional.passages(index, spark.createDataFrame(items, "item_id long, text string"), 3, reach)
    got = {(r.doc_id, r.item_id, r.window_id, r.word, r.length) for r in found.join(of, "window_id").join(index.documents, ["segment", "doc"]).collect()}
    want = {(d, item, i, n) for d, t in docs for item, w in plain_windows(items, 3) for i, n in plain_close(t, w, reach)}
    assert {(d, item, i, n) for d, item, _, i, n in got} == want and want


def test_places_survive_their_encoding():
    rng = np.random.default_rng(2)
    lists = [np.sort(rng.choice(1 << 38, n, replace=False)) for n in (0, 1, 5, 0, 1000)] + [np.arange(300), np.array([0, 127, 128, 16383, 16384, 1 << 35])]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    places, at = positional.gaps_in(positional.gaps_out(np.concatenate(lists).astype(np.int64), offsets))
    assert (at == offsets).all() and (places == np.concatenate(lists)).all()


def test_odd_texts(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect() if len(r.text or "") < 100_000]
    items = spark.createDataFrame([(1, "w0 thnd the"), (2, "one two"), (3, "g h i"), (4, None)], "item_id long, text string")
    some = odd_docs.where("text is null or length(text) < 100000")
    got = positional.contamination(some, items, 3).collect()
    assert sorted(map(tuple, got), key=str) == plain_contamination(docs, [(r.item_id, r.text) for r in items.collect()], 3)
    assert positional.contamination(no_docs, items).collect() == []
    assert not any(r.contaminated for r in positional.contamination(odd_docs, items.limit(0)).collect())
    assert positional.contamination(odd_docs, items, 3).where("n_hit > 0").count() >= 4
