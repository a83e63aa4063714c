import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings, strategies as st

from cytogrid.llm import fertility, kd_shards, mixing, url_rules
from cytogrid.llm.queries import ORACLE, PIECE_VOCABULARY, QUERIES, RULES, WORD_VOCABULARY

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rounded(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_twins(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    want = con.sql("select " + ", ".join(df.columns) + f" from ({ORACLE[name]})").fetchall()
    assert rounded(tuple(r) for r in df.collect()) == rounded(want)


# ---------------------------------------------------------------- mixing

def plain_targets(sizes, share=1.5, most=2.0):
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, target, open_ = share * sum(sizes.values()), {}, dict(sizes)
    while open_:
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / total >= most * sizes[s]]
        if not over:
            return target | {s: left * weights[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            del open_[s]
        left = share * sum(sizes.values()) - sum(target.values())
    return target


def check_mix(rows, docs):
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in docs:
        sizes[r.source] += len(WORD.findall(r.text or ""))
        largest[r.source] = max(largest[r.source], len(WORD.findall(r.text or "")))
    want = plain_targets(dict(sizes))
    assert sorted(((r.doc_id, r.size) for r in rows), key=str) == sorted(((r.doc_id, len(WORD.findall(r.text or ""))) for r in docs), key=str)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target) and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    # copies of one id share a hash, and there are two of most
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)


def test_mix_of_odd_documents(odd_docs):
    rows = mixing.mix(odd_docs).collect()
    check_mix(rows, odd_docs.collect())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd_docs.repartition(5)).collect()))


def test_mixed_rows_follow_the_counts(odd_docs):
    counts = Counter({})
    for r in mixing.mix(odd_docs).collect():
        counts[r.doc_id] += r.copies
    got = mixing.mixed_documents(odd_docs)
    assert got.columns == odd_docs.columns and Counter(r.doc_id for r in got.collect()) == +counts


def test_larger_budget_contains_smaller(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    small, large = ({r.doc_id: r.copies for r in mixing.mix(docs, share=s).collect()} for s in (0.4, 0.9))
    assert all(large[d] >= n for d, n in small.items()) and sum(small.values()) < sum(large.values())


def test_mix_of_nothing(no_docs):
    assert mixing.mix(no_docs).collect() == [] and mixing.mixed_documents(no_docs).collect() == []


# ------------------------------------------------------------------ urls

def plain_url(url, rules, default="allow"):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else default


def check_urls(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect()}
    assert got == {i: plain_url(u, rules) for i, u in enumerate(urls)}


def test_urls(spark):
    urls = [None, "", "no scheme/x", "http://", "HTTP://WWW.Example.ORG/es/1", "http://example.org/en/1", "http://example.org/en/12?q#f", "http://notexample.org/es/", "http://example.org",
            "x://y://example.org/es/", "http://a.b.c.example.org/es/x", "http://shop.com/fr/1", "http://shop.com/de/1", "http://com/de/", "http://.org/", "http://org./", "http://example.org?/es/",
            "http://é.com/fr/ü", "http://a.com/fr\n/x", "http://org/a#b"]
    check_urls(spark, urls * 3, RULES)


def test_hot_host_and_many_rules(spark):
    rng = np.random.default_rng(3)
    hosts = ["org", "a.org", "b.a.org", "c.b.a.org", "x.com", "y.x.com", "com", "aa.org"]
    rules = [(h, "/" + "/".join(rng.choice(["p", "q", "pq"], rng.integers(0, 4))), str(rng.choice(["allow", "block"]))) for h in hosts for _ in range(20)]
    rules = list({(h, p): (h, p, a) for h, p, a in rules}.values())
    urls = ["http://" + ("b.a.org" if rng.random() < 0.4 else str(rng.choice(hosts + ["z.c.b.a.org", "net"]))) + "/" + "/".join(rng.choice(["p", "q", "pq"], rng.integers(0, 6))) for _ in range(2000)]
    check_urls(spark, urls, rules)


def test_no_urls(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert url_rules.judge(pages.limit(0), rules).collect() == []
    assert url_rules.judge(pages, rules.limit(0)).first().verdict == "allow"


# ---------------------------------------------------------------- shards

def check_shards(rows, docs, n):
    want = sorted((d.doc_id, len((d.text or "").encode()) + 16, zlib.crc32((d.text or "").encode())) for d in docs if d.doc_id is not None)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows if r.doc_id is not None) == want and len(rows) == len(docs)
    slots, load = {}, Counter()
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n))
    return [load[i] for i in range(n)]


def test_op7_shards_are_near_equal(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    load = check_shards(QUERIES["op7_kd_shards"](spark, sf).collect(), docs, 40)
    assert max(load) - sum(load) / 40 <= max(len(d.text.encode()) for d in docs) + 16


def test_shards_with_hot_text(spark):
    docs = spark.createDataFrame([(i, "same text" if i % 3 == 0 else f"text {i} " * (i % 50), "en" if i % 2 else None, "s" if i % 3 else None, i) for i in range(3000)],
                                 "doc_id long, text string, lang string, source string, shard int")
    load = check_shards(kd_shards.shards(docs, 7).collect(), docs.collect(), 7)
    assert max(load) < 1.03 * sum(load) / 7


def test_shards_of_odd_documents(odd_docs, no_docs):
    check_shards(kd_shards.shards(odd_docs, 5).collect(), odd_docs.collect(), 5)
    assert kd_shards.shards(no_docs, 5).collect() == []
    assert kd_shards.shards(odd_docs, target_bytes=10**9).select("shard").distinct().count() == 1


def make_docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", s) for d, t, s in rows], "doc_id long, text string, lang string, source string").repartition(5)


def loads(rows, n):
    return [sum(r.size for r in rows if r.shard == k) for k in range(n)]


def test_a_thousand_repeats_of_one_row_are_parted(spark):
    docs = make_docs(spark, [(7, "the same row, repeated", "s")] * 1000 + [(i, f"row {i}", "s") for i in range(1000)])
    load = check_shards(kd_shards.shards(docs, 10).collect(), docs.collect(), 10)
    assert max(load) - sum(load) / 10 <= 38 and min(load) - sum(load) / 10 >= -38


def test_a_document_larger_than_a_shard_has_one_of_its_own(spark):
    docs = make_docs(spark, [(-1, "x" * 50_000, "s"), (-2, "y" * 9_000, "s")] + [(i, "z" * (30 + i % 11), "s") for i in range(1000)])
    rows = kd_shards.shards(docs, 10).collect()
    load = sorted(check_shards(rows, docs.collect(), 10))
    assert load[-1] == 50_016 and load[-2] == 9_016 and load[-3] - load[0] < 150


def test_sources_with_one_prefix_are_told_apart(spark):
    docs = make_docs(spark, [(5, f"t {i:03d}", f"https://host/{i % 8}") for i in range(800)] + [(5, "t 900", None)])
    rows = kd_shards.shards(docs, 8, metadata=("source",)).withColumnRenamed("text_crc32", "c").collect()
    source = {}
    for r in docs.collect():
        source[zlib.crc32(r.text.encode())] = r.source
    assert all(len({source[r.c] for r in rows if r.shard == k}) <= 3 for k in range(8))


def plain_tree(rows, leaves, first=0):
    """rows: (key tuple, size, number); the shard of each by exact weighted medians."""
    if leaves == 1 or not rows:
        return {number: first for _, _, number in rows}
    bits = kd_shards.TIE_BITS
    dims = range(len(rows[0][0]))
    dim = max(dims, key=lambda d: ((max(k[d] for k, _, _ in rows) >> bits) - (min(k[d] for k, _, _ in rows) >> bits), -d))
    goal, before, left = sum(s for _, s, _ in rows) * (leaves // 2) / leaves, 0, []
    for key in sorted({k[dim] for k, _, _ in rows}):
        own = [r for r in rows if r[0][dim] == key]
        size = sum(s for _, s, _ in own)
        if before + size > goal and not goal - before >= before + size - goal:
            break
        left += own
        before += size
        if before > goal:
            break
    gone = {n for _, _, n in left}
    right = [r for r in rows if r[2] not in gone]
    mine = min(leaves - 1, max(1, min(len(left), max(leaves // 2, leaves - len(right)))))
    return {**plain_tree(left, mine, first), **plain_tree(right, leaves - mine, first + mine)}


@pytest.mark.parametrize("shards", [2, 7, 40])
def test_tree_against_a_plain_one(spark, shards):
    rng = random.Random(shards)
    rows = [(n, rng.randrange(1, 400), [(rng.randrange(1 << b) << kd_shards.TIE_BITS) + rng.randrange(1 << 32) for b in (30, 2, 8)]) for n in range(1500)]
    table = spark.createDataFrame(rows, "row long, size long, k array<long>").repartition(4).checkpoint()
    got = {r.row: r.shard for r in kd_shards.grow(table, shards, 3).collect()}
    assert got == plain_tree([(tuple(k), s, n) for n, s, k in rows], shards)


# ------------------------------------------------------------- fertility

def plain_repeats(words, width=5):
    windows = [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]
    seen = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(width)})


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), plain_repeats(words)


def test_op9_base_metrics(spark, sf, odd_docs):
    for docs, rows in ((odd_docs.collect(), fertility.judge(odd_docs, WORD_VOCABULARY, PIECE_VOCABULARY).collect()),
                       (spark.read.parquet(f"{sf}/documents.parquet").collect(), QUERIES["op9_fertility"](spark, sf).collect())):
        want = sorted((str(d.doc_id), *plain_base(d.text)) for d in docs)
        assert sorted((str(r.doc_id), *[r[c] for c in fertility.BASE]) for r in rows) == want
        for r in rows:
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)


def test_fertility_against_whole_texts(odd_docs):
    import sentencepiece
    from tokenizers import Tokenizer

    t, s = Tokenizer.from_file(WORD_VOCABULARY), sentencepiece.SentencePieceProcessor(model_file=PIECE_VOCABULARY)
    for r in fertility.text_metrics(odd_docs, WORD_VOCABULARY, PIECE_VOCABULARY).collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        if ids:
            p = np.array(list(Counter(ids).values())) / len(ids)
            assert abs(r.token_entropy + (p * np.log2(p)).sum()) < 1e-9
            pieces = s.encode(" ".join(WORD.findall(r.text)))
            assert abs(r.byte_share - np.mean([s.is_byte(i) for i in pieces])) < 1e-9


def test_bands_reject_what_is_strange_for_its_language(spark):
    import random
    rng = random.Random(1)
    words = ["house", "river", "mountain", "the", "of", "and", "walk", "green", "stone", "tree", "over", "people"]
    clean = [(i, " ".join(rng.choice(words) + rng.choice(["", "s"]) for _ in range(80)), "en") for i in range(200)]
    odd = [(900, " ".join("qxzvkjq%dwpx" % rng.randrange(9999) for _ in range(80)), "en"), (901, " ".join("\U00012000" + chr(0x12000 + rng.randrange(900)) for _ in range(80)), "en")]
    docs = spark.createDataFrame(clean + odd, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in fertility.judge(docs, WORD_VOCABULARY, PIECE_VOCABULARY).collect()}
    assert not kept[900] and not kept[901] and sum(kept[i] for i in range(200)) >= 198


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=30), max_size=5))
def test_repeated_windows(rows):
    codes = np.array([c for r in rows for c in r], dtype=np.int64)
    got = fertility.repeated_window_words(codes, np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64))
    assert got.tolist() == [plain_repeats(r) for r in rows]


def test_false_window_match_is_counted_by_dictionary(monkeypatch):
    class Flat:
        def integers(self, *a, **b):
            return np.zeros(a[2], np.uint64)
    monkeypatch.setattr(fertility.np.random, "default_rng", lambda seed: Flat())
    codes = np.array([1, 2, 3, 4, 5, 1, 2, 3, 4, 5, 9], dtype=np.int64)
    got = fertility.repeated_window_words(codes, np.array([0, 11], dtype=np.int64))
    assert got.tolist() == [plain_repeats(codes.tolist())]


def test_a_source_of_one_repeated_row_meets_its_target(spark):
    rows = [(3, "the same nine words again and again and again", "a")] * 1000 + [(i, "some words here", "b") for i in range(700)] + [(None, "null ids with one text", "c")] * 900
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    taken = {r.source: r for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most")).collect()}
    assert all(abs(r.taken - r.target) <= r.most / 2 for r in taken.values())
    copies = mixing.mixed_documents(docs).groupBy("source").count().collect()
    assert {r["source"]: r["count"] * taken[r["source"]].most for r in copies} == {s: r.taken for s, r in taken.items()}


# ------------------------------------------------- plain mixture and packing for the pipeline

def plain_mix(docs):
    """Each document as often as the mix takes it."""
    import hashlib

    words = {d.doc_id: len(WORD.findall(d.text or "")) for d in docs}
    sizes = Counter()
    for d in docs:
        sizes[d.source] += words[d.doc_id]
    target, out = plain_targets(dict(sizes)), []
    for s in sizes:
        own = sorted((int(hashlib.md5(f"{d.doc_id}|{hashlib.md5((d.text or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16), d.doc_id, d) for d in docs if d.source == s)
        passes = int(target[s] // sizes[s]) if sizes[s] else 0
        rest, before = target[s] - passes * sizes[s], 0
        for _, i, d in own:
            upto = before + words[i]
            out += [d] * (passes + (upto <= rest or (before < rest and upto - rest < rest - before)))
            before = upto
    return out


def check_packing_rows(rows, docs):
    from test_tokens import check_packing

    check_packing(rows, docs, 2048)
