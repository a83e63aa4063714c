import random
import re

import corpus_pipeline
from cytogrid.llm import simhash


def plain_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(rows):
    """Smallest doc_id of each component of pairs with a similarity of 0.8 or more."""
    sets, root = {d: plain_sets(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                a_, b_ = sorted((find(a), find(b)))
                root[b_] = a_
    return {find(d) for d in sets}


def texts():
    """Copies with 0 to 14 words of 300 changed, chains, templates at about 0.7, and short texts."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    out = []
    for _ in range(6):
        base = [word() for _ in range(300)]
        for changes in range(0, 15):
            other = list(base)
            for k in rng.sample(range(300), changes):
                other[k] = word()
            out.append(other)
    chain = [word() for _ in range(200)]
    for k in range(12):
        out.append(chain[15 * k // 2:] + [word() for _ in range(15 * k // 2)])
    template = [word() for _ in range(100)]
    out += [template[:85] + [word() for _ in range(15)] for _ in range(40)]
    out += [["a", "b"], ["a", "b"], ["A", "B"], ["a"], ["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "e", "f"]]
    return [(i, " ".join(x)) for i, x in enumerate(out)]


def test_stage_against_all_pairs(spark, tmp_path):
    rows = texts()
    spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string").repartition(5).write.parquet(str(tmp_path / "d"))
    kept = corpus_pipeline.near_duplicates(spark, spark.read.parquet(str(tmp_path / "d")), "").collect()
    assert {r.doc_id for r in kept} == plain_kept(rows)


def test_numbers_hold_when_the_splits_change(spark, tmp_path):
    """The splits differ between the first job and the last, as after the loss of an executor."""
    spark.createDataFrame([(i // 2, f"text {i // 2} " * 50) for i in range(4000)], "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "d"))

    def find(rows, *args):
        found = simhash.near_duplicates(rows, *args).checkpoint()
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        return found
    try:
        kept = simhash.keep_first(spark.read.parquet(str(tmp_path / "d")), find=find).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = simhash.near_duplicates(spark.read.parquet(str(tmp_path / "d"))).select("component_id").distinct().collect()
    assert sorted(r.doc_id for r in kept) == sorted(r.component_id for r in want)


def test_edited_copies_that_cannot_be_similar_are_not_compared(spark, monkeypatch):
    """Copies of one text with too many words of their own share bands, but each is compared about once."""
    from pyspark.sql import functions as F

    from cytogrid.llm import shingles
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(100)]
    rows = [(i, " ".join(base[:85] + [word() for _ in range(15)])) for i in range(200)] + [(200 + i, " ".join(base[:100 - i] + [word() for _ in range(i)])) for i in range(8)]
    compared, plain = [], shingles.similar
    monkeypatch.setattr(shingles, "similar", lambda pairs, *a: compared.append(pairs.count()) or plain(pairs, *a))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__row", F.col("doc_id")).repartition(5).localCheckpoint()
    found = shingles.near_duplicates(docs).groupBy("root").agg(F.min("doc_id").alias("doc_id")).collect()
    assert {r.doc_id for r in found} == plain_kept(rows)
    assert sum(compared) < 20 * len(rows), compared
