import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cytogrid.llm import language
from cytogrid.llm.common import BATCH, small_batches


def test_models_keep_every_gram_of_a_large_alphabet(spark):
    """300,000 n-grams that occur once and 60,000 that occur twice: more than one table held, and the discount depends on all of them."""
    rng = np.random.default_rng(5)
    words = ["".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 20_000, 3)) for _ in range(90_000)]
    words += words[:15_000]
    docs = spark.createDataFrame([(" ".join(words[i::50]), "zh") for i in range(50)], "text string, lang string")
    model = language.fit(docs).models[0]
    points, at, _ = language.symbols(pa.array(words))
    key = language.grams(points, at)
    grams, n = np.unique(key[key > 0], return_counts=True)
    assert len(grams) > 1 << 18
    plain = language.KneserNey(grams, n)
    for k in plain.levels:
        for a, b in zip(model.levels[k], plain.levels[k]):
            assert np.array_equal(a, b)


PREDICTED = "lang_pred string, cross_entropy double, n_symbols_read long"


def test_unseen_length_classes_and_languages_have_limits(spark):
    seen = [("en", 3.0 + 0.01 * (i % 20), 300) for i in range(400)]
    limits = language.calibrate(spark.createDataFrame(seen, PREDICTED))
    asked = [("en", 9.0, 200_000), ("en", 3.1, 200_000), ("en", 9.0, 2), ("xx", 9.0, 300), ("xx", 3.1, 300), ("und", 0.0, 0)]
    got = [r.accepted for r in language.accept(spark.createDataFrame(asked, PREDICTED), limits).collect()]
    assert got == [False, True, False, False, True, False]


def test_one_training_text_does_not_set_the_limit(spark):
    seen = [("en", 3.0 + 0.01 * (i % 20), 300) for i in range(200)]
    limit = lambda rows: {(r.lang_pred, r.length_class): r.limit for r in language.calibrate(spark.createDataFrame(rows, PREDICTED)).collect()}
    clean, junk = limit(seen), limit(seen + [("en", 12.0, 300), ("en", 12.0, 200_000)])
    assert junk["en", 4] < 1.25 * clean["en", 4] and junk["en", 8] < 0.6 * 1.25 * 12.0


def test_accept_leaves_columns_of_any_name_alone(spark):
    predicted = spark.createDataFrame([("en", 2.0, 100, "kept", 7), ("en", 9.0, 100, None, None)], "lang_pred string, cross_entropy double, n_symbols_read long, limit string, length_class int")
    limits = spark.createDataFrame([(None, None, 3.0), ("en", None, 3.0), ("en", 3, 3.0)], "lang_pred string, length_class int, limit double")
    got = language.accept(predicted, limits).orderBy("cross_entropy").collect()
    assert [(r.limit, r.length_class, r.accepted) for r in got] == [("kept", 7, True), (None, None, False)]


def test_small_batches_leave_a_limit_of_the_session(spark):
    before = spark.conf.get(BATCH)
    small_batches(spark)
    assert spark.conf.get(BATCH) == "8m"
    spark.conf.set(BATCH, "32m")
    small_batches(spark)
    assert spark.conf.get(BATCH) == "32m"
    spark.conf.set(BATCH, before)


def test_a_stage_called_by_itself_sets_small_batches(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    before = spark.conf.get(BATCH)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    set_to = spark.conf.get(BATCH)
    spark.conf.set(BATCH, before)
    assert set_to == "2m" and {r.doc_id for r in packed.collect()} == {1, 2}


class Probed(np.ndarray):
    """A table that counts how often it is read."""
    reads = 0

    def __getitem__(self, at):
        Probed.reads += 1
        return np.asarray(super().__getitem__(at))


def test_tables_are_searched_by_interpolation():
    rng = np.random.default_rng(3)
    for table in (np.unique(rng.integers(0, 1 << 63, 100_000, dtype=np.uint64)), np.unique(np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)),
                  np.array([5], np.uint64), np.array([0, (1 << 64) - 1], np.uint64), np.zeros(0, np.uint64)):
        key = np.concatenate([table[::3], rng.integers(0, 1 << 63, 1000, dtype=np.uint64), np.array([0, 5, 6, (1 << 64) - 1], np.uint64)])
        Probed.reads = 0
        at, here = language.KneserNey.find(table.view(Probed), key)
        assert here.tolist() == np.isin(key, table).tolist()
        assert (table[at[here]] == key[here]).all() and (at < max(len(table), 1)).all()
        assert bool(Probed.reads) == bool(len(table))
