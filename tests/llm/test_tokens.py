import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from cytogrid.llm import packing, token_files
from cytogrid.llm.common import TokenTable
from cytogrid.llm.queries import QUERIES, WORD_VOCABULARY
from odd_texts import TEXTS

PLAIN = Tokenizer.from_file(WORD_VOCABULARY)


def ids_of(text, end):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_word_table_equals_whole_text():
    ids, at = TokenTable(WORD_VOCABULARY).rows(pa.array([t or "" for t in TEXTS]), 1)
    for i, t in enumerate(TEXTS):
        assert ids[at[i]:at[i + 1]].tolist() == ids_of(t, 1)


def test_letters_that_fold_to_more_than_a_letter():
    texts = ["s\u0130", "s\u0130. b", "\u0130\u0130 x\u0130", "".join(chr(c) + "a " for c in range(0xC0, 0x250))]
    ids, at = TokenTable(WORD_VOCABULARY).rows(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aAbI'stsd.,!?;:-$<|>̱̇éİ \n\t ​1", max_size=30), max_size=5))
def test_word_table_on_odd_strings(texts):
    ids, at = TokenTable(WORD_VOCABULARY).rows(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(40000, 40100), max_size=1500), st.floats(0, 1))
def test_blocks_round_trip(values, percentile):
    ids = np.array(values, dtype=np.uint32)
    payload, starts = token_files.encode_blocks(ids, percentile)
    assert (token_files.decode_blocks(payload, starts, 0, len(ids)) == ids).all()
    lo, hi = len(ids) // 3, len(ids) * 2 // 3
    assert (token_files.decode_blocks(payload, starts, lo, hi) == ids[lo:hi]).all()


def test_outliers_go_to_exceptions():
    ids = np.full(512, 7, np.uint32)
    ids[100] = 49_000
    payload, _ = token_files.encode_blocks(ids)
    assert len(payload) == token_files.HEADER.itemsize + 2 + 4


def test_files_hold_all_documents_in_order(odd_docs, tmp_path):
    token_files.write_token_files(odd_docs, WORD_VOCABULARY, str(tmp_path / "f"))
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32, tuple(r.ids)) for r in token_files.read_token_files(odd_docs.sparkSession, str(tmp_path / "f"), True).collect()))
    want = [(r.doc_id, tuple(ids_of(r.text, 2))) for r in odd_docs.collect()]
    assert [g[1] for g in got] == sorted((w[0] for w in want), key=lambda d: (d is not None, d))
    assert sorted(((g[1], g[4]) for g in got), key=str) == sorted(want, key=str)
    position = 0
    for start, _, n, c, ids in got:
        assert (start, n, c) == (position, len(ids), crc(ids))
        position += n


def test_empty_file_set(no_docs):
    assert token_files.round_trip(no_docs, WORD_VOCABULARY).count() == 0


def test_op8_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op8_token_files"](spark, sf).collect()}
    position = 0
    for r in docs:
        ids = ids_of(r.text, 2)
        assert got.pop(r.doc_id) == (position, len(ids), crc(ids))
        position += len(ids)
    assert not got


def check_packing(rows, docs, capacity, end=1):
    slots, pieces = {}, {}
    for r in rows:
        slots.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    for s in slots.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    want = {}
    for r in docs:
        ids = ids_of(r.text, end)
        for a in range(0, len(ids), capacity):
            want.setdefault((r.doc_id, len(ids)), []).append((a, len(ids[a:a + capacity]), crc(ids[a:a + capacity])))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    return len(slots)


def test_packing_of_odd_texts(odd_docs):
    packed = packing.pack_documents(odd_docs, WORD_VOCABULARY, capacity=64, with_ids=True).cache()
    check_packing(packed.collect(), odd_docs.collect(), 64)
    whole = packing.sequences(packed, 64).collect()
    assert all(len(r.ids) == 64 for r in whole) and sum(64 - r.n_padding for r in whole) == sum(len(ids_of(r.text, 1)) for r in odd_docs.collect())


def test_packing_nothing(no_docs):
    assert packing.pack_documents(no_docs, WORD_VOCABULARY).collect() == []


def test_op6_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    n = check_packing(QUERIES["op6_bin_slack"](spark, sf).collect(), docs, 2048)
    assert n <= -(-sum(len(ids_of(r.text, 1)) for r in docs) // 2048) + 2


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=12), st.integers(0, 40))
def test_fill_is_closest(counts, room):
    table = np.zeros(41, np.int64)
    for k, v in counts.items():
        table[k] = v
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * k for s in sums for k in range(n + 1)}
    items = packing.closest_fill(table, room)
    assert all(n <= counts[length] for length, n in items) and len({length for length, _ in items}) == len(items)
    assert sum(length * n for length, n in items) == max(s for s in sums if s <= room)


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 1000), max_size=20))
def test_plan_uses_every_piece_once(histogram):
    used = {}
    for p in packing.plan(histogram, 64):
        assert p.repeats > 0 and sum(length * n for length, n in p.items) <= 64
        for length, n in p.items:
            used[length] = used.get(length, 0) + n * p.repeats
    assert used == histogram


def test_hot_length_is_ranked_without_gaps(spark):
    pieces = spark.range(3000).selectExpr("id as doc_id", "0L as start", "id as ids_crc32", "if(id % 3 = 0, 7L, 1 + id % 60) as length").cache()
    rows = packing.pack(pieces, ["doc_id"], 64).collect()
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in fill.values():
        assert [o for o, _ in sorted(s)] == np.concatenate([[0], np.cumsum([n for _, n in sorted(s)])[:-1]]).tolist() and sum(n for _, n in s) <= 64
    assert len(rows) == 3000
