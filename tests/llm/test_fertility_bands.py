import random

import pytest

from cytogrid.llm import fertility
from cytogrid.llm.queries import PIECE_VOCABULARY, WORD_VOCABULARY

WORDS = {"zh": "人人 生而自由 在尊严 和权利上 一律平等 他们 赋有 理性 和良心 并应 以兄弟 关系 的精神 相对待".split(),
         "el": "όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα είναι προικισμένοι με λογική".split(),
         "en": "all human beings are born free and equal in dignity and rights they have reason and conscience".split()}


def plain(rng, lang, n=70):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.mark.parametrize("few", [1, 49])
def test_few_documents_of_a_language_are_judged_by_their_script(spark, few):
    rng = random.Random(2)
    rows = [(i, plain(rng, "en"), "en") for i in range(300)]
    rows += [(1000 + i, plain(rng, "zh"), "zh") for i in range(few)] + [(2000 + i, plain(rng, "el"), "el") for i in range(few)] + [(3000, plain(rng, "el"), None)]
    rows += [(4000, " ".join(chr(0x12000 + rng.randrange(900)) + rng.choice(["abc", "the", "ofof", "andthe"]) for _ in range(80)), "sw")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.reason, r.script, r.byte_share) for r in fertility.judge(docs, WORD_VOCABULARY, PIECE_VOCABULARY).collect()}
    assert {d: r for d, r in got.items() if 1000 <= d < 4000 and r[0] not in (None, "base")} == {}
    assert got[4000][1] == "latin" and got[4000][0] is not None
