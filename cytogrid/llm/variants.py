"""Spelling variants by composing finite-state machines.

The vocabulary is a minimised acceptor: its states are the distinct sets of word
endings. Composed with a transducer that makes one edit, and with the acceptor
again, it accepts the pairs of words that are one inserted, deleted or replaced
letter apart. The composition is enumerated by its initial state: two such
words of which the shorter has m letters share their first half, or else their
second, and the composed machine starts in the state after that half. Words
are dealt out by these halves (second halves read backwards) and a task
enumerates the pairs of a half. A half with too many words is split by its next
letter; pairs whose edit is that letter are then grouped by the ending behind the edit.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cytogrid.llm.common import byte_table, byte_tokens, stored, text_chunks

SLICE_BYTES = 8 << 20
LEAD = 0xC3  # first UTF-8 byte of U+00C0 to U+00FF
LETTER = byte_table(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b == LEAD)
LEAST_LETTERS, LEAST_COUNT = 5, 3
CROWD = 20_000


def word_counts(docs: DataFrame, doc_id: str, text: str, damage: int | None) -> DataFrame:
    """word, n of all runs of letters with LEAST_LETTERS or more, A-Z in lower case.

    If ``damage`` divides the crc32 of "<doc_id>:<run>", the run loses the letter at that number modulo its length.
    """
    def run(batches):
        for chunk in text_chunks(batches, "text", SLICE_BYTES):
            runs, at, _, _ = byte_tokens(chunk.column("text"), LETTER, LEAD)
            found = runs.dictionary_encode()
            codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            words, n = found.dictionary.cast(pa.string()), np.bincount(codes, minlength=len(found.dictionary))
            made = {}
            if damage:
                row = np.repeat(np.arange(len(at) - 1), np.diff(at))
                own, times = np.unique(row << 32 | codes, return_counts=True)
                begin = [zlib.crc32(f"{'' if d is None else d}:".encode()) for d in chunk.column("doc_id").to_pylist()]
                raw = words.cast(pa.binary()).to_pylist()
                code = own & 0xFFFFFFFF
                h = np.fromiter(map(zlib.crc32, map(raw.__getitem__, code.tolist()), map(begin.__getitem__, (own >> 32).tolist())), np.uint32, len(own)).astype(np.int64)
                for k in np.flatnonzero(h % damage == 0).tolist():
                    whole = raw[code[k]].decode()
                    gone = int(h[k]) % len(whole)
                    left = whole[:gone] + whole[gone + 1:]
                    made[left] = made.get(left, 0) + int(times[k])
                    n[code[k]] -= times[k]
            words = pa.concat_arrays([words, pa.array(list(made), pa.string())])
            n = np.concatenate([n, np.fromiter(made.values(), np.int64, len(made))])
            fine = (n > 0) & (pc.utf8_length(words).to_numpy() >= LEAST_LETTERS)
            yield pa.RecordBatch.from_arrays([words.filter(pa.array(fine)), pa.array(n[fine])], names=["word", "n"])

    source = docs.select(F.col(f"`{doc_id}`").cast("string").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """Minimal acceptors of sorted word lists, with common states: arcs, the rank of the first word behind each arc, and the number of words of each state.

    State 0 accepts the empty ending only, which holds for lists of words of one length.
    """

    def __init__(self):
        self.arcs, self.ranks, self.count = [{}], [{}], [1]
        self.known, self.single, self.met = {(): 0}, {"": 0}, {}

    def state(self, arcs: list[tuple[str, int]]) -> int:
        key = tuple(arcs)
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.arcs)
            total, ranks = 0, {}
            for c, to in arcs:
                ranks[c] = total
                total += self.count[to]
            self.arcs.append(dict(arcs))
            self.ranks.append(ranks)
            self.count.append(total)
        return found

    def add(self, words: list[str], low: int, high: int, depth: int) -> int:
        """State that accepts the endings of ``words[low:high]`` behind their first ``depth`` letters."""
        if high - low == 1:
            ending = words[low][depth:]
            found = self.single.get(ending)
            if found is None:
                found = 0
                for k in range(len(ending) - 1, -1, -1):
                    shorter = self.single.get(ending[k:])
                    found = self.single[ending[k:]] = self.state([(ending[k], found)]) if shorter is None else shorter
            return found
        if len(words[low]) == depth:
            return 0
        arcs = []
        while low < high:
            c, stop = words[low][depth], low + 1
            while stop < high and words[stop][depth] == c:
                stop += 1
            arcs.append((c, self.add(words, low, stop, depth + 1)))
            low = stop
        return self.state(arcs)

    def meet(self, a: int, b: int) -> tuple[list[int], list[int]]:
        """Ranks in both states of the endings that both accept."""
        if a == b:
            every = list(range(self.count[a]))
            return every, every
        found = self.met.get((a, b))
        if found is None:
            one, two = [], []
            for c, x in self.arcs[a].items():
                y = self.arcs[b].get(c)
                if y is not None:
                    p, q = self.meet(x, y)
                    one += [self.ranks[a][c] + r for r in p]
                    two += [self.ranks[b][c] + r for r in q]
            found = self.met[a, b] = one, two
        return found


def pairs_of(short: list[str], long: list[str], depth: int, back: bool, out_one: list[int], out_two: list[int], at: int) -> None:
    """Pairs that are one edit apart behind a common start of ``depth`` letters: numbers in ``short + long``, counted from ``at``.

    ``short`` and ``long`` are sorted, of m and m + 1 letters. Replaced letters
    join two short words, a deletion a long and a short one; of the places of a
    deletion in a run of one letter the last counts. ``back``: words are
    reversed, and pairs that share the first half of m letters are left out.
    """
    m, machine = len(short[0]), Acceptor()
    arcs, ranks = machine.arcs, machine.ranks
    start = machine.add(short, 0, len(short), depth)
    replace = [(start, 0, depth)] if len(short) > 1 else []
    while replace:
        q, base, d = replace.pop()
        own = list(arcs[q].items())
        for i, (c, x) in enumerate(own):
            if machine.count[x] > 1:
                replace.append((x, base + ranks[q][c], d + 1))
            if not (back and m - 1 - d >= m // 2):
                for e, y in own[i + 1:]:
                    p, r = machine.meet(x, y)
                    if p:
                        one, two = at + base + ranks[q][c], at + base + ranks[q][e]
                        out_one += [one + k for k in p]
                        out_two += [two + k for k in r]
    if not long:
        return
    delete = [(machine.add(long, 0, len(long), depth), start, 0, 0, long[0][:depth])]
    while delete:
        q, s, base_q, base_s, path = delete.pop()
        for c, x in arcs[q].items():
            first = base_q + ranks[q][c]
            same = arcs[s].get(c)
            if same is not None:
                delete.append((x, same, first, base_s + ranks[s][c], path + c))
            if back and m - len(path) + len(path) - len(path.rstrip(c)) >= m // 2:
                continue
            if s == 0:  # the short word ends here, and so must the long one
                if x == 0:
                    out_one.append(at + len(short) + first)
                    out_two.append(at + base_s)
                continue
            for e, z in arcs[x].items():
                y = arcs[s].get(e)
                if e != c and y is not None:
                    p, r = machine.meet(z, y)
                    if p:
                        one, two = at + len(short) + first + ranks[x][e], at + base_s + ranks[s][e]
                        out_one += [one + k for k in p]
                        out_two += [two + k for k in r]


def near(vocabulary: DataFrame, crowd: int = CROWD) -> DataFrame:
    """word, n_near, best_n and best of the words of ``vocabulary`` (word, n; distinct, durable) with words one edit apart: their number and the most frequent one, ties to the first in code-point order."""
    letters = F.length("word")
    deals = F.array(*[F.struct(F.lit(back).alias("back"), m.alias("m"), (F.floor((m + 1) / 2) if back else F.floor(m / 2)).cast("int").alias("depth"))
                      for back in (False, True) for m in (letters, letters - 1)])
    whole = vocabulary.select("n", "word", F.explode(deals).alias("d")).where(F.col("d.m") >= LEAST_LETTERS)
    rows = whole.select("d.back", "d.m", "d.depth", F.when(F.col("d.back"), F.reverse("word")).otherwise(F.col("word")).alias("s"), "n").withColumn("ending", F.lit(None).cast("string")).withColumn("kind", F.lit("half"))
    settled, begin = None, F.expr("substring(s, 1, depth)")
    group = ["back", "m", "depth", "begin"]
    while True:
        rows = rows.withColumn("begin", begin)
        crowded = stored(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > crowd).select(*group))
        if crowded.isEmpty():
            settled = rows if settled is None else settled.unionByName(rows)
            break
        fine = rows.join(crowded, group, "left_anti")
        split = rows.join(crowded, group, "left_semi")
        behind, rest = F.expr("substring(s, depth + 2)"), F.expr("substring(s, depth + 1)")
        short = F.length("s") == F.col("m")
        replaced = split.where(short).withColumn("ending", behind).withColumn("kind", F.lit("replaced"))
        dropped = split.withColumn("ending", F.when(short, rest).otherwise(behind)).withColumn("kind", F.lit("deleted"))
        fine = fine.unionByName(replaced).unionByName(dropped)
        settled = fine if settled is None else settled.unionByName(fine)
        rows = split.withColumn("depth", F.col("depth") + 1)
    keyed = settled.select(F.concat_ws("|", "kind", F.col("back").cast("string"), "m", "depth", "begin", "ending").alias("half"), "kind", "back", "m", "depth", (F.length("s") > F.col("m")).alias("longer"), "s", "n")

    def enumerate_pairs(batches):
        tail = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if tail is None else pa.concat_tables([tail, table]).combine_chunks()
            code = table.column("half").combine_chunks().dictionary_encode().indices.to_numpy()
            last = int(np.searchsorted(code, code[-1])) if len(code) else 0
            tail = table.slice(last)
            if last:
                yield from judge(table.slice(0, last), code[:last])
        if tail is not None and tail.num_rows:
            yield from judge(tail, tail.combine_chunks().column("half").combine_chunks().dictionary_encode().indices.to_numpy())

    def judge(table: pa.Table, code: np.ndarray):
        words, n, longer = table.column("s").to_pylist(), table.column("n").to_numpy(), table.column("longer").to_numpy()
        kinds, backs, ms, depths = (table.column(c).to_pylist() for c in ("kind", "back", "m", "depth"))
        cuts = np.append(np.flatnonzero(np.diff(code, prepend=-1)), len(code)).tolist()
        one, two = [], []
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2 or longer[a]:
                continue  # a word alone, or no short one
            stop = a + int(np.searchsorted(longer[a:b], True))
            m, depth, back = ms[a], depths[a], backs[a]
            if kinds[a] == "half":
                pairs_of(words[a:stop], words[stop:b], depth, back, one, two, a)
            elif kinds[a] == "replaced":
                if not (back and m - 1 - depth >= m // 2):
                    for i in range(a, b):
                        one += [i] * (b - i - 1)
                        two += range(i + 1, b)
            else:  # one short word, and the long ones that become it by losing the letter at ``depth``
                for i in range(stop, b):
                    w = words[i]
                    c, path = w[depth], w[:depth]
                    if w[depth + 1:depth + 2] != c and not (back and m - depth + depth - len(path.rstrip(c)) >= m // 2):
                        one.append(i)
                        two.append(a)
        if not one:
            return
        plain = pa.array([w[::-1] if back else w for w, back in zip(words, backs)], pa.string())
        order = np.empty(len(words), np.int64)
        order[pc.sort_indices(plain).to_numpy()] = np.arange(len(words))
        of, other = np.array(one + two), np.array(two + one)
        by = np.lexsort((order[other], -n[other], of))
        of, other = of[by], other[by]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        count = np.diff(np.append(first, len(of)))
        yield pa.RecordBatch.from_arrays([plain.take(pa.array(of[first])), pa.array(count), pa.array(n[other[first]]), plain.take(pa.array(other[first]))], names=["word", "n_near", "best_n", "best"])

    found = keyed.repartition("half").sortWithinPartitions("half", "longer", "s").mapInArrow(enumerate_pairs, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain from each word of ``forms`` (word, form), by doubling the steps taken. Chains must end."""
    now = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not now.where("moved").isEmpty():
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    return now.select("word", "root")


def spellings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_COUNT, times: int = 2, damage: int | None = None) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words that occur ``least`` times.

    A word's form is its most frequent neighbour, ties to the first in code-point order,
    if that is ``times`` (over 1) as frequent as the word; the root is the end of the
    chain of forms. Null texts have no words, null ids count as empty in
    ``damage``. Repeated rows count each time; other columns do not matter.
    """
    assert times > 1, "chains of forms end only if frequencies grow"
    vocabulary = stored(word_counts(docs, doc_id, text, damage).where(F.col("n") >= least))
    judged = vocabulary.join(near(vocabulary), "word", "left")
    better = F.col("best_n") >= times * F.col("n")
    judged = stored(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(better, F.col("best")).alias("form"), F.when(better, F.col("best_n")).alias("form_n")))
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
