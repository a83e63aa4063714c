"""One query per operator over the driver's tables, with a SQL twin where SQL can express it."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cytogrid.llm import ann, fertility, kd_shards, language, mixing, packing, phrases, positional, quality_model, simhash, token_files, url_rules, variants
from cytogrid.llm.common import durable

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECE_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents kept from learning: crc32 of the id as text is 1 modulo 3; a null id is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query
def op1_quality_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_model.classify(docs, quality_model.fit(docs), keep=["doc_id"])


@query
def op2_posting_lists(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


@query
def op3_hash_mix(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


ORACLE["op3_hash_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, size, ('0x' || substr(CASE WHEN copy = 0 THEN digest ELSE md5(digest || '#' || copy) END, 1, 15))::BIGINT AS hash
  FROM (SELECT *, row_number() OVER (PARTITION BY source, digest) - 1 AS copy
        FROM (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                     md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS digest
              FROM documents))),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0, 1.0, 2.0][((rank - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS room FROM sources),
running AS (
  SELECT *, sum(room) OVER w - room AS rooms, sum(weight) OVER w - weight AS weights, sum(source_size) OVER () * 1.5::DOUBLE AS budget, sum(weight) OVER () AS all_weights
  FROM weighed WINDOW w AS (ORDER BY room / weight, rank)),
wanted AS (
  SELECT source, source_size, least(room, max((budget - rooms) / (all_weights - weights)) OVER () * weight) AS target FROM running),
passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM wanted),
summed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.hash) AS own
  FROM sized s JOIN passes p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (size * (passes + CASE WHEN upto <= rest OR (upto - own < rest AND upto - rest < rest - (upto - own)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
"""


@query
def op4_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex16().alias("fingerprint"), "component_id")


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query
def op5_url_rules(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


ORACLE["op5_url_rules"] = r"""
WITH rules(rule_host, rule_path, action) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rests AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rests),
best AS (
  SELECT p.page_id, p.host, p.path, max_by(struct_pack(rule := r.rule_host || r.rule_path, action := r.action), length(r.rule_host || r.rule_path)) AS best
  FROM (SELECT *, row_number() OVER () AS n FROM parts) p
  LEFT JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
  GROUP BY p.n, p.page_id, p.host, p.path)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM best
"""


@query
def op6_bin_slack(spark, sf_dir):
    packed = packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_VOCABULARY, end=1)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op7_kd_shards(spark, sf_dir):
    placed = kd_shards.shards(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op8_token_files(spark, sf_dir):
    return token_files.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_VOCABULARY, end=2)


@query
def op9_fertility(spark, sf_dir):
    judged = fertility.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), WORD_VOCABULARY, PIECE_VOCABULARY, keep=["doc_id"])
    return judged.select("doc_id", *fertility.BASE, "base_failed", "chars_per_token", "byte_share", "token_entropy", "band_group", "reason", "kept")


@query
def op10_kneser_ney(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~held_out()))
    marked = docs.select("doc_id", "text", held_out().alias("held_out"), F.col("lang").isNotNull().alias("labelled"))
    found = durable(language.predict(marked, model, keep=["doc_id", "held_out", "labelled"]))
    limits = language.calibrate(found.where(~F.col("held_out") & F.col("labelled")))
    return language.accept(found, limits).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "accepted")


@query
def op11_setm(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"), longest=3, least=10, cover=50, top=2000)


ORACLE["op11_setm"] = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
sizes AS (SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang),
places AS (SELECT lang, words, unnest(generate_series(1, len(words))) AS i FROM pieces),
grams AS (SELECT lang, words[i:i + m - 1] AS words, m FROM places, (VALUES (1), (2), (3)) AS t(m) WHERE i + m - 1 <= len(words)),
f AS (SELECT lang, words, m, count(*)::HUGEINT AS f FROM grams GROUP BY lang, words, m HAVING count(*) >= 10),
parts AS (SELECT lang, words, m, f, k, words[1:k] AS one, words[k + 1:m] AS two FROM f, (VALUES (1), (2)) AS t(k) WHERE k < m),
cuts AS (
  SELECT c.lang, c.words, c.m, c.f AS a, x.f AS l, y.f AS r, (1000000 * c.f * c.f) // (x.f * y.f) AS score, k
  FROM parts c JOIN f x ON x.lang = c.lang AND x.words = c.one JOIN f y ON y.lang = c.lang AND y.words = c.two),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
above AS (
  SELECT lang, words, max(f) AS f FROM (SELECT lang, words[1:2] AS words, f FROM f WHERE m = 3 UNION ALL SELECT lang, words[2:3], f FROM f WHERE m = 3) GROUP BY lang, words),
free AS (
  SELECT b.lang, array_to_string(b.words, ' ') AS phrase, b.a, b.l, b.r, b.score
  FROM best b LEFT JOIN above u ON b.m = 2 AND u.lang = b.lang AND u.words = b.words WHERE u.f IS NULL OR 100 * u.f < 50 * b.a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free) JOIN sizes USING (lang) WHERE rank <= 2000
"""


@query
def op12_edit_composition(spark, sf_dir):
    return variants.spellings(table(spark, sf_dir, "documents"), least=3, times=2, damage=97)


ORACLE["op12_edit_composition"] = r"""
WITH crc AS (
  SELECT list(v ORDER BY b) AS t
  FROM (SELECT b, list_reduce(list_prepend(b, [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS v FROM range(256) r(b))),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(x) // 2 + 1), lambda i: ('0x' || x[2 * i - 1:2 * i])::BIGINT)),
                                              lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM counted, crc),
vocabulary AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN run[:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, n FROM hashed) WHERE len(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, unnest(generate_series(1, len(word))) AS i FROM vocabulary),
cut AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM less),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN vocabulary b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN vocabulary b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
judged AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * v.n THEN other END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM vocabulary v LEFT JOIN best USING (word)),
ends AS (
  WITH RECURSIVE chain AS (SELECT word, word AS root, 0 AS steps FROM judged UNION ALL SELECT c.word, j.form, steps + 1 FROM chain c JOIN judged j ON j.word = c.root WHERE j.form IS NOT NULL)
  SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM judged JOIN ends USING (word)
"""


@query
def op13_positional_index(spark, sf_dir):
    return positional.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)


ORACLE["op13_positional_index"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
windows AS (
  SELECT item_id, least(len(words), 10) AS length, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS phrase
  FROM (SELECT *, unnest(generate_series(1, greatest(len(words) - 9, 1))) AS i FROM items WHERE len(words) > 0)),
lengths AS (SELECT DISTINCT length FROM windows),
places AS (SELECT row, words, unnest(generate_series(1, len(words))) AS i FROM docs),
runs AS (SELECT row, i, length, array_to_string(words[i:i + length - 1], ' ') AS phrase FROM places, lengths WHERE i + length - 1 <= len(words)),
found AS (SELECT r.row, r.i, r.length, w.item_id FROM runs r JOIN windows w ON w.length = r.length AND w.phrase = r.phrase),
hit AS (SELECT row, count(DISTINCT word) AS n_hit FROM (SELECT row, unnest(generate_series(i, i + length - 1)) AS word FROM found) GROUP BY row),
named AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM found) GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (row) LEFT JOIN named USING (row)
"""
