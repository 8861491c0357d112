"""The registered queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, collocations, hamming, langid, minhash, mixing, neighbours, packing, passages, quality, suffixes, toxicity, urls
from .common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


#: Host and path rules of the URL query.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.nearest_codes(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


#: Sign codes against sign codes, for every row whose id is divisible by 20.
OP4_SQL = """
WITH fine AS (
  SELECT DISTINCT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), codes AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS code FROM fine),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    len(list_filter(range(1, len(q.code) + 1), lambda i: q.code[i] <> c.code[i])) AS distance
  FROM codes q JOIN codes c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs
)
SELECT query_id, rank::INTEGER AS rank, vec_id, distance::INTEGER AS distance FROM ranked WHERE rank <= 10
"""


#: Every window of 20 words, the first of equal ones, and what no later one covers.
OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT doc_id, i, array_to_string(l[i:i + 19], ' ') AS k FROM w, unnest(range(1, len(l) - 18)) AS t(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM s) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM r, unnest(range(0, 20)) AS u(j)),
u AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM u ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(l)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = passages.strip_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.take(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Documents by part, mask and labels; each order's first failing step; and what follows by part, order and step.
OP11_SQL = r"""
WITH ids AS (SELECT coalesce(text, '') AS text, min(doc_id) AS first FROM documents GROUP BY 1),
marks AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY 1),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(m.toxic, 0) AS toxic, [
    len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(d.text, '[A-Z]')) > 3 * length(d.text),
    regexp_matches(d.text, '[#$%&*|]'), coalesce(d.doc_id > first, false)] AS f
  FROM d JOIN ids ON d.text = ids.text LEFT JOIN marks m ON d.doc_id = m.doc_id),
cells AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY 1, 2),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, s::INTEGER AS s, instr('ABCDE', substr(o, s, 1)) AS i FROM orders, range(1, 6) AS r(s)),
hit AS (
  SELECT part, o, coalesce(list_position(list_transform(string_split(o, ''), lambda x: f[instr('ABCDE', x)]), true), 6) AS first, f, n, good, toxic
  FROM cells, orders),
out AS (
  SELECT part, o AS filter_order, s AS step, i,
    sum(n) FILTER (first > s) AS kept, sum(n) FILTER (first = s) AS removed, sum(n) FILTER (f[i] AND first < s) AS redundant,
    sum(n) FILTER (f[i] AND len(list_filter(f, lambda x: x)) = 1) AS unique_fails, sum(good) FILTER (first = s) AS good_lost, sum(toxic) FILTER (first = s) AS toxic_lost
  FROM hit JOIN steps USING (o) GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, i), 0)::BIGINT AS shapley
FROM out
"""


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: All phrases of one to three words counted, each cut scored with 128-bit numbers.
OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM w, range(1, 4) AS a(k), unnest(range(1, len(w) + 2 - k)) AS b(i) GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, a, j, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM c, unnest(range(1, c.k)) AS t(j)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[j + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS most FROM c, unnest([1, 2]) AS t(i) WHERE k = 3 GROUP BY 1, 2),
left_over AS (SELECT best.* FROM best LEFT JOIN inner_ USING (lang, phrase) WHERE k = 3 OR most IS NULL OR 100 * most < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


#: Every string of 200 bytes, those that start twice, what they cover, and the stretches left over.
OP13_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS row, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT row, i, md5(b[i:i + 199]) AS k FROM d, unnest(range(1, octet_length(b) - 198)) AS t(i)),
twice AS (SELECT row, i FROM s QUALIFY count(*) OVER (PARTITION BY k) > 1),
runs AS (SELECT row, i, i - coalesce(lag(i) OVER (PARTITION BY row ORDER BY i), -1000) > 200 AS new FROM twice),
spans AS (SELECT row, min(i) AS a, max(i) + 200 AS e FROM (SELECT row, i, sum(new::INTEGER) OVER (PARTITION BY row ORDER BY i) AS g FROM runs) GROUP BY row, g),
gaps AS (
  SELECT row, coalesce(lag(e) OVER (PARTITION BY row ORDER BY a), 1) AS p, a AS q FROM spans
  UNION ALL SELECT d.row, coalesce(max(e), 1), octet_length(any_value(b)) + 1 FROM d LEFT JOIN spans ON d.row = spans.row GROUP BY d.row),
kept AS (SELECT row, string_agg(hex(b[p:q - 1]), '' ORDER BY p) AS h FROM gaps JOIN d USING (row) WHERE q > p GROUP BY row),
lost AS (SELECT row, sum(e - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY row)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM d LEFT JOIN lost USING (row) LEFT JOIN kept USING (row)
"""


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.strip_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_url_filter": op2_url_filter,
        "op3_nearest_neighbours": op3_nearest_neighbours,
        "op4_hamming_search": op4_hamming_search,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_mixing": op7_mixing,
        "op8_language_id": op8_language_id,
        "op9_toxicity": op9_toxicity,
        "op10_quality": op10_quality,
        "op11_filter_audit": op11_filter_audit,
        "op12_collocations": op12_collocations,
        "op13_suffix_dedup": op13_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_hamming_search": OP4_SQL,
        "op5_substring_dedup": OP5_SQL,
        "op11_filter_audit": OP11_SQL,
        "op12_collocations": OP12_SQL,
        "op13_suffix_dedup": OP13_SQL,
    }
