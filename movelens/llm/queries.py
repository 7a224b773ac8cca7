"""The registered queries of this folder: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movelens.llm import (
    bpe,
    conversation_repair,
    decontaminate,
    grace_dedup,
    hard_negatives,
    host_reputation,
    html_region,
    jaccard_join,
    line_dedup,
    quality_ranker,
    secret_scan,
    sharding,
    vector_range_join,
)

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[fn.__name__] = fn
    return fn


# The rules that url judgements start from.
URL_RULES = (
    host_reputation.Rule("allow", "org", "/"),
    host_reputation.Rule("block", "example.org", "/es/"),
    host_reputation.Rule("block", "example.org", "/en/1"),
    host_reputation.Rule("allow", "com", "/fr/"),
    host_reputation.Rule("block", "com", "/de/"),
)


@_query
def op1_bradley_terry(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document, learned from the labelled ones outside the held-out fold."""
    held_out = quality_ranker.in_fold(F.col("doc_id"), 5, 0)
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    out = quality_ranker.scored(docs, "doc_id", "text", _table(spark, folder, "labels"), "quality", ~held_out)
    predicted = (F.col("score") >= quality_ranker.CUT).cast("int")
    return out.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


@_query
def op2_markov_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document: fixed patterns, and long tokens that read as random strings."""
    return secret_scan.scan_report(_table(spark, folder, "documents"), "doc_id", "text")


@_query
def op3_html_region(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    out = html_region.extract(_table(spark, folder, "pages").select("page_id", "url", "html"), "html")
    return out.select("page_id", "url", "text").withColumn("n_chars", F.length("text").cast("long"))


@_query
def op4_shingle_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose sets of 4-word shingles are similar by 85 hundredths or more."""
    return jaccard_join.near_duplicate_groups(_table(spark, folder, "documents"), "doc_id", "text", 4, 85, 100)


SQL["op4_shingle_groups"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.m)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""


@_query
def op5_vector_range_join(spark: SparkSession, folder: str) -> DataFrame:
    """Links of every vector by a cosine of 0.93 or more within its label, and its group."""
    return vector_range_join.range_join(_table(spark, folder, "embeddings"), "vec_id", "embedding", "label", 0.93)


SQL["op5_vector_range_join"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id, vec_id AS m FROM embeddings UNION SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.m),
c AS (SELECT vec_id, min(m) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a)
SELECT c.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON n.vec_id = c.vec_id
"""


@_query
def op6_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts and digests of every document's encoding and of the text decoded from it."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encoding_digests(_table(spark, folder, "documents"), "doc_id", "text", path)


@_query
def op7_benchmark_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in a 10-word window of a benchmark item."""
    docs, benchmark = _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    return decontaminate.contamination_report(docs, "doc_id", "text", benchmark)


SQL["op7_benchmark_windows"] = r"""
WITH b AS (
  SELECT item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id::VARCHAR AS item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.g = dw.g),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(len(t.items), 0) AS n_items,
  sha256(coalesce(array_to_string(t.items, ','), '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


@_query
def op8_host_reputation(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's verdict: the longest rule that fits, else its host's posterior bad rate."""
    pages = _table(spark, folder, "pages").select("page_id", "url")
    judged = host_reputation.judge_urls(pages, "url", URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


SQL["op8_host_reputation"] = r"""
WITH p0 AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(verdict, h, pre) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
hp AS (SELECT DISTINCT host, path FROM p0),
ruled AS (
  SELECT host, path, arg_max(h || pre, length(h || pre)) AS rule, arg_max(verdict, length(h || pre)) AS ruled
  FROM hp JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY host, path),
p AS (
  SELECT p0.*, rule, ruled, string_split(p0.host, '.')[-1] AS suffix, array_to_string(string_split(p0.host, '.')[-2:], '.') AS domain
  FROM p0 LEFT JOIN ruled ON ruled.host = p0.host AND ruled.path = p0.path),
o AS (
  SELECT host, any_value(suffix) AS suffix, any_value(domain) AS domain, count(*) AS n, sum(CASE WHEN ruled = 'block' THEN 1 ELSE 0 END) AS bad
  FROM p WHERE ruled IS NOT NULL GROUP BY host),
t AS (SELECT coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad FROM o),
l0 AS (SELECT (bad + 1.0::DOUBLE) AS a, (n - bad + 1.0::DOUBLE) AS b FROM t),
g1 AS (SELECT suffix AS name, sum(n) AS n, sum(bad) AS bad, (SELECT a / (a + b) FROM l0) AS prior FROM o GROUP BY suffix),
k1 AS (SELECT CASE WHEN count(*) = 0 OR sum(n - 1) = 0 THEN 2 ELSE (CASE WHEN sum(n * power(bad / n - m, 2) / (m * (1 - m))) - count(*) > 0
    THEN least(1000, greatest(2, sum(n - 1) / (sum(n * power(bad / n - m, 2) / (m * (1 - m))) - count(*)) - 1)) ELSE 1000 END) END AS k
  FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, prior)) AS m FROM g1)),
l1 AS (SELECT name, bad + prior * k AS a, n - bad + (1 - prior) * k AS b FROM g1, k1),
g2 AS (SELECT o.domain AS name, sum(n) AS n, sum(bad) AS bad, any_value(l1.a / (l1.a + l1.b)) AS prior
  FROM o JOIN l1 ON l1.name = o.suffix GROUP BY o.domain),
k2 AS (SELECT CASE WHEN count(*) = 0 OR sum(n - 1) = 0 THEN 2 ELSE (CASE WHEN sum(n * power(bad / n - m, 2) / (m * (1 - m))) - count(*) > 0
    THEN least(1000, greatest(2, sum(n - 1) / (sum(n * power(bad / n - m, 2) / (m * (1 - m))) - count(*)) - 1)) ELSE 1000 END) END AS k
  FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, prior)) AS m FROM g2)),
l2 AS (SELECT name, bad + prior * k AS a, n - bad + (1 - prior) * k AS b FROM g2, k2),
g3 AS (SELECT o.host AS name, n, bad, l2.a / (l2.a + l2.b) AS prior FROM o JOIN l2 ON l2.name = o.domain),
k3 AS (SELECT CASE WHEN count(*) = 0 OR sum(n - 1) = 0 THEN 2 ELSE (CASE WHEN sum(n * power(bad / n - m, 2) / (m * (1 - m))) - count(*) > 0
    THEN least(1000, greatest(2, sum(n - 1) / (sum(n * power(bad / n - m, 2) / (m * (1 - m))) - count(*)) - 1)) ELSE 1000 END) END AS k
  FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, prior)) AS m FROM g3)),
l3 AS (SELECT name, bad + prior * k AS a, n - bad + (1 - prior) * k AS b FROM g3, k3),
j AS (
  SELECT p.page_id, p.host, p.path, p.rule, p.ruled, coalesce(l3.a, l2.a, l1.a, l0.a) AS a, coalesce(l3.b, l2.b, l1.b, l0.b) AS b
  FROM p CROSS JOIN l0 LEFT JOIN l1 ON l1.name = p.suffix LEFT JOIN l2 ON l2.name = p.domain LEFT JOIN l3 ON l3.name = p.host)
SELECT page_id, host, path, rule, coalesce(ruled,
  CASE WHEN a / (a + b) - 1.645 * sqrt(a * b / (power(a + b, 2) * (a + b + 1))) > 0.75 THEN 'block' ELSE 'allow' END) AS verdict
FROM j
"""


@_query
def op9_line_edit_join(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every document that repeat an earlier one, exactly or within two edits."""
    return line_dedup.dedup_report(_table(spark, folder, "documents"), "doc_id", "text")


@_query
def op10_jump_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's shard of eight, its slot there, and its shard if one is added."""
    return sharding.shard_manifest(_table(spark, folder, "documents"), "doc_id", "text", 8)


@_query
def op12_multi_index_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector, for each of its five best positives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, folder, "embeddings"), "vec_id", "embedding", label, F.col("vec_id") % 100 == 0)


SQL["op12_multi_index_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@_query
def op13_grace_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents with equal texts (A-Z in lower case); of each the largest id stays."""
    return grace_dedup.exact_groups(_table(spark, folder, "documents"), "doc_id", "text")


SQL["op13_grace_dedup"] = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM t
"""


def _damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with rows dropped (``gone``), emptied, cut, repeated or given the role user, by the checksum of id and turn."""
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.pmod(F.crc32(place.cast("binary")), F.lit(20))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"), F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    )


@_query
def op11_audit_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of every damaged conversation, and the cheapest edits that repair its structure."""
    rows = _damaged(_table(spark, folder, "conversations"))
    return conversation_repair.repair_report(rows, "conv_id", "turn", "role", "text", F.col("gone"))


SQL["op11_audit_repair"] = r"""
WITH RECURSIVE tbl AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
crc AS (
  SELECT src.*, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(place) + 1), lambda i: ascii(place[i])::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM src, tbl),
dam AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM crc WHERE kind <> 0),
num AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    left(role, 1) AS c, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM dam),
rows0 AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS c0 FROM num),
flagged AS (
  SELECT conv_id, turn, role, text, i, c, c0, shown = '' AS blank, shown <> '' AND again AS dup,
    shown <> '' AND NOT again AND right(shown, 1) NOT IN ('.', '!', '?') AS cut FROM rows0),
ins(s0, s1, n, lines) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 1, chr(10) || 'user:'),
  (0, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 2, 1, chr(10) || 'user:'), (1, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 3, 1, chr(10) || 'assistant:'), (3, 2, 1, chr(10) || 'user:')),
ops(s1, letter, c, s2) AS (VALUES (0, 'D', NULL, 0), (1, 'D', NULL, 1), (2, 'D', NULL, 2), (3, 'D', NULL, 3), (0, 'K', 's', 1), (0, 'K', 'u', 2),
  (1, 'K', 'u', 2), (3, 'K', 'u', 2), (2, 'K', 'a', 3), (0, 'R', NULL, 2), (1, 'R', NULL, 2), (3, 'R', NULL, 2), (2, 'R', NULL, 3)),
moves AS (SELECT s0, n, lines, letter, c, s2 FROM ins JOIN ops ON ops.s1 = ins.s1),
ids AS (SELECT DISTINCT conv_id FROM conversations),
total AS (SELECT conv_id, max(i) AS m FROM flagged GROUP BY conv_id),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS s, lpad('0', 12, '0') AS best, '' AS said FROM ids
  UNION ALL
  SELECT conv_id, i, s, min(k) AS best, arg_min(said, k) AS said FROM (
    SELECT f.conv_id, f.i, m.s2 AS s,
      lpad((dp.best[:12]::BIGINT + 3 * m.n + CASE m.letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN f.cut AND m.letter <> 'D' THEN 3 ELSE 0 END)::VARCHAR, 12, '0')
        || dp.best[13:] || repeat('I', m.n) || m.letter AS k,
      dp.said || m.lines || CASE m.letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text
        ELSE chr(10) || CASE m.s2 WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text END AS said
    FROM dp JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1
    JOIN moves m ON m.s0 = dp.s AND (m.letter = 'D' OR (NOT f.blank AND NOT f.dup AND (m.letter = 'R' OR m.c = f.c))))
  GROUP BY conv_id, i, s),
fin AS (
  SELECT conv_id, min(k) AS k, arg_min(said, k) AS said FROM (
    SELECT dp.conv_id, lpad((best[:12]::BIGINT + 3 * n)::VARCHAR, 12, '0') || best[13:] || repeat('I', n) AS k, said || lines AS said
    FROM dp JOIN ins ON ins.s0 = dp.s AND ins.s1 IN (0, 3) LEFT JOIN total t ON t.conv_id IS NOT DISTINCT FROM dp.conv_id
    WHERE dp.i = coalesce(t.m, 0)) GROUP BY conv_id),
cnt AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(dup::INT) AS duplicate,
    sum(cut::INT) AS truncated, sum((c0 IS NOT NULL AND c0 || c NOT IN ('su', 'ua', 'au'))::INT) AS illegal FROM flagged GROUP BY conv_id)
SELECT fin.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, k[:12]::BIGINT AS cost, k[13:] AS audit,
  sha256(said[2:]) AS repaired_sha256
FROM fin LEFT JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM fin.conv_id
"""
