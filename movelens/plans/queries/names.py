"""Queries on text, names, entity resolution and landed JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movelens.functions.text import classify_fee, fold, has_text, id_from_path, key_words, norm_name
from movelens.operators import resolve as rs
from movelens.operators.reports import display_names
from movelens.operators.spells import apply_corrections
from movelens.plans.queries.base import Tables, cents, day, query
from movelens.sources.feeds import pivot_leaderboards
from movelens.sources.tables import dedupe, pending_keys, with_backfill


@query("text_classifier", """
WITH x AS (SELECT doc_id, lower(trim(regexp_replace(CASE doc_id % 5 WHEN 0 THEN '<b>Loan</b> of ' || text WHEN 2 THEN '€' || text WHEN 3 THEN 'EUR' || text ELSE text END, '<[^>]+>', '', 'g'))) AS s FROM documents)
SELECT doc_id, CASE WHEN contains(s, 'loan') THEN 'loan' WHEN s = 'free transfer' THEN 'free' WHEN starts_with(s, '€') OR starts_with(s, 'eur') THEN 'paid' ELSE 'unknown' END AS kind FROM x""")
def text_classifier(t: Tables) -> DataFrame:
    """Fee texts made from whole documents, some behind words that rules look for."""
    r = F.col("doc_id") % 5
    text = (
        F.when(r == 0, F.concat(F.lit("<b>Loan</b> of "), F.col("text")))
        .when(r == 2, F.concat(F.lit("€"), F.col("text"))).when(r == 3, F.concat(F.lit("EUR"), F.col("text"))).otherwise(F.col("text"))
    )
    return t.documents.select("doc_id", classify_fee(text).alias("kind"))


@query("id_from_path", "SELECT page_id, CAST(nullif(regexp_extract(url, '/en/([0-9]+)', 1), '') AS BIGINT) AS id FROM pages")
def path_ids(t: Tables) -> DataFrame:
    return t.pages.select("page_id", id_from_path(F.col("url"), "en").alias("id"))


@query("accent_fold_search", """SELECT doc_id, lang, contains(lower(strip_accents(text)), 'ete') AS found, length(lower(strip_accents(text))) AS n,
  md5(lower(strip_accents(text))) AS digest FROM documents""")
def accent_fold_search(t: Tables) -> DataFrame:
    """Whole texts folded; the digest covers every character."""
    return t.documents.select(
        "doc_id", "lang", has_text(F.col("text"), "Été").alias("found"),
        F.length(fold(F.col("text"))).cast("long").alias("n"), F.md5(fold(F.col("text"))).alias("digest"),
    )


@query("name_key", """
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(replace(text, 'ß', 'ss')), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM documents""")
def name_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(norm_name(F.col("text"))).alias("digest"))


SPELLINGS_SQL = """
m AS (SELECT unnest([p_name || ' FC', 'FC ' || p_name, upper(p_name), p_name || CASE WHEN p_size > 25 THEN ' Club' ELSE '' END]) AS name FROM part),
c AS (SELECT name, count(*) AS n, array_to_string(list_filter(string_split(lower(name), ' '), lambda w: w NOT IN ('fc', 'club')), ' ') AS k FROM m GROUP BY 1),
b AS (SELECT k, arg_max(name, (length(name), n, name)) AS canonical FROM c GROUP BY 1 HAVING count(*) >= 2)"""


def spellings(t: Tables) -> DataFrame:
    """Four spellings per part name, some with legal-entity words."""
    p = F.col("p_name")
    return t.part.select(F.explode(F.array(
        F.concat(p, F.lit(" FC")), F.concat(F.lit("FC "), p), F.upper(p),
        F.concat(p, F.when(F.col("p_size") > 25, " Club").otherwise("")),
    )).alias("name"))


@query("alias_canonical", f"WITH {SPELLINGS_SQL} SELECT name, canonical FROM c JOIN b USING (k)")
def alias_canonical(t: Tables) -> DataFrame:
    return rs.build_aliases(spellings(t), "name")


@query("canonical_mentions", f"WITH {SPELLINGS_SQL} SELECT coalesce(canonical, m.name) AS name, count(*) AS mentions FROM m LEFT JOIN c USING (name) LEFT JOIN b USING (k) GROUP BY 1")
def canonical_mentions(t: Tables) -> DataFrame:
    """Every mention rewritten to its canonical spelling, then counted."""
    s = spellings(t)
    return rs.canonicalise(s, ["name"], rs.build_aliases(s, "name")).groupBy("name").agg(F.count(F.lit(1)).alias("mentions"))


@query("ambiguous_words", """
WITH w AS (SELECT p_brand AS league, p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT league, word FROM w WHERE length(word) >= 4 GROUP BY 1, 2 HAVING count(DISTINCT p_partkey) > 1""")
def ambiguous_words(t: Tables) -> DataFrame:
    return rs.ambiguous_words(t.part, "p_brand", "p_partkey", norm_name(F.col("p_name")))


@query("token_overlap", """
WITH p AS (SELECT p_partkey, p_brand, string_split(p_name, ' ') AS w FROM part),
f AS (SELECT p_brand, arg_min(w, p_partkey) AS fw FROM p GROUP BY 1)
SELECT p_partkey, len(list_intersect(w, fw)) AS shared, len(list_filter(w, lambda x: NOT list_contains(fw, x))) = 0 OR len(list_filter(fw, lambda x: NOT list_contains(w, x))) = 0 AS contained FROM p JOIN f USING (p_brand)""")
def token_overlap(t: Tables) -> DataFrame:
    """Each name's words against those of its brand's first part."""
    p = t.part.select("p_partkey", "p_brand", F.split("p_name", " ").alias("w"))
    first = p.groupBy("p_brand").agg(F.min_by("w", "p_partkey").alias("fw"))
    shared, contained = rs.token_overlap(F.col("w"), F.col("fw"))
    return p.join(first, "p_brand").select("p_partkey", F.size(shared).cast("long").alias("shared"), contained.alias("contained"))


@query("label_disambiguation", """SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name || p_size) > 1 THEN p_name || p_size || ' (' || p_brand || ')' ELSE p_name || p_size END AS display_name FROM part""")
def label_disambiguation(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", F.concat("p_name", "p_size").alias("name"), "p_brand")
    return display_names(p, "p_partkey", "name", "p_brand").select("p_partkey", "display_name")


# Lookups: even parts ask for their own name, odd ones for its last word, in
# their own season and the one before, at a "club" that is their type.
LOOKUP_SQL = """
lk AS (SELECT p_partkey, p_brand AS league, season, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE string_split(p_name, ' ')[-1] END AS name, lower(p_type) AS club
  FROM part, LATERAL (SELECT unnest([p_size, p_size - 1]) AS season)),
bd AS (SELECT p_brand AS league, p_size AS season, p_name AS name, lower(p_type) AS team, min(p_partkey) AS id FROM part GROUP BY 1, 2, 3, 4),
ex AS (SELECT lk.p_partkey, lk.season, bd.id, lk.club = bd.team AS same FROM lk JOIN bd USING (league, season, name)),
hit AS (SELECT p_partkey, arg_min(id, (-season, id)) AS provider_id FROM ex WHERE same GROUP BY 1)"""


def lookups(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", F.col("p_brand").alias("league"), F.explode(F.array(F.col("p_size"), F.col("p_size") - 1)).alias("season"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.element_at(F.split("p_name", " "), -1)).alias("name"),
        F.col("p_type").alias("club"),
    )


def board(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_brand").alias("league"), F.col("p_size").alias("season"), F.col("p_partkey").alias("provider_id"),
        F.col("p_name").alias("provider_name"), F.col("p_type").alias("team"),
    )


def clubs(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_brand").alias("league"), F.col("p_partkey").alias("club_id"), F.col("p_type").alias("name"))


@query("exact_resolution", f"WITH {LOOKUP_SQL} SELECT p_partkey, provider_id FROM hit")
def exact_resolution(t: Tables) -> DataFrame:
    return rs.resolve(lookups(t), board(t), clubs(t), ["p_partkey"], fuzzy=False).select("p_partkey", "provider_id")


@query("exact_then_fuzzy_resolution", f"""WITH {LOOKUP_SQL},
open AS (SELECT * FROM lk WHERE p_partkey NOT IN (SELECT p_partkey FROM ex)),
nm AS (SELECT DISTINCT o.league, o.season, o.name, b.name AS found, 2.0 * length(o.name) / (length(o.name) + length(b.name)) AS ratio
  FROM open o JOIN bd b ON b.league = o.league AND b.season = o.season AND list_contains(string_split(b.name, ' '), o.name)
  WHERE 2.0 * length(o.name) / (length(o.name) + length(b.name)) >= 0.6),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY league, season, name ORDER BY ratio DESC, found DESC) AS rn FROM nm) WHERE rn <= 3),
fz AS (SELECT o.p_partkey, arg_min(b.id, (-o.season, b.id)) AS provider_id FROM open o JOIN top USING (league, season, name)
  JOIN bd b ON b.league = o.league AND b.season = o.season AND b.name = top.found AND b.team = o.club GROUP BY 1)
SELECT p_partkey, provider_id, 'exact' AS how FROM hit UNION ALL SELECT p_partkey, provider_id, 'fuzzy' FROM fz""")
def exact_then_fuzzy_resolution(t: Tables) -> DataFrame:
    return rs.resolve(lookups(t), board(t), clubs(t), ["p_partkey"])


@query("key_words", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(p_name, ' '), lambda w: length(w) >= 4))), ' ') AS words FROM part")
def identifying_words(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(F.array_sort(key_words(norm_name(F.col("p_name")))), " ").alias("words"))


# ---------------------------------------------------------------- sources


@query("leaderboard_pivot", """
WITH r AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type, max(CAST(round(value * 100) AS BIGINT)) AS v FROM events GROUP BY 1, 2, 3)
SELECT user_id, strftime(d, '%Y-%m-%d') AS d, max(CASE WHEN event_type = 'click' THEN v END) AS click, max(CASE WHEN event_type = 'view' THEN v END) AS view,
  max(CASE WHEN event_type = 'purchase' THEN v END) AS purchase FROM r GROUP BY 1, 2""")
def leaderboard_pivot(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", day("ts").alias("d"), "event_type", cents("value").alias("v"))
    return pivot_leaderboards(rows, ["user_id", "d"], "event_type", "v", ["click", "view", "purchase"])


@query("json_flatten", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || ',"user":' || user_id || '}' AS doc FROM events""")
def json_flatten(t: Tables) -> DataFrame:
    """Nested properties to columns, and columns back to a document."""
    parsed = t.events.withColumn("p", F.from_json("props", "k long"))
    return parsed.select(
        "event_id", F.col("p.k").alias("k"), F.to_json(F.struct(F.col("p.k").alias("k"), F.col("user_id").alias("user"))).alias("doc")
    )


@query("guarded_correction", """
WITH fixes AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'X' END AS wrong, 'Z' AS right_ FROM orders WHERE o_totalprice > 400000)
SELECT o_orderkey, CASE WHEN o_orderstatus = wrong THEN right_ ELSE o_orderstatus END AS o_orderstatus FROM orders LEFT JOIN fixes ON k = o_orderkey""")
def guarded_correction(t: Tables) -> DataFrame:
    """Corrections for expensive orders; two thirds name a value the row no longer has."""
    fixes = t.orders.filter(F.col("o_totalprice") > 400_000).select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise("X").alias("wrong"), F.lit("Z").alias("right"),
    )
    return apply_corrections(t.orders.select("o_orderkey", "o_orderstatus"), fixes, "o_orderkey", "o_orderstatus", "wrong", "right")


@query("dedupe_keep_first", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""")
def dedupe_keep_first(t: Tables) -> DataFrame:
    """Lines that share order and number: the earliest shipped one stays."""
    item = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    return dedupe(item, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"]).drop("l_shipdate")


@query("pending_keys", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)")
def pending(t: Tables) -> DataFrame:
    return pending_keys(t.orders, t.events.select(F.col("user_id").alias("o_custkey")), ["o_custkey"])


@query("backfill_union", """
SELECT o_orderkey AS id, o_custkey AS subject, CAST(round(o_totalprice * 100) AS BIGINT) AS fee FROM orders
UNION ALL SELECT -event_id - 1, user_id, CAST(round(value * 100) AS BIGINT) FROM events WHERE event_type = 'purchase'""")
def backfill_union(t: Tables) -> DataFrame:
    feed = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), cents("o_totalprice").alias("fee"))
    extra = t.events.filter(F.col("event_type") == "purchase").select(
        (-F.col("event_id") - 1).alias("id"), F.col("user_id").alias("subject"), cents("value").alias("fee"), "props"
    )
    return with_backfill(feed, extra)
