"""Benchmark decontamination by windows of normalised words, in DataFrame functions only.

A benchmark item is cut into windows of consecutive words (an item with fewer
words is one window). Every position of every document is looked up, first by
its word and then by the hash of the window that begins there, in hash sets of
the benchmark's windows; a document with a hit is then searched again by the
windows' words themselves, which also gives the items and the words that are hit.

The sets are part of the plan and so are sent to all executors; up to
``MAX_SET`` windows. A larger benchmark is looked up by a join on the hash.

Defined results: null and empty texts have no words and are never hit; items
without words hit nothing; equal windows of several items count for each;
repeated rows are judged alike; a null id is an id of its own; an empty table of
documents gives an empty result, an empty benchmark hits nothing; only the named
columns matter, and other columns stay where documents are returned, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movelens.llm.text_ids import free_name, row_key, whole_text
from movelens.sources.staging import stage

#: Windows in the hash sets at most (about 50 bytes each), and keys of hit documents that are broadcast at most (16 bytes each).
MAX_SET, BROADCAST_KEYS = 100_000, 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What parts words, in lower-cased and in original texts.
GAP, GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _split(text: Column, gap: str = GAP) -> Column:
    return F.array_remove(F.split(text, gap), "")


def exact_words(text: Column) -> Column:
    """Words of a text in which only A-Z are lower-cased."""
    return _split(F.translate(text, _UPPER, _LOWER))


def rough_words(text: Column) -> Column:
    """As many words as ``exact_words``, cheaper; equal wherever those are equal.

    Each word is lowered by itself: what stands around a word (as with a capital
    sigma, whose small form depends on it) must not change it.
    """
    return F.transform(_split(text, GAP_ANY_CASE), F.lower)


def benchmark_windows(benchmark: DataFrame, item: str, text: str, width: int) -> DataFrame:
    """item_id, n (words of the window), gram (its words) and h (hash of its roughly normalised words)."""
    b = benchmark.select(F.col(item).cast("string").alias("item_id"), exact_words(whole_text(text)).alias("w"), rough_words(whole_text(text)).alias("r"))
    size = F.size("w")
    n = F.least(size, F.lit(width))
    starts = F.when(size > 0, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
    each = b.withColumns({"n": n, "i": F.explode(starts)})
    rough = F.slice("r", F.col("i"), F.col("n"))
    return each.select(
        "item_id", "n", F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("gram"),
        F.element_at(rough, 1).alias("head"), F.xxhash64(rough).alias("h"),
    ).distinct()


def _one_of(column: str, values: Sequence[object]) -> str:
    """SQL text of a membership test; Spark turns it into a hash set."""
    return f"{column} IN ({', '.join(map(str, values))})" if values else "false"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _lengths(windows: DataFrame) -> list[int]:
    """Words of the windows: at most as many numbers as a window has words."""
    return [r.n for r in windows.select("n").distinct().orderBy("n").collect()] or [1]


def _first_look(docs: DataFrame, key: str, text: str, windows: DataFrame) -> DataFrame:
    """Per row: id, row key, n_words and whether any window's hash occurs."""
    base = docs.select(F.col(key).alias("id"), row_key(key, text).alias("rk"), whole_text(text).alias("t"))
    words = F.array(rough_words(F.col("t"))).alias("_one")
    if windows.count() <= MAX_SET:
        sets: dict[int, list] = {}
        for r in windows.select("n", "head", "h").distinct().collect():
            sets.setdefault(r.n, []).append(r)
        tests = [
            f"(size(ws) >= {n} AND exists(sequence(1, size(ws) - {n - 1}), i -> "
            f"{_one_of('element_at(ws, i)', sorted({_quoted(r.head) for r in rows}))} AND "
            f"{_one_of(f'xxhash64(slice(ws, i, {n}))', sorted({f'{r.h}L' if r.h > -(1 << 63) else 'bigint(-9223372036854775808)' for r in rows}))}))"
            for n, rows in sorted(sets.items())
        ]
        look = F.expr(f"element_at(transform(_one, ws -> struct(size(ws) AS n_words, {' OR '.join(tests) or 'false'} AS maybe)), 1)")
        return base.select("id", "rk", words).select("id", "rk", look.alias("x")).select("id", "rk", "x.n_words", "x.maybe")
    # a set of this size is joined on the hash instead
    lengths = _lengths(windows)
    every = "flatten(array(" + ", ".join(
        f"CASE WHEN size(ws) >= {n} THEN transform(sequence(1, size(ws) - {n - 1}), i -> struct({n} AS n, xxhash64(slice(ws, i, {n})) AS h)) ELSE array() END"
        for n in lengths) + "))"
    counted = base.select("id", "rk", words).select("id", "rk", F.expr("size(element_at(_one, 1))").alias("n_words"))
    looked = base.select("rk", words).select("rk", F.explode(F.expr(f"element_at(transform(_one, ws -> {every}), 1)")).alias("x"))
    hit = looked.select("rk", "x.n", "x.h").join(windows.select("n", "h").distinct(), ["n", "h"], "left_semi").select("rk").distinct()
    return counted.join(hit.withColumn("maybe", F.lit(True)), "rk", "left").withColumn("maybe", F.coalesce("maybe", F.lit(False)))


def _hits(docs: DataFrame, key: str, text: str, keys: DataFrame, windows: DataFrame) -> DataFrame:
    """Per row key: the positions of hit words, from 1, and the items; by the windows' words."""
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    lengths = _lengths(windows)
    base = docs.select(row_key(key, text).alias("rk"), whole_text(text).alias("t")).join(keys, "rk", "left_semi")
    every = "flatten(array(" + ", ".join(
        f"CASE WHEN size(ws) >= {n} THEN transform(sequence(1, size(ws) - {n - 1}), i -> struct(i AS i, {n} AS n, array_join(slice(ws, i, {n}), ' ') AS gram)) "
        "ELSE array() END" for n in lengths) + "))"
    each = base.select("rk", F.array(exact_words(F.col("t"))).alias("_one")).select(
        "rk", F.explode(F.expr(f"element_at(transform(_one, ws -> {every}), 1)")).alias("x")).select("rk", "x.*")
    # one row per window, whatever number of items has it
    grams = windows.groupBy("gram").agg(F.collect_set("item_id").alias("items"))
    found = each.join(F.broadcast(grams) if windows.count() <= MAX_SET else grams, "gram")
    return found.groupBy("rk").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.expr("sequence(i, i + n - 1)"))))).alias("hit"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def contamination(
    docs: DataFrame, key: str, text: str, benchmark: DataFrame, item: str = "item_id", item_text: str = "text", width: int = 10,
) -> DataFrame:
    """One row per row of ``docs``: id, rk, n_words, hit (positions of hit words from 1), items (ids as sorted strings)."""
    windows = stage(benchmark_windows(benchmark, item, item_text, width), "windows")
    seen = stage(_first_look(docs, key, text, windows), "first-look")
    keys = seen.filter("maybe").select("rk").distinct()
    hits = stage(_hits(docs, key, text, keys, windows), "hits")
    out = seen.join(hits, "rk", "left")
    return out.select(
        "id", "rk", "n_words", F.coalesce("hit", F.array().cast("array<int>")).alias("hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination_report(docs: DataFrame, key: str, text: str, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Counts and digests per row."""
    found = contamination(docs, key, text, benchmark, width=width)
    return found.select(
        F.col("id").alias(key), F.col("n_words").cast("long").alias("n_words"), F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"))


def _without(text: Column, hit: Column) -> Column:
    """The text without its hit words and what follows each of them up to the next word."""
    parts = F.array(F.struct(_split(text, GAP_ANY_CASE).alias("w"), F.split(text, WORD_ANY_CASE).alias("g"), hit.alias("hit")))
    rest = F.transform(parts, lambda p: F.concat(
        F.element_at(p["g"], 1),
        F.array_join(F.transform(
            F.array_except(F.sequence(F.lit(1), F.size(p["w"])), p["hit"]),
            lambda i: F.concat(F.element_at(p["w"], i), F.element_at(p["g"], i + 1))), "")))
    return F.element_at(rest, 1)


def decontaminate(
    docs: DataFrame, key: str, text: str, benchmark: DataFrame, width: int = 10, remove: str = "documents",
) -> DataFrame:
    """The rows of ``docs`` without contaminated documents, or (``remove="spans"``) without the hit words.

    A text from which spans were removed keeps all else as it is.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be documents or spans")
    found = contamination(docs, key, text, benchmark, width=width).filter(F.size("hit") > 0)
    name = free_name(docs, "rk")
    bad = found.select(F.col("rk").alias(name), F.col("hit").alias(f"{name}_hit")).dropDuplicates([name])
    keyed = docs.withColumn(name, row_key(key, text))
    if remove == "documents":
        return keyed.join(bad.select(name), name, "left_anti").select(*docs.columns)
    joined = keyed.join(bad, name, "left")
    cut = F.when(F.col(f"{name}_hit").isNotNull(), _without(F.col(text), F.col(f"{name}_hit"))).otherwise(F.col(text))
    return joined.withColumn(text, cut).select(*docs.columns)
