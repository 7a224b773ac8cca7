"""Line dedup: exact copies by hash, near copies by a segment-partition edit join.

A line is dropped if an equal line comes earlier, in the order of document id
and line number, or if it has ``MIN_CHARS`` code points or more and another such
line within ``edits`` edits (code points) comes earlier. Exact copies go whatever
their length; only blank lines are never dropped nor compared.

For the join each distinct line of ``MIN_CHARS`` or more is cut into edits + 1 segments. Two lines within
the distance share at least one segment unchanged, at a place that the number of
segments before and after it confines. So each line is entered under its own
segments (with its length) and looked up under the substrings it has where a
segment of a line of the same or a smaller length can lie. All these keys are
hashes from running sums over the characters. A line is dealt out once under each
of its keys, entered or looked up, by half of its hash; lines that share a half
are told apart when pairs are verified. Rows that meet no line are dropped where
they arrive, so only rows that meet are joined. Pairs that meet are verified once
with a bit-parallel edit distance that keeps one word per pair: the diagonals
within the threshold. At a key under which very many lines are entered, pairs
are not made: a task compares two blocks of its lines and returns the lines
with an earlier near copy.

Defined results: null and empty texts have one empty line, which stays; ids that
are null come last; rows that repeat an id and a text are one document, judged
alike; lines end at a line feed; all other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movelens.llm.shingles import mixed, powers
from movelens.llm.text_ids import free_name, released, row_key, small_batches, whole_text
from movelens.sources.staging import free_shuffles, stage, unstage

EDITS, MIN_CHARS = 2, 20
#: Lines entered under a key up to which all pairs meet, and lines of a block beyond that.
FEW_LINES, BLOCK_LINES = 32, 1024
#: Ids of keys and lines that are broadcast at most (16 bytes each).
BROADCAST_IDS = 1_000_000
#: Keys of documents that are broadcast at most (16 bytes each) when candidate lines are fetched.
BROADCAST_KEYS = 1_000_000
#: Characters of lines handled at a time.
PART_CHARS = 1 << 20
_U = np.uint64


def eligible(line: str) -> bool:
    """Whether exact copies of a line are dropped."""
    return bool(line) and not line.isspace()


def compared(line: str) -> bool:
    """Whether a line takes part in the edit join too: it has MIN_CHARS code points, words or not."""
    return len(line) >= MIN_CHARS and eligible(line)


def line_keys(line: str) -> tuple[int, int]:
    """128 bits of hash, as two signed numbers."""
    d = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def segments(length: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of edits + 1 segments of nearly equal size, the larger ones last."""
    parts = edits + 1
    small, more = length // parts, length % parts
    i = np.arange(parts)[:, None]
    size = small + (i >= parts - more)
    start = i * small + np.maximum(0, i - (parts - more))
    return start, size


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift of its place) of all substrings to look up, own places first."""
    own, others = [(0, i, 0) for i in range(edits + 1)], []
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))
            others += [(shorter, i, s) for s in range(low, high + 1) if (shorter, i, s) not in own]
    return own + others


def segment_keys(lines: list[str], edits: int) -> np.ndarray:
    """A row of hashes per line, in the order of ``probes``; 0 where a place does not exist or repeats an earlier key."""
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    power, inverse = powers(len(chars) + 1)
    total = np.zeros(len(chars) + 1, _U)
    np.cumsum((chars.astype(_U) + _U(1)) * power[:len(chars)], out=total[1:])
    base = np.cumsum(length) - length
    plan = probes(edits)
    out = np.zeros((len(lines), len(plan)), _U)
    for k, (shorter, i, shift) in enumerate(plan):
        start, size = (x[i] for x in segments(length - shorter, edits))
        start = start + shift
        fits = (start >= 0) & (start + size <= length) & (size > 0)
        s, e = base + np.where(fits, start, 0), base + np.where(fits, start + size, 0)
        h = (total[e] - total[s]) * inverse[s]
        # the length of the line that is looked for and the segment are part of the key
        tag = ((length - shorter) * 64 + i).astype(_U) * _U(0x9E3779B97F4A7C15)
        out[:, k] = np.where(fits, mixed(h + tag) | _U(1), _U(0))
        for j in range(k):
            out[out[:, k] == out[:, j], k] = 0
    return out


def edit_distance_within(a: list[str], b: list[str], most: int) -> np.ndarray:
    """Whether each pair is within ``most`` edits; all pairs advance together.

    One word per pair holds the vertical differences of the 2 * most + 2
    diagonals around the main one and slides down with it by one row a column
    until it meets the last row, which it then follows to the end. No line may
    be shorter than ``most``.
    """
    n = len(a)
    swap = [len(x) < len(y) for x, y in zip(a, b, strict=True)]
    long = [y if s else x for x, y, s in zip(a, b, swap, strict=True)]
    short = [x if s else y for x, y, s in zip(a, b, swap, strict=True)]
    nl, ns = np.fromiter(map(len, long), np.int64, n), np.fromiter(map(len, short), np.int64, n)
    band = 2 * most + 2
    if band > 63:
        raise ValueError("the threshold is too large for one word")
    width = int(nl.max(initial=0)) + 2 * band + most + 2
    rows = np.zeros((n, width), np.uint32)
    cols = np.zeros((n, max(1, int(ns.max(initial=0)))), np.uint32)
    for i in range(n):
        rows[i, band:band + nl[i]] = np.frombuffer(long[i].encode("utf-32-le", "surrogatepass"), np.uint32) + 1
        cols[i, :ns[i]] = np.frombuffer(short[i].encode("utf-32-le", "surrogatepass"), np.uint32) + 1
    full = _U((1 << band) - 1)
    one = _U(1)
    up = np.full(n, ((1 << band) - 1) & ~((1 << (band - most - 1)) - 1), _U)  # vertical +1
    down = np.zeros(n, _U)  # vertical -1
    score = np.full(n, most, np.int64)
    level = np.full(n, 1 << (band - 2), _U)
    top = _U(1 << (band - 1))
    first = most + 1 - band
    for j in range(int(ns.max(initial=0))):
        same = np.zeros(n, _U)
        for k in range(band):
            same |= (rows[:, band + first + j + k] == cols[:, j]).astype(_U) << _U(k)
        zero = ((((same & up) + up) & full) ^ up) | same | down
        right = down | (full & ~(zero | up))
        left = zero & up
        live = j < ns
        sliding = live & (j < nl - most)
        score += sliding & ((zero & top) == 0)
        flat = live & ~sliding
        score += flat & ((right & level) != 0)
        score -= flat & ((left & level) != 0)
        level = np.where(flat, level >> one, level)
        half = zero >> one
        up = left | (full & ~(half | right))
        down = half & right
    return (score <= most) & (nl - ns <= most)


def _lines(docs: DataFrame, key: str, text: str, edits: int) -> DataFrame:
    """Every line that is not blank: id, rk, no (from 0), k1, k2 and its segment keys (none for a line that is not compared)."""
    id_type = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            long = np.array([compared(x) for x in lines], bool)
            keys = segment_keys([x for x, n in zip(lines, long, strict=True) if n], edits).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(long)]).astype(np.int32) * np.int32(keys.shape[1])
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))
            k = np.array([line_keys(x) for x in lines], np.int64).reshape(-1, 2)
            at = pa.array(rows, pa.int64())
            return pa.RecordBatch.from_arrays([
                batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int32()), pa.array(k[:, 0]), pa.array(k[:, 1]), lists,
            ], names=["id", "rk", "no", "k1", "k2", "segs"])

        for batch in batches:
            rows, numbers, lines, size = [], [], [], 0
            for i, t in enumerate(batch.column(2).to_pylist()):
                for no, line in enumerate(t.split("\n")):
                    if eligible(line):
                        rows.append(i), numbers.append(no), lines.append(line)
                        size += len(line)
                        if size > PART_CHARS:
                            yield packed()
                            rows, numbers, lines, size = [], [], [], 0
            if lines:
                yield packed()

    source = docs.select(F.col(key).alias("id"), row_key(key, text).alias("rk"), whole_text(text).alias("t"))
    return source.mapInArrow(released(cut), f"id {id_type}, rk long, no int, k1 long, k2 long, segs array<long>")


def _line_texts(docs: DataFrame, key: str, text: str, places: DataFrame) -> DataFrame:
    """k1, k2 and text of the lines at ``places`` (rk, no)."""
    asked = places.groupBy("rk").agg(F.collect_set("no").alias("nos"))  # at most the lines of a document
    if asked.count() <= BROADCAST_KEYS:
        asked = F.broadcast(asked)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t, nos in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = t.split("\n")
                found += [lines[n] for n in nos]
            k = np.array([line_keys(x) for x in found], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(found, pa.string())], names=["k1", "k2", "line"])

    source = docs.select(row_key(key, text).alias("rk"), whole_text(text).alias("t")).join(asked, "rk").select("t", "nos")
    return source.mapInArrow(released(pick), "k1 long, k2 long, line string").dropDuplicates(["k1", "k2"])


def _verified(pairs: DataFrame, edits: int) -> DataFrame:
    """The rows of ``pairs`` (with columns la and lb) whose lines are within the distance."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("la", "lb"))
            order = sorted(range(len(a)), key=lambda i: len(a[i]))
            good = np.zeros(len(a), bool)
            at = 0
            while at < len(order):  # pairs of like length together, so that little is padded
                size = max(1, PART_CHARS // (len(a[order[min(len(order), at + 1024) - 1]]) + 64))
                some = order[at:at + min(size, 1024)]
                good[some] = edit_distance_within([a[i] for i in some], [b[i] for i in some], edits)
                at += len(some)
            yield batch.filter(pa.array(good))

    return pairs.mapInArrow(released(check), pairs.schema)


def _small(ids: DataFrame) -> DataFrame:
    """Broadcast if counted to be small, else left to a shuffle join."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _known(docs: DataFrame, key: str, text: str, lines: DataFrame, asked: DataFrame) -> DataFrame:
    """k1, k2, first place and text of the asked lines (k1, k2, or k1 alone for all lines that share it)."""
    asked = stage(asked.distinct(), "asked")
    places = stage(lines.join(_small(asked), asked.columns).groupBy("k1", "k2").agg(_first_place()), "line-places")
    unstage(asked)
    texts = _line_texts(docs, key, text, places.select("f.rk", "f.no"))
    known = stage(places.join(texts, ["k1", "k2"]), "line-texts")
    unstage(places)
    return known


def _first_place() -> Column:
    return F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("no"), F.col("rk"))).alias("f")


def _meeting(keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` (seg, own, k1) whose seg an own row has and another row too.

    Rows with one seg follow each other, own ones first, so that a row is judged by its neighbours.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, good = None, None, False  # an own row that starts its seg; the last seg, and whether an own row starts it
        for batch in batches:
            if not batch.num_rows:
                continue
            seg, own = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            starts = np.concatenate(([last is None or seg[0] != last], seg[1:] != seg[:-1]))
            run = np.cumsum(starts)
            alive = np.concatenate(([good], own[starts]))[run]
            followed = np.concatenate((~starts[1:], [False]))
            if held is not None and not starts[0]:
                yield held
            yield batch.filter(pa.array(alive & (~starts | followed)))
            held = batch.slice(len(seg) - 1) if starts[-1] and own[-1] else None
            last, good = seg[-1], bool(alive[-1])

    return keys.repartition("seg").sortWithinPartitions("seg", F.desc("own")).mapInArrow(released(meet), keys.schema)


def _later_in_blocks(edits: int):
    def later(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["none", "id", "no", "rk"]).reset_index(drop=True)
        one = bool(part["b1"].iloc[0] == part["b2"].iloc[0])
        lines, block = part["line"].tolist(), part["block"].to_numpy()
        length = np.fromiter(map(len, lines), np.int64, len(lines))
        letters = np.array([np.bincount(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) % 32, minlength=32) for x in lines], np.int32)
        found = np.zeros(len(lines), bool)
        waiting: dict[int, list[int]] = {}
        for i in range(1, len(lines)):
            apart = np.abs(letters[:i] - letters[i]).sum(axis=1)  # an edit changes two counts at most
            good = (np.abs(length[:i] - length[i]) <= edits) & (apart <= 2 * edits)
            if not one:  # pairs inside one block belong to that block's own task
                good &= block[:i] != block[i]
            if good.any():
                j = np.flatnonzero(good)
                waiting[i] = j[np.argsort(apart[j], kind="stable")].tolist()
        while waiting:  # the likeliest first; a line that has its earlier copy is done
            pairs = [(i, j) for i, js in waiting.items() for j in js[:4]]
            for at in range(0, len(pairs), 1024):
                some = pairs[at:at + 1024]
                good = edit_distance_within([lines[i] for i, _ in some], [lines[j] for _, j in some], edits)
                found[[i for (i, _), g in zip(some, good, strict=True) if g]] = True
            waiting = {i: js[4:] for i, js in waiting.items() if not found[i] and len(js) > 4}
        return part.loc[found, ["k1", "k2"]]

    return later


def _near(docs: DataFrame, key: str, text: str, lines: DataFrame, firsts: DataFrame, edits: int) -> DataFrame:
    """k1, k2 of the distinct lines with a near copy that comes earlier, written once; all other tables are gone then."""
    own = edits + 1
    # copies count too here, so this only errs towards blocks
    often = lines.select(F.explode(F.slice("segs", 1, own)).alias("seg")).filter("seg != 0").groupBy("seg").agg(F.count(F.lit(1)).alias("c"))
    crowded = stage(often.filter(F.col("c") > FEW_LINES).select("seg"), "crowded")
    free_shuffles(docs.sparkSession)
    keys = firsts.select("k1", F.posexplode("segs").alias("place", "seg")).filter("seg != 0").select("seg", (F.col("place") < own).alias("own"), "k1")
    met = stage(_meeting(keys.join(_small(crowded), "seg", "left_anti")), "met")
    free_shuffles(docs.sparkSession)
    # a line has a key once, so rows that share key and k1 are two lines
    sides = met.groupBy("seg", "k1").agg(F.max("own").alias("own"), F.count(F.lit(1)).alias("c"))
    looked = sides.select("seg", F.col("k1").alias("q1"))
    # one row per pair, whichever way round it met
    pairs = stage(sides.filter("own").join(looked, "seg").filter((F.col("k1") != F.col("q1")) | (F.col("c") > 1)).select(
        F.least("k1", "q1").alias("a1"), F.greatest("k1", "q1").alias("b1")).distinct(), "line-pairs")
    unstage(met)
    known = _known(docs, key, text, lines, pairs.select(F.explode(F.array("a1", "b1")).alias("k1")))
    side = lambda s: known.select(
        F.col("k1").alias(f"{s}1"), F.col("k2").alias(f"{s}2"), F.col("line").alias(f"l{s}"), F.col("f").alias(f"f{s}"))
    both = pairs.join(side("a"), "a1").join(side("b"), "b1").filter((F.col("a1") != F.col("b1")) | (F.col("a2") < F.col("b2")))
    good = _verified(both, edits)
    later = F.col("fa") > F.col("fb")
    out = stage(good.select(
        F.when(later, F.col("a1")).otherwise(F.col("b1")).alias("k1"), F.when(later, F.col("a2")).otherwise(F.col("b2")).alias("k2")), "near-pairs")
    unstage(pairs, known)
    # lines at crowded keys, in pairs of blocks
    crowd = lines.select("k1", "k2", F.explode("segs").alias("seg")).join(_small(crowded), "seg", "left_semi").distinct()
    sizes = crowd.groupBy("seg").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").withColumn("blocks", F.ceil(F.col("c") / F.lit(float(BLOCK_LINES))).cast("int"))
    crowd = stage(crowd.join(sizes.drop("c"), "seg"), "crowd")
    unstage(crowded)
    known = _known(docs, key, text, lines, crowd.select("k1", "k2"))
    texts = known.select("k1", "k2", "line", "f.*")
    dealt = crowd.withColumn("block", F.pmod(F.xxhash64("k1", "k2"), F.col("blocks")).cast("int"))
    tasks = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "seg", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "k1", "k2")
    crowded_out = tasks.join(texts, ["k1", "k2"]).groupBy("seg", "b1", "b2").applyInPandas(_later_in_blocks(edits), "k1 long, k2 long")
    found = stage(out.unionByName(crowded_out).distinct(), "near-lines")
    unstage(out, crowd, known)
    return found


def dropped_lines(docs: DataFrame, key: str, text: str, edits: int = EDITS) -> DataFrame:
    """Per document with lines to drop: rk, exact and near (line numbers from 0, ascending)."""
    small_batches(docs.sparkSession)
    lines = stage(_lines(docs, key, text, edits), "lines")
    joined = lines.filter(F.size("segs") > 0)
    distinct = joined.groupBy("k1", "k2").agg(F.first("segs").alias("segs"))
    found = _near(docs, key, text, joined, distinct, edits)
    near = found.withColumn("near", F.lit(True))
    firsts = lines.groupBy("k1", "k2").agg(_first_place(), F.count(F.lit(1)).alias("c"))
    judged = firsts.join(near, ["k1", "k2"], "left").filter((F.col("c") > 1) | F.col("near"))
    judged = stage(judged.select("k1", "k2", F.col("f.rk").alias("frk"), F.col("f.no").alias("fno"), F.coalesce("near", F.lit(False)).alias("near")), "judged")
    unstage(found)
    copies = lines.select("rk", "no", "k1", "k2").join(judged, ["k1", "k2"])
    again = (F.col("rk") != F.col("frk")) | (F.col("no") != F.col("fno"))
    out = copies.filter(again | F.col("near")).groupBy("rk").agg(
        F.sort_array(F.collect_set(F.when(again, F.col("no")))).alias("exact"),
        F.sort_array(F.collect_set(F.when(~again, F.col("no")))).alias("near"))
    dropped = stage(out, "dropped")
    unstage(lines, judged)
    free_shuffles(docs.sparkSession)
    return dropped


def dedup_report(docs: DataFrame, key: str, text: str, edits: int = EDITS) -> DataFrame:
    """One row per row: id, n_lines, n_exact, n_near and the numbers of the dropped lines."""
    dropped = dropped_lines(docs, key, text, edits)
    t = whole_text(text)
    rows = docs.select(F.col(key), row_key(key, text).alias("rk"), (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    exact, near = F.coalesce("exact", none), F.coalesce("near", none)
    return rows.join(dropped, "rk", "left").select(
        key, "n_lines", F.size(exact).cast("long").alias("n_exact"), F.size(near).cast("long").alias("n_near"),
        F.array_sort(F.concat(exact, near)).alias("dropped"))


def without_repeated_lines(docs: DataFrame, key: str, text: str, edits: int = EDITS) -> DataFrame:
    """``docs`` with the dropped lines taken out of the text.

    A document that loses its every line is a copy of others and goes; all
    others stay, with their other lines unchanged.
    """
    name = free_name(docs, "rk")
    gone = dropped_lines(docs, key, text, edits).select(F.col("rk").alias(name), F.concat("exact", "near").alias(f"{name}_gone"))
    joined = docs.withColumn(name, row_key(key, text)).join(gone, name, "left")
    # the array is bound once, so that the text is split once
    rest = F.element_at(F.transform(F.array(F.split(F.col(text), "\n")), lambda ls: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(f"{name}_gone")), lambda i: F.get(ls, i))), 1)
    cut = joined.withColumn(f"{name}_rest", F.when(F.col(f"{name}_gone").isNotNull(), rest))
    kept = cut.filter(F.col(f"{name}_rest").isNull() | (F.size(f"{name}_rest") > 0))
    return kept.withColumn(text, F.when(F.col(f"{name}_rest").isNotNull(), F.array_join(f"{name}_rest", "\n")).otherwise(F.col(text))).select(*docs.columns)
