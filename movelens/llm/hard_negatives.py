"""Hard negatives by an inverted multi-index, exact.

Vectors are cut into two halves, and a codebook for each half (k-means on a
bounded sample) deals every row to a cell of two codes. A code's radius is the
farthest that any row's half lies from it, so an anchor's score with a row of a
cell is at most the sum over both halves of ``q.c + |q| r``, and at least that
of ``q.c - |q| r``. Cells are stored together in shards of bounded size; a cell
larger than a shard is cut.

A search walks a shard's cells with a multi-sequence heap, in the order of the
summed upper bounds, and stops when what it looks for is certified: no cell left
reaches the worst of the k results held. It starts in the shard where the
anchor lives; shards none of whose cells reach what was found there are never
visited. First come the positives, the best rows of the anchor's own label, then
for each the best rows of other labels within a window of its score, both by the
same search. Tasks hold one shard and one block of anchors, and return k rows
for each anchor and window, never pairs.

Defined results: rows with a null id or label, a null vector, or a null or
non-finite component (also after scaling) take no part; missing components of
shorter vectors count as 0; rows that repeat an id are rows of their own;
equal scores go by the smaller id; scores beyond 64 bits are exact in all
comparisons and returned as the nearest long; labels that are not whole numbers are
compared by a 64-bit hash; an empty table gives an empty result; other columns
of the input do not matter, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from movelens.sources.staging import stage, unstage

#: Rows that the codebooks are fitted on; rows of a cell aimed at; codes of a half at most (a table of cells is broadcast).
SAMPLE_ROWS, CELL_ROWS, MAX_CODES = 4096, 32, 128
#: Rows of a shard; anchors of a block; rows scored at once.
SHARD_ROWS, BLOCK_ROWS, STEP_ROWS = 8192, 256, 1024
#: Sums below this are exact in double precision.
EXACT = float(1 << 53)


@dataclass
class Codebooks:
    """Centres and radii of both halves, the number of rows in each cell, and the shards that hold it."""

    cut: int
    centres: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray] = ()
    first_shard: np.ndarray | None = None
    parts: np.ndarray | None = None

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[..., :self.cut], x[..., self.cut:]

    def bounds(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Lowest and highest half-scores of each code, for both halves, widened by more than rounding."""
        out = []
        for part, centres, radii in zip(self.halves(q), self.centres, self.radii):
            mid, reach = centres @ part, np.sqrt(part @ part) * radii
            slack = 1e-6 + 1e-9 * (np.abs(mid) + reach)
            out.append((mid - reach - slack, mid + reach + slack))
        return out

    def shards_reaching(self, q: np.ndarray, windows: list[tuple[float, float]]) -> set[int]:
        """Shards with a cell that may score within one of the windows."""
        (low1, up1), (low2, up2) = self.bounds(q)
        high, low = up1[:, None] + up2[None, :], low1[:, None] + low2[None, :]
        near = np.zeros(high.shape, bool)
        for least, most in windows:
            near |= (high >= least) & (low <= most)
        near &= self.parts > 0
        out: set[int] = set()
        for a, b in np.argwhere(near):
            out.update(range(self.first_shard[a, b], self.first_shard[a, b] + self.parts[a, b]))
        return out


@dataclass
class Wanted:
    """A search: the best ``k`` rows of the anchor's label (or of others) with scores from ``low`` to ``high``."""

    tag: int
    same: bool
    k: int
    low: float = -math.inf
    high: float = math.inf
    scores: np.ndarray = field(default_factory=lambda: np.empty(0))
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    uids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def needed(self) -> float:
        """A row must score this much to matter."""
        return max(self.low, self.scores[-1]) if len(self.scores) == self.k else self.low

    def offer(self, scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, same: np.ndarray) -> None:
        take = (same if self.same else ~same) & (scores >= self.needed()) & (scores <= self.high)
        if not take.any():
            return
        s, i, u = (np.concatenate(x) for x in ((self.scores, scores[take]), (self.ids, ids[take]), (self.uids, uids[take])))
        order = np.lexsort((u, i, -s)) if s.dtype != object else np.array(sorted(range(len(s)), key=lambda j: (-s[j], i[j], u[j])))
        order = order[:self.k]
        self.scores, self.ids, self.uids = s[order], i[order], u[order]


class Shard:
    """Rows of a shard, ordered by cell."""

    def __init__(self, packed: dict, dims: int) -> None:
        self.ids, self.uids, self.labels = (np.frombuffer(packed[c], np.int64) for c in ("ids", "uids", "labels"))
        self.vectors = np.frombuffer(packed["vectors"], packed["kind"]).reshape(-1, dims).astype(np.float64)
        self.anchor = np.frombuffer(packed["anchor"], bool)
        codes = np.frombuffer(packed["codes"], np.int32).reshape(-1, 2)
        cuts = np.flatnonzero((np.diff(codes, axis=0) != 0).any(axis=1)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(codes)]))
        self.cells = {tuple(codes[a]): (a, b) for a, b in zip(starts.tolist(), ends.tolist())}
        self.firsts, self.seconds = np.unique(codes[:, 0]), np.unique(codes[:, 1])

    def search(self, q: np.ndarray, uid: int, label: int, wanted: list[Wanted], books: Codebooks) -> None:
        """Walks the cells by their upper bounds until every wanted list is certified."""
        (low1, up1), (low2, up2) = books.bounds(q)
        a = self.firsts[np.argsort(-up1[self.firsts], kind="stable")]
        b = self.seconds[np.argsort(-up2[self.seconds], kind="stable")]
        heap = [(-(up1[a[0]] + up2[b[0]]), 0, 0)]
        most = max(w.high for w in wanted)
        while heap:
            needed = min(w.needed() for w in wanted)
            spans, rows = [], 0
            while heap and -heap[0][0] >= needed and rows < STEP_ROWS:
                _, i, j = heapq.heappop(heap)
                if j + 1 < len(b):
                    heapq.heappush(heap, (-(up1[a[i]] + up2[b[j + 1]]), i, j + 1))
                if j == 0 and i + 1 < len(a):
                    heapq.heappush(heap, (-(up1[a[i + 1]] + up2[b[0]]), i + 1, 0))
                span = self.cells.get((a[i], b[j]))
                if span and low1[a[i]] + low2[b[j]] <= most:
                    spans.append(span)
                    rows += span[1] - span[0]
            if not spans:
                if not heap or -heap[0][0] < needed:
                    return
                continue
            at = np.concatenate([np.arange(x, y) for x, y in spans])
            at = at[self.uids[at] != uid]
            scores = _products(self.vectors[at], q)
            for w in wanted:
                w.offer(scores, self.ids[at], self.uids[at], self.labels[at] == label)


def _products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where no sum can leave their whole numbers, else in Python's integers."""
    if not len(rows) or np.abs(rows).max() * np.abs(q).sum() < EXACT:
        return rows @ q
    whole = [int(x) for x in q]
    return np.array([sum(int(x) * y for x, y in zip(r, whole)) for r in rows.tolist()], dtype=object)


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from rows spread over the sample; empty codes keep their place."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)[0]
        for c in range(k):
            mine = x[near == c]
            if len(mine):
                centres[c] = mine.mean(axis=0)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row, and the distance to it."""
    d = (centres * centres).sum(axis=1)[None, :] - 2.0 * (x @ centres.T)
    near = d.argmin(axis=1)
    gap = x - centres[near]
    return near, np.sqrt((gap * gap).sum(axis=1))


def _scaled_rows(df: DataFrame, key: str, vector: str, label: Column, anchors: Column, scale: int) -> DataFrame:
    """id, uid, label, anchor, e: rows that take part, components as whole numbers in doubles."""
    e = F.transform(F.col(vector).cast("array<double>"), lambda x: x * F.lit(float(scale)))
    usable = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kind = dict(df.select(label.alias("label")).dtypes)["label"]
    code = label.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(label)
    picked = df.select(
        F.col(key).cast("long").alias("id"), F.when(label.isNotNull(), code).alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"), e.alias("e"), F.coalesce(usable, F.lit(False)).alias("usable"))
    return picked.filter("usable AND id IS NOT NULL AND label IS NOT NULL").drop("usable").withColumn("uid", F.monotonically_increasing_id())


def _sample(rows: DataFrame, total: int) -> list[Row]:
    """The SAMPLE_ROWS rows with the smallest hashes.

    Each task sends the driver as many rows as are asked for. So only rows with hashes that about twice as many rows have
    are ordered, and all of them should these be too few.
    """
    hashed = rows.select("e", "uid", F.xxhash64("id", "uid").alias("h"))
    if total > 2 * SAMPLE_ROWS:
        below = (1 << 64) * 2 * SAMPLE_ROWS // total - (1 << 63)
        found = hashed.filter(F.col("h") < below).orderBy("h", "uid").limit(SAMPLE_ROWS).collect()
        if len(found) == SAMPLE_ROWS:
            return found
    return hashed.orderBy("h", "uid").limit(SAMPLE_ROWS).collect()


def _matrix(arrays: pa.Array, dims: int) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros."""
    out = np.zeros((len(arrays), dims))
    sizes = np.diff(arrays.offsets.to_numpy())
    flat = np.floor(arrays.flatten().to_numpy())
    out[np.repeat(np.arange(len(arrays)), sizes), np.concatenate([np.arange(s) for s in sizes]) if len(sizes) else []] = flat
    return out


def _assigned(rows: DataFrame, books: Codebooks, dims: int, kind: str) -> DataFrame:
    """Rows with their codes, the distances to them, and the vector as bytes."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(3), dims)
            codes = [_nearest(half, c) for half, c in zip(shared.value.halves(x), shared.value.centres)]
            packed = x.astype(kind)
            yield pa.RecordBatch.from_arrays([
                *[batch.column(i) for i in (0, 1, 2, 4)], *[pa.array(c.astype(np.int32)) for c, _ in codes], *[pa.array(d) for _, d in codes],
                pa.array([r.tobytes() for r in packed], pa.binary()),
            ], names=["id", "label", "anchor", "uid", "c1", "c2", "d1", "d2", "v"])

    schema = "id long, label long, anchor boolean, uid long, c1 int, c2 int, d1 double, d2 double, v binary"
    return rows.select("id", "label", "anchor", "e", "uid").mapInArrow(run, schema)


def _pack(kind: str):
    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["c1", "c2", "uid"])
        whole = lambda c, t: np.ascontiguousarray(part[c].to_numpy(), t).tobytes()
        return pd.DataFrame({
            "shard": [int(part["shard"].iloc[0])], "kind": [kind], "ids": [whole("id", np.int64)], "uids": [whole("uid", np.int64)],
            "labels": [whole("label", np.int64)], "codes": [whole(["c1", "c2"], np.int32)], "anchor": [whole("anchor", bool)],
            "vectors": [b"".join(part["v"])]})

    return pack


SHARD = "shard long, kind string, ids binary, uids binary, labels binary, codes binary, anchor binary, vectors binary"
#: anchor, tag (of the search), row found, score (as text, as it may be longer than a long)
FOUND = "anchor: long, tag: int, id: long, uid: long, score: string"
ASKED = "uid: long, label: long, q: binary, needed: array<string>, scores: array<string>"


def _found(anchor: int, wanted: list[Wanted], out: dict[str, list]) -> None:
    for w in wanted:
        n = len(w.scores)
        out["anchor"] += [anchor] * n
        out["tag"] += [w.tag] * n
        out["id"] += w.ids.tolist()
        out["uid"] += w.uids.tolist()
        out["score"] += [str(int(s)) for s in w.scores]


def _found_batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out.values(), kinds)], names=list(out))


def _empty() -> dict[str, list]:
    return {"anchor": [], "tag": [], "id": [], "uid": [], "score": []}


def _searched(shards: DataFrame, windows: DataFrame | None, books: Codebooks, dims: int, k: int, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """Found rows of every anchor, for its positives or, given ``windows`` (anchor, scores), for each of its windows."""
    shared = shards.sparkSession.sparkContext.broadcast(books)
    own_label = windows is None

    def wishes(scores: list[str] | None) -> list[Wanted]:
        if scores is None:
            return [Wanted(0, True, k)]
        out = []
        for tag, s in enumerate(map(int, scores)):
            least, most = -(-low[0] * s // low[1]), high[0] * s // high[1]
            if least <= most:
                out.append(Wanted(tag, False, k, least, most))
        return out

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every anchor against its own shard; with each block goes what is still to be beaten, and the shards that may."""
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, dims)
                scores = dict(zip(row["anchors"], row["scores"])) if "scores" in row and row["anchors"] else None
                at = np.flatnonzero(shard.anchor)
                for start in range(0, len(at), BLOCK_ROWS):
                    out, visits, asked = _empty(), set(), []
                    for i in at[start:start + BLOCK_ROWS].tolist():
                        uid, label, q = int(shard.uids[i]), int(shard.labels[i]), shard.vectors[i]
                        if not own_label and (scores is None or uid not in scores):
                            continue
                        wanted = wishes(None if own_label else scores[uid])
                        if not wanted:
                            continue
                        shard.search(q, uid, label, wanted, shared.value)
                        _found(uid, wanted, out)
                        visits |= shared.value.shards_reaching(q, [(w.needed(), w.high) for w in wanted])
                        asked.append({"uid": uid, "label": label, "q": q.astype(row["kind"]).tobytes(),
                                      "needed": [None if w.needed() == -math.inf else str(int(w.needed())) for w in wanted], "scores": None if own_label else scores[uid]})
                    if asked:
                        yield pa.RecordBatch.from_pylist(
                            [{"visits": sorted(visits - {row["shard"]}), "asked": asked, "found": [dict(zip(out, x)) for x in zip(*out.values())]}], schema=arrow)

    found = pa.struct([("anchor", pa.int64()), ("tag", pa.int32()), ("id", pa.int64()), ("uid", pa.int64()), ("score", pa.string())])
    ask = pa.struct([("uid", pa.int64()), ("label", pa.int64()), ("q", pa.binary()), ("needed", pa.list_(pa.string())), ("scores", pa.list_(pa.string()))])
    arrow = pa.schema([("visits", pa.list_(pa.int64())), ("asked", pa.list_(ask)), ("found", pa.list_(found))])
    source = shards if own_label else shards.join(windows, "shard")
    blocks = stage(source.mapInArrow(home, f"visits array<long>, asked array<struct<{ASKED}>>, found array<struct<{FOUND}>>"), "negatives-home")

    def away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard, out = Shard(row, dims), _empty()
                for a in row["asked"]:
                    wanted = wishes(a["scores"])
                    for w, needed in zip(wanted, a["needed"]):
                        w.low = w.low if needed is None else max(w.low, int(needed))
                    shard.search(np.frombuffer(a["q"], row["kind"]).astype(np.float64), a["uid"], a["label"], wanted, shared.value)
                    _found(a["uid"], wanted, out)
                if out["anchor"]:
                    yield _found_batch(out)

    # a block is met once for each shard that it visits, which the optimizer does not foresee: it would broadcast them all
    pairs = blocks.select(F.explode("visits").alias("shard"), "asked").join(shards.hint("merge"), "shard")
    more = pairs.mapInArrow(away, FOUND)
    return blocks.select(F.inline("found")).unionByName(more)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best k rows of each search, numbered from 1."""
    order = Window.partitionBy("anchor", "tag").orderBy(F.col("s").desc(), "id", "uid")
    return found.withColumn("s", F.col("score").cast("decimal(38,0)")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    df: DataFrame, key: str, vector: str, label: Column, anchors: Column, positives: int = 5, negatives: int = 10,
    low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100), scale: int = 256,
    shard_rows: int = SHARD_ROWS, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A positive is one of an anchor's ``positives`` best other rows of its label.
    Its negatives are the best rows of other labels that score between ``low``
    and ``high`` (numerator, denominator) times as much with the anchor.
    """
    rows = stage(_scaled_rows(df, key, vector, label, anchors, scale), "negatives-rows")
    size = F.aggregate("e", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    total, dims, widest = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("e")), F.lit(0)), F.coalesce(F.max(size), F.lit(0.0))).first()
    kind = "<f4" if widest < (1 << 24) else "<f8"
    sample = _sample(rows, total)
    x = np.zeros((max(1, len(sample)), dims))
    for i, r in enumerate(sample):
        x[i, :len(r.e)] = np.floor(r.e)
    codes = max(1, min(MAX_CODES, math.ceil(math.sqrt(total / cell_rows)), len(sample)))
    books = Codebooks(dims // 2, (_kmeans(x[:, :dims // 2], codes), _kmeans(x[:, dims // 2:], codes)))
    placed = stage(_assigned(rows, books, dims, kind), "negatives-placed")
    unstage(rows)
    cells = placed.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.max("d1").alias("d1"), F.max("d2").alias("d2")).collect()  # codes squared at most
    radii = np.zeros((2, codes))
    books.first_shard, books.parts = np.zeros((codes, codes), np.int64), np.zeros((codes, codes), np.int64)
    shard, held = 0, 0
    for c in sorted(cells, key=lambda c: (c.c1, c.c2)):
        radii[0, c.c1], radii[1, c.c2] = max(radii[0, c.c1], c.d1), max(radii[1, c.c2], c.d2)
        parts = -(-c.n // shard_rows)
        if held and (held + c.n > shard_rows):
            shard, held = shard + 1, 0
        books.first_shard[c.c1, c.c2], books.parts[c.c1, c.c2] = shard, parts
        shard, held = shard + parts - 1, held + c.n if parts == 1 else shard_rows
    books.radii = (radii[0], radii[1])
    # one row per cell, codes squared at most
    spark = df.sparkSession
    places = spark.createDataFrame(
        [(c.c1, c.c2, int(books.first_shard[c.c1, c.c2]), int(books.parts[c.c1, c.c2])) for c in cells], "c1 int, c2 int, first long, parts int")
    dealt = placed.join(F.broadcast(places), ["c1", "c2"]).withColumn("shard", F.col("first") + F.pmod(F.xxhash64("uid"), F.col("parts")))
    shards = stage(dealt.select("shard", "id", "uid", "label", "anchor", "c1", "c2", "v").groupBy("shard").applyInPandas(_pack(kind), SHARD), "negatives-shards")
    names = placed.filter("anchor").select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"))
    good = stage(_best(_searched(shards, None, books, dims, positives, low, high), positives), "negatives-positives")
    # tags of the second search are places in this list, which has ``positives`` scores at most
    listed = good.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("list"))
    homes = dealt.filter("anchor").select(F.col("uid").alias("anchor"), "shard")
    windows = homes.join(listed, "anchor").groupBy("shard").agg(  # a shard's anchors are its rows at most
        F.collect_list(F.struct("anchor", F.col("list.score").alias("scores"))).alias("all"))
    windows = windows.select("shard", F.col("all.anchor").alias("anchors"), F.col("all.scores").alias("scores"))
    bad = _best(_searched(shards, windows, books, dims, negatives, low, high), negatives)
    whole = lambda s: F.least(F.greatest(s, F.lit(-(1 << 63)).cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    chosen = good.select("anchor", (F.col("rank") - 1).alias("tag"), F.col("id").alias("positive_id"), whole(F.col("s")).alias("positive_score"))
    out = bad.select("anchor", "tag", "rank", F.col("id").alias("negative_id"), whole(F.col("s")).alias("negative_score"))
    return out.join(chosen, ["anchor", "tag"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
