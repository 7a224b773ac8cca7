"""Exact k nearest neighbours as a partitioned join.

Reference rows are dealt to cells of nearest pivots. A query's reach is first
bounded by the counts and radii of the cells, then by its k-th neighbour in its
own cell; only cells that reach into that distance are visited, each a task of
its own with bounded numbers of rows and queries. Two lower bounds tell whether
a cell matters: its pivot's distance less its radius, and the distance to the
plane between its pivot and the query's own.

Rows with equal features collapse first: of references only the smallest keys
can be found, and queries are asked once. So neither the driver nor a task sees
more than a bounded part, and no pair beyond k for a query and a cell is stored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from movelens import fixed_values as fv
from movelens.sources.staging import stage, unstage

#: Rows for which there is one more pivot, and pivots at most (they are broadcast).
CELL_ROWS, MAX_PIVOTS = 2_000, 2_048
#: Rows of a cell and queries that one task holds.
PART_ROWS, QUERY_ROWS = 8_192, 2_048
#: Distances are widened by this share before they rule a cell out.
SLACK = 1e-9


@dataclass
class Cells:
    """Pivots, and per cell its rows, the farthest of them from the pivot, and its parts."""

    pivots: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    parts: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        gap = x[:, None, :] - self.pivots[None, :, :]
        return np.sqrt((gap * gap).sum(axis=2))

    def reach(self, far: np.ndarray, k: int) -> np.ndarray:
        """A distance within which every query has k rows, from the cells alone."""
        most = far + self.radius[None, :]
        order = np.argsort(most, axis=1)
        enough = np.cumsum(self.rows[order], axis=1) >= k
        first = enough.argmax(axis=1)
        at = np.arange(len(far))
        return np.where(enough[:, -1], most[at, order[at, first]], np.inf)

    def visited(self, far: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Whether a cell may hold a row within reach of a query."""
        home = far.argmin(axis=1)
        own = far[np.arange(len(far)), home][:, None]
        gap = self.pivots[home][:, None, :] - self.pivots[None, :, :]
        between = np.sqrt((gap * gap).sum(axis=2))
        plane = np.divide(far * far - own * own, 2 * between, out=np.zeros_like(far), where=between > 0)
        least = np.maximum(far - self.radius[None, :], plane)
        wide = reach[:, None] * (1 + SLACK) + SLACK * (1 + far)
        return (least <= wide) & (self.rows > 0)[None, :]


def _steps(n: int, width: int) -> range:
    """Starts of slices whose distance tables stay small."""
    return range(0, n, max(1, (1 << 21) // max(1, width)))


def _place(cells: Cells, features: Sequence[str], keep: Sequence[str]):
    """Function for mapInPandas: the cell of each row and its distance from the pivot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[list(features)].to_numpy(np.float64)
            for low in _steps(len(x), cells.pivots.size):
                far = cells.distances(x[low:low + _steps(len(x), cells.pivots.size).step])
                cell = far.argmin(axis=1)
                out = b.iloc[low:low + len(far)][[*keep, *features]].copy()
                out["_cell"], out["_far"] = cell.astype(np.int32), far[np.arange(len(far)), cell]
                yield out

    return run


def _visits(cells: Cells, features: Sequence[str], k: int):
    """Function for mapInPandas: the cells that each query must visit, given ``_reach`` (null if not known yet: its own cell only)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, known = b[list(features)].to_numpy(np.float64), b["_reach"].to_numpy(np.float64)
            step = _steps(len(x), cells.pivots.size).step
            for low in range(0, len(x), step):
                far = cells.distances(x[low:low + step])
                reach = np.fmin(cells.reach(far, k), known[low:low + step])
                r, c = np.nonzero(cells.visited(far, reach))
                out = b.iloc[low:low + len(far)].iloc[r][["_q", *features]].copy()
                out["_cell"], out["_reach"] = c.astype(np.int32), reach[r]
                yield out

    return run


def _near(features: Sequence[str], k: int, only_reach: bool):
    """Function for a cogroup of rows and queries of a cell: the k nearest within reach, or their distance alone."""

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_id")
        x, ids = rows[list(features)].to_numpy(np.float64), rows["_id"].to_numpy(np.int64)
        q, names, reach = asked[list(features)].to_numpy(np.float64), asked["_q"].to_numpy(np.int64), asked["_reach"].to_numpy(np.float64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, (1 << 20) // max(1, len(x)))
        for low in range(0, len(q), step):
            part = q[low:low + step]
            square = np.zeros((len(part), len(x)))
            for j in range(x.shape[1]):
                gap = x[:, j][None, :] - part[:, j][:, None]
                square += gap * gap
            if only_reach:
                last = np.partition(square, k - 1, axis=1)[:, k - 1] if len(x) >= k else np.full(len(part), np.inf)
                found.append((names[low:low + len(part)], last, np.zeros(len(part), np.int64)))
                continue
            for i, d in enumerate(square):
                most = (reach[low + i] * (1 + SLACK) + SLACK) ** 2
                at = np.flatnonzero(d <= (min(most, np.partition(d, k - 1)[k - 1]) if len(d) > k else most))
                at = at[np.argsort(d[at], kind="stable")[:k]]  # rows ascend by key
                found.append((np.full(len(at), names[low + i]), d[at], ids[at]))
        who, far, which = (np.concatenate(c) for c in zip(*found))
        if only_reach:
            return pd.DataFrame({"_q": who, "_last": np.sqrt(far)})
        return pd.DataFrame({"_q": who, "_d2": far, "_ref": which})

    return run


def _first(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(out) <= k)


def _cells_of(refs: DataFrame, features: Sequence[str], cell_rows: int) -> tuple[DataFrame, Cells]:
    """The rows with their cells and parts, and the cells."""
    vectors = refs.filter("_same = 1")
    pivots = max(1, min(MAX_PIVOTS, -(-vectors.count() // cell_rows)))
    chosen = vectors.select(*features).orderBy(F.xxhash64(*features), *features).limit(pivots).toPandas()  # MAX_PIVOTS at most
    cells = Cells(chosen.to_numpy(np.float64).reshape(-1, len(features)), *[np.zeros(0)] * 3)
    if not len(cells.pivots):
        cells.pivots = np.zeros((1, len(features)))
    fields = ", ".join(["_id long", *[f"`{c}` double" for c in features]])
    placed = stage(refs.mapInPandas(_place(cells, features, ["_id"]), f"{fields}, _cell int, _far double"), "knn-cells")
    n = len(cells.pivots)
    cells.rows, cells.radius = np.zeros(n, np.int64), np.zeros(n)
    for r in placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_far").alias("far")).collect():  # one row per pivot
        cells.rows[r["_cell"]], cells.radius[r["_cell"]] = r["n"], r["far"]
    cells.parts = -(-cells.rows // PART_ROWS)
    parts = F.element_at(F.lit(cells.parts.tolist()).cast("array<int>"), F.col("_cell") + 1)
    return placed.withColumn("_part", F.pmod(F.xxhash64("_id"), parts).cast("int")), cells


def nearest(
    queries: DataFrame,
    reference: DataFrame,
    features: Sequence[str],
    *,
    query_key: str,
    reference_key: str,
    k: int = fv.NEIGHBOURS,
    exclude_self: bool = False,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """The ``k`` nearest reference rows of every query by Euclidean distance.

    Reference keys are whole numbers that name one row each; the smaller one
    wins a tie. ``exclude_self`` leaves out the row whose key is the query's own.
    Rows and queries with a null or NaN feature take no part.
    Result: ``query_key``, ``rank``, ``neighbour``, ``distance``.
    """
    names = [f"_f{i}" for i in range(len(features))]

    def usable(df: DataFrame, key: str, out: str) -> DataFrame:
        # 0.0 added, so that both zeros are one value
        picked = df.select(F.col(key).alias(out), *[(F.col(c).cast("double") + F.lit(0.0)).alias(n) for c, n in zip(features, names)])
        for n in names:
            picked = picked.filter(F.col(n).isNotNull() & ~F.isnan(n))
        return picked

    wanted = k + exclude_self
    refs = usable(reference, reference_key, "_id").withColumn("_id", F.col("_id").cast("long"))
    refs = stage(_first(refs, names, ["_id"], wanted, "_same"), "knn-rows")
    placed, cells = _cells_of(refs, names, cell_rows)
    asked = stage(usable(queries, query_key, "_key"), "knn-queries")
    vectors = stage(asked.select(*names).distinct().withColumn("_q", F.monotonically_increasing_id()), "knn-vectors")
    fields = ", ".join(["_q long", *[f"`{c}` double" for c in names]])
    placed_parts = placed.select("_id", *names, "_cell", "_part")

    def met(visits: DataFrame, only_reach: bool, schema: str) -> DataFrame:
        """Visits and rows of each cell and part, the queries of a cell in blocks."""
        blocks = visits.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(QUERY_ROWS))).cast("int").alias("_blocks"))  # one row per pivot
        parts = F.element_at(F.lit(cells.parts.tolist()).cast("array<int>"), F.col("_cell") + 1)
        every = F.sequence(F.lit(0), F.lit(0) if only_reach else parts - 1)
        dealt = visits.join(F.broadcast(blocks), "_cell").withColumn("_block", F.pmod(F.xxhash64("_q"), F.col("_blocks")).cast("int"))
        dealt = dealt.drop("_blocks").withColumn("_part", F.explode(every))
        rows = placed_parts.filter("_part = 0") if only_reach else placed_parts
        rows = rows.join(F.broadcast(blocks), "_cell").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
        place = ["_cell", "_part", "_block"]
        return rows.groupBy(*place).cogroup(dealt.groupBy(*place)).applyInPandas(_both(_near(names, wanted, only_reach), schema), schema)

    reach = vectors.withColumn("_reach", F.lit(None).cast("double"))
    if len(cells.pivots) > 1:
        home = vectors.mapInPandas(_place(cells, names, ["_q"]), f"{fields}, _cell int, _far double").withColumn("_reach", F.lit(float("inf")))
        last = met(stage(home.drop("_far"), "knn-home"), True, "_q long, _last double")
        reach = vectors.join(last, "_q", "left").withColumnRenamed("_last", "_reach")
    visits = stage(reach.mapInPandas(_visits(cells, names, wanted), f"{fields}, _cell int, _reach double"), "knn-visits")
    found = _first(met(visits, False, "_q long, _d2 double, _ref long"), ["_q"], ["_d2", "_ref"], wanted, "_place")
    answers = asked.join(vectors, names).select("_key", "_q").join(found, "_q")
    if exclude_self:
        answers = answers.filter(~F.col("_ref").eqNullSafe(F.col("_key").cast("long")))
    ranked = stage(_first(answers, ["_key"], ["_d2", "_ref"], k), "knn")
    unstage(refs, asked, vectors, visits)
    return ranked.select(F.col("_key").alias(query_key), "rank", F.col("_ref").alias("neighbour"), F.sqrt("_d2").alias("distance"))


def _both(near, schema: str):
    """Groups with rows and queries only; others give nothing."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({c: [] for c in columns})
        return near(rows, asked)

    return run
