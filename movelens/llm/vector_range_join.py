"""Exact cosine range join within labels.

On unit vectors a cosine of c or more is a distance of sqrt(2 - 2c) or less, a
metric. Large labels are split by pivots: a vector lives in the cell of its
nearest pivot. A vector within radius r of one in another cell is at most 2r
farther from that cell's pivot than from its own (triangle inequality), so it
also visits such cells, of each two only the one of the higher number. Cells
join independently. A cell larger than a block is cut into blocks, and pairs of
blocks join independently, so a task never holds more than two blocks.

Equal vectors collapse first and count with their number. A block pair returns
a vector's number of links and one root per local group, never pairs.

Defined results: a null label, and a vector that is null, empty, zero or holds
null or non-finite components, links with nothing; vectors of different lengths
link with nothing; repeated rows count as vectors of their own; ids may repeat;
an empty table gives an empty result; other columns of the input do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movelens.llm.components import components, local_roots
from movelens.sources.staging import stage

#: Vectors for which a label gets one more pivot; vectors of a block; pivots of all labels together at most
#: (they are broadcast: 8 bytes a component).
CELL_ROWS, BLOCK_ROWS, MAX_PIVOTS = 2000, 2000, 8192


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    """Unit vectors from packed numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


def _packed(df: DataFrame) -> DataFrame:
    """``v``: the unit vector as bytes, instead of the array ``e``."""
    keep = [c for c in df.columns if c != "e"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = batch.column(batch.schema.get_field_index("e"))
            out = [_unit(np.asarray(x, np.float64)[None, :])[0].tobytes() for x in arrays.to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], pa.array(out, pa.binary())], names=[*keep, "v"])

    kinds = dict(df.dtypes)
    return df.mapInArrow(pack, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", v binary")


def _pivots(nodes: DataFrame, cell_rows: int, most: int) -> dict[tuple[int, int], np.ndarray]:
    """Pivots of each large label, chosen by hash among its vectors; at most about ``most`` in all."""
    total = nodes.count()
    per = max(cell_rows, math.ceil(total / most))
    large = nodes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > per)  # at most ``most`` rows
    share = F.lit(float(1 << 32)) / per
    chosen = nodes.join(F.broadcast(large.select("label", "size")), ["label", "size"]).filter(F.pmod(F.xxhash64("node"), F.lit(1 << 32)) < share)
    found: dict[tuple[int, int], list[bytes]] = {}
    for r in chosen.select("label", "size", "node", "v").orderBy("label", "size", "node").collect():
        found.setdefault((r.label, r.size), []).append(bytes(r.v))
    return {k: np.frombuffer(b"".join(v), np.float64).reshape(-1, k[1]) for k, v in found.items() if len(v) > 1}


def _cells(nodes: DataFrame, pivots: dict[tuple[int, int], np.ndarray], radius: float) -> DataFrame:
    """label, size, cell, home, node, copies, v: each vector in its own cell and in those it visits."""
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            label, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows, cells, home = [], [], []
            order = np.lexsort((size, label))
            cuts = np.flatnonzero((np.diff(label[order]) != 0) | (np.diff(size[order]) != 0)) + 1
            for at in np.split(order, cuts):
                p = shared.value.get((int(label[at[0]]), int(size[at[0]])))
                if p is None:
                    rows.append(at), cells.append(np.zeros(len(at), np.int32)), home.append(np.ones(len(at), bool))
                    continue
                x = _vectors(batch.column(4).take(pa.array(at)), p.shape[1])
                d = np.sqrt(np.maximum(0.0, 2 - 2 * (x @ p.T)))
                own = d.argmin(axis=1)
                near = d <= d[np.arange(len(at)), own][:, None] + 2 * radius + 1e-9
                near &= np.arange(p.shape[0])[None, :] > own[:, None]
                near[np.arange(len(at)), own] = True
                r, c = np.nonzero(near)
                rows.append(at[r]), cells.append(c.astype(np.int32)), home.append(c == own[r])
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(cells)), pa.array(np.concatenate(home)),
                batch.column(2).take(take), batch.column(3).take(take), batch.column(4).take(take),
            ], names=["label", "size", "cell", "home", "node", "copies", "v"])

    kinds = dict(nodes.dtypes)
    source = nodes.select("label", "size", "node", "copies", "v")
    return source.mapInArrow(place, f"label {kinds['label']}, size int, cell int, home boolean, node long, copies long, v binary")


def _join_blocks(threshold: float):
    def join(part: pd.DataFrame) -> pd.DataFrame:
        size, same = int(part["size"].iloc[0]), bool(part["b1"].iloc[0] == part["b2"].iloc[0])
        part = part.sort_values("node").reset_index(drop=True)
        x = np.frombuffer(b"".join(part["v"]), np.float64).reshape(-1, size)
        home, block, copies = part["home"].to_numpy(), part["block"].to_numpy(), part["copies"].to_numpy()
        rows, cols = [], []
        for low in range(0, len(x), 512):
            near = x[low:low + 512] @ x.T >= threshold
            near &= home[low:low + 512, None] | home[None, :]
            if not same:  # pairs inside one block belong to that block's own task
                near &= block[low:low + 512, None] != block[None, :]
            near[np.arange(near.shape[0]), low + np.arange(near.shape[0])] = False
            r, c = np.nonzero(near)
            rows.append(r + low), cols.append(c)
        r, c = np.concatenate(rows), np.concatenate(cols)
        links = np.bincount(r, weights=copies[c], minlength=len(x)).astype(np.int64)
        root = local_roots(r, c, len(x))
        got = links > 0
        node = part["node"].to_numpy()
        return pd.DataFrame({"node": node[got], "links": links[got], "root": node[root[got]]})

    return join


def range_join(vectors: DataFrame, key: str, vector: str, label: str, threshold: float, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row: id, n_links, component_id (smallest id reachable), kept (whether that is its own)."""
    e = F.col(vector).cast("array<double>")
    usable = F.col(label).isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.when(F.coalesce(usable, F.lit(False)), e).alias("e"))
    ids = ["label", "size", "k1", "k2"]
    rows = rows.withColumns({"size": F.coalesce(F.size("e"), F.lit(-1)), "k1": F.xxhash64("e"), "k2": F.hash("e")})
    distinct = rows.filter("e IS NOT NULL").groupBy(*ids).agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"), F.first("e").alias("e"))
    nodes = stage(_packed(distinct).withColumn("node", F.monotonically_increasing_id()), "vectors")
    pivots = _pivots(nodes, cell_rows, MAX_PIVOTS)
    # by less than rounding more than the radius, so that no pair at the threshold is lost
    cells = stage(_cells(nodes, pivots, math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9), "cells")
    place = ["label", "size", "cell"]
    blocks = cells.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block_rows))).cast("int").alias("blocks"))
    dealt = cells.join(blocks, place).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = dealt.withColumn("other", other).withColumns({"b1": F.least("block", "other"), "b2": F.greatest("block", "other")})
    found = stage(tasks.groupBy(*place, "b1", "b2").applyInPandas(_join_blocks(threshold), "node long, links long, root long"), "vector-links")
    groups = components(found, "node", "root")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", *ids, "copies", "first").join(groups, "node", "left").join(links, "node", "left")
    named = named.withColumn("root", F.coalesce("component", "node")).drop("component")
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    known = stage(named.join(least, "root").select(*ids, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component"), "vector-groups")
    out = rows.select("id", *ids, F.col("e").isNotNull().alias("usable"))
    out = out.join(known.withColumn("usable", F.lit(True)), [*ids, "usable"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id").eqNullSafe(component)).alias("kept"))
