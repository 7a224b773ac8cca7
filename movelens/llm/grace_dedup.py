"""Exact deduplication by Grace hashing.

Texts are equal when they are identical after lower-casing A-Z. Each scan task
puts its rows into an open-addressing table that compares complete contents and
passes on one record per distinct text, so a group that holds a third of all
rows shrinks before anything moves. The records are then dealt to buckets by a
hash; the files of that shuffle are the spill files. A bucket that fits the
table is settled. One that outgrows it passes its distinct texts on to the next
level, which deals them by another hash. A hash value with very many records is
dealt to several tasks and settled a level later. Hashes only choose slots and
buckets: equality is always that of the whole content.

Rows carry the number of their record, never a list of their copies.

Defined results: a null text counts as empty; null ids come before all others,
so a row with an id stays rather than one without; rows that repeat id and text
count each, and exactly one of them stays; an empty table gives an empty
result; other columns of the input do not matter, whatever their names. Ids may
be numbers, strings, dates or bytes.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movelens.llm.text_ids import free_name, whole_text
from movelens.sources.staging import stage, unstage

#: Bytes of texts that one table may hold; bytes of texts of one batch of output.
TABLE_BYTES, BATCH_BYTES = 48 << 20, 8 << 20
#: Records with one hash value that one task reads at most.
HOT_RECORDS = 4096
#: Bytes that an entry takes besides its text.
ENTRY_BYTES = 120
LEVELS = 24

_SMALL = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def normal(text: str | None) -> bytes:
    """The text in UTF-8 with A-Z in lower case; no byte of another character is in that range."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SMALL)


def text_hash(digest: bytes) -> int:
    """Signed 64-bit hash of a text, from its SHA-256 digest."""
    return int.from_bytes(digest[:8], "big", signed=True)


def _stays(key: Any, uid: int, old: Any, old_uid: int) -> bool:
    """Whether a row stays rather than an older one: by the larger key, null last, then by the smaller uid."""
    if key is None or old is None:
        return old is None and (key is not None or uid < old_uid)
    return key > old or (key == old and uid < old_uid)


class ContentTable:
    """Open addressing with linear probing over whole texts, each with its count and the row that stays."""

    def __init__(self) -> None:
        self.slots = array("q", [-1]) * 1024
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.counts: list[int] = []
        self.best: list[tuple[Any, int]] = []
        self.members: list[list[int]] = []
        self.size = 0

    def _slot(self, h: int, text: bytes) -> int:
        mask = len(self.slots) - 1
        at = (h ^ (h >> 29)) & mask
        while (e := self.slots[at]) >= 0 and not (self.hashes[e] == h and self.texts[e] == text):
            at = (at + 1) & mask
        return at

    def add(self, h: int, text: bytes, key: Any, uid: int, count: int = 1) -> int:
        """Number of the entry with this text, which now counts ``count`` more rows; the larger key stays, of equals the smaller uid."""
        at = self._slot(h, text)
        e = self.slots[at]
        if e >= 0:
            self.counts[e] += count
            self.size += 8
            old, old_uid = self.best[e]
            if _stays(key, uid, old, old_uid):
                self.best[e] = (key, uid)
            return e
        e = self.slots[at] = len(self.texts)
        self.hashes.append(h), self.texts.append(text), self.counts.append(count), self.best.append((key, uid)), self.members.append([])
        self.size += len(text) + ENTRY_BYTES
        if 2 * len(self.texts) > len(self.slots):
            self.slots = array("q", [-1]) * (2 * len(self.slots))
            for k, (x, t) in enumerate(zip(self.hashes, self.texts)):
                self.slots[self._slot(x, t)] = k
        return e


def _batches(columns: dict[str, list], kinds: dict[str, pa.DataType], texts: str) -> Iterator[pa.RecordBatch]:
    """The columns as batches of bounded bytes."""
    n, low, size = len(next(iter(columns.values()))), 0, 0
    for i in range(n):
        size += 64 + len(columns[texts][i] or b"")
        if size > BATCH_BYTES or i == n - 1:
            yield pa.RecordBatch.from_arrays([pa.array(columns[c][low:i + 1], kinds[c]) for c in kinds], names=list(kinds))
            low, size = i + 1, 0


def _schema(key: T.DataType, *more: tuple[str, T.DataType]) -> T.StructType:
    fields = [("kind", T.IntegerType()), ("rep", T.LongType()), ("keep", key), ("keep_uid", T.LongType()), ("n", T.LongType()),
              ("h", T.LongType()), ("text", T.BinaryType()), *more]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _gathered(df: DataFrame, key: str, text: str, table_bytes: int) -> DataFrame:
    """Kind 0: every row with the record of its text. Kind 1: the records, one per distinct text of a full table."""
    source = df.select(F.col(key).alias("id"), whole_text(text).alias("t"))
    kind = source.schema["id"].dataType
    schema = _schema(kind, ("uid", T.LongType()), ("id", kind), ("digest", T.StringType()))
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, row, first, table, kinds = TaskContext.get().partitionId() << 40, 0, 0, ContentTable(), None

        def records() -> Iterator[pa.RecordBatch]:
            n = len(table.texts)
            blank = [None] * n
            yield from _batches({
                "kind": [1] * n, "rep": [base + first + e for e in range(n)], "keep": [b[0] for b in table.best],
                "keep_uid": [b[1] for b in table.best], "n": table.counts, "h": table.hashes, "text": table.texts,
                "uid": blank, "id": blank, "digest": blank}, kinds, "text")

        for batch in batches:
            ids = batch.column(0)
            kinds = kinds or {c: {"keep": ids.type, "id": ids.type, "kind": pa.int32(), "text": pa.binary(), "digest": pa.string()}.get(c, pa.int64()) for c in names}
            low, reps, digests = 0, [], []
            keys, texts = ids.to_pylist(), batch.column(1)

            def members(high: int) -> Iterator[pa.RecordBatch]:
                n = high - low
                blank = [None] * n
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for k, c in {
                        "kind": [0] * n, "rep": reps, "keep": blank, "keep_uid": blank, "n": blank, "h": blank, "text": blank,
                        "uid": range(base + row - n, base + row), "id": keys[low:high], "digest": digests}.items()], names=names)

            for i, k in enumerate(keys):
                t = normal(texts[i].as_py())
                digest = hashlib.sha256(t)
                e = table.add(text_hash(digest.digest()), t, k, base + row)
                row += 1
                reps.append(base + first + e), digests.append(digest.hexdigest())
                if table.size > table_bytes:
                    yield from members(i + 1)
                    yield from records()
                    low, reps, digests = i + 1, [], []
                    first, table = first + len(table.texts), ContentTable()
            yield from members(len(keys))
        if table.texts:
            yield from records()

    return source.mapInArrow(run, schema)


def _merged(records: DataFrame, table_bytes: int) -> DataFrame:
    """One table per bucket. Kind 0: every record with what is known of its group. Kind 1: groups that the next level takes on."""
    kind = records.schema["keep"].dataType
    schema = _schema(kind, ("grp", T.LongType()), ("done", T.BooleanType()))
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, later, kinds, full = ContentTable(), [], None, False

        def told(done: bool) -> Iterator[pa.RecordBatch]:
            out: dict[str, list] = {c: [] for c in names}
            for e, reps in enumerate(table.members):
                over = done and not later[e]
                for r in [*reps, *([] if over else [None])]:
                    row = (0, r, *table.best[e], table.counts[e], None, None, reps[0], over) if r is not None else (
                        1, reps[0], *table.best[e], table.counts[e], table.hashes[e], table.texts[e], None, None)
                    for c, x in zip(names, row):
                        out[c].append(x)
            if out["kind"]:
                yield from _batches(out, kinds, "text")

        for batch in batches:
            kinds = kinds or {c: {"keep": batch.column(1).type, "kind": pa.int32(), "text": pa.binary(), "done": pa.bool_()}.get(c, pa.int64()) for c in names}
            rep, keep, uid, n, h, shared = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 6))
            for i in range(batch.num_rows):
                e = table.add(h[i], batch.column(5)[i].as_py(), keep[i], uid[i], n[i])
                if e == len(later):
                    later.append(False)
                later[e] |= shared[i]
                table.members[e].append(rep[i])
                if table.size > table_bytes and len(table.texts) > 1:
                    full = True
                    yield from told(False)
                    table, later = ContentTable(), []
        if table.texts:
            yield from told(not full)

    return records.select("rep", "keep", "keep_uid", "n", "h", "text", "shared").mapInArrow(run, schema)


def _settled(records: DataFrame, level: int, table_bytes: int, hot_records: int) -> DataFrame:
    """rep, keep, keep_uid, n: for each record what holds for its whole group."""
    if level > LEVELS:
        raise RuntimeError(f"buckets did not fit their tables in {LEVELS} levels")
    total = records.agg(F.sum(F.octet_length("text") + ENTRY_BYTES)).first()[0] or 0
    buckets = max(1, -(-4 * total // table_bytes))
    hot = records.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > hot_records)
    hot = stage(hot.select("h", F.ceil(F.col("c") / hot_records).alias("parts")), "grace-hot")
    if hot.isEmpty():
        dealt = records.withColumn("part", F.lit(0)).withColumn("shared", F.lit(False))
    else:
        dealt = records.join(hot, "h", "left").withColumn("shared", F.col("parts").isNotNull())
        dealt = dealt.withColumn("part", F.when(F.col("shared"), F.pmod(F.xxhash64("rep"), F.col("parts"))).otherwise(0))
    # whatever the number of buckets, each level hashes anew
    dealt = dealt.repartition(buckets, F.xxhash64("h", "part", F.lit(level)))
    out = stage(_merged(dealt, table_bytes), "grace-level")
    unstage(hot)
    known = ["rep", "keep", "keep_uid", "n"]
    done = out.filter("kind = 0 AND done").select(*known)
    rest = out.filter("kind = 1")
    if rest.isEmpty():
        return done
    later = _settled(rest.select(*known, "h", "text"), level + 1, table_bytes, hot_records)
    moved = out.filter("kind = 0 AND NOT done").select("rep", "grp")
    return done.unionByName(moved.join(later.withColumnRenamed("rep", "grp"), "grp").select(*known))


def exact_groups(df: DataFrame, key: str, text: str, table_bytes: int = TABLE_BYTES, hot_records: int = HOT_RECORDS) -> DataFrame:
    """One row per row: the key, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Of equal texts the row with the largest key stays.
    """
    both = stage(_gathered(df, key, text, table_bytes), "grace-rows")
    settled = _settled(both.filter("kind = 1").select("rep", "keep", "keep_uid", "n", "h", "text"), 0, table_bytes, hot_records)
    return both.filter("kind = 0").select("uid", "id", "rep", "digest").join(settled, "rep").select(
        F.col("id").alias(key), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("uid") == F.col("keep_uid")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def drop_copies(df: DataFrame, key: str, text: str) -> DataFrame:
    """The rows that stay, with all their columns."""
    row, group, best = (free_name(df, c) for c in ("row_no", "group_no", "best_row"))
    fixed = stage(df.withColumn(row, F.monotonically_increasing_id()), "grace-input")
    groups = exact_groups(fixed, row, text).select(F.col(row), F.col("keep_id").alias(group))
    order = F.struct(F.col(key).isNotNull(), F.col(key), (-F.col(row)).alias("no"))
    stay = fixed.select(key, row).join(groups, row).groupBy(group).agg(F.max(order).alias(best)).select((-F.col(f"{best}.no")).alias(row))
    return fixed.join(stay, row, "left_semi").select(*df.columns)
