"""Structure repair of conversations by a persistent audit DP.

A conversation's rows, in order, are kept, given another role (user or
assistant) or deleted, and empty rows may be inserted, until the role initials
read ``(s?(ua)+)?``. The cheapest edits win; of equally cheap ones those whose
letters (Keep, Rerole, Delete, Insert) come first in ASCII order.

The DP has four states: nothing yet, after s, after u, after a. A state's best
edits so far are a linked node: its last letter and its parent, so that states
share all the edits they have in common. Nodes hold ancestors at distances of
powers of two and a rolling hash of all letters down to them. Equally cheap
nodes are told apart by their longest common prefix, found by lifting both
while the hashes differ; equal hashes are verified letter by letter down to the
node that both share. Letters fix the cost, so of two equally cheap ones
neither is a prefix of the other, and a prefix that loses now never wins later.

A task reads its conversations as a sorted stream. The letters that all live
states share are final: they are written out every ``COMMIT_ROWS`` rows and
their rows let go, so a conversation of any length needs memory for its open
end, 16 bytes for each distinct row and one letter for each edit of its report,
not for its texts. States that another state beats whatever follows are dropped.

Defined results: null roles and texts count as one space; null turns come first
and null ids form a conversation; rows of one turn are ordered by role and
text; turns are read as whole numbers; a conversation without rows has zeros,
an empty audit and the hash of an empty text; an empty table gives an empty
result; other columns of the input do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Costs of the edits; what a truncated row costs if it is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows between two attempts to settle what all states share; characters of text of one batch of output.
COMMIT_ROWS, BATCH_CHARS = 64, 4 << 20
#: Base and modulus of the rolling hash.
BASE, MOD = 911_382_323, (1 << 61) - 1

BLANK = " \t\n\x0b\x0c\r"
START, S, U, A = range(4)
ROLE = {U: "user", A: "assistant"}
LEGAL = {"su", "ua", "au"}
#: State before -> state after, for a row or insertion of each role initial.
NEXT = {"s": ((START, S),), "u": ((START, U), (S, U), (A, U)), "a": ((U, A),)}


class Node:
    """Edits up to here: the last letter, the state it leads to, and the edits before."""

    __slots__ = ("letter", "state", "depth", "hash", "up")

    def __init__(self, parent: Node | None, letter: str, state: int) -> None:
        self.letter, self.state = letter, state
        if parent is None:
            self.depth, self.hash, self.up = 0, 0, ()
            return
        self.depth = parent.depth + 1
        self.hash = (parent.hash * BASE + ord(letter)) % MOD
        up = [parent]
        while len(up[-1].up) >= len(up):
            up.append(up[-1].up[len(up) - 1])
        self.up = tuple(up)

    def at(self, depth: int) -> Node:
        """The ancestor at this depth."""
        node = self
        while node.depth > depth:
            node = node.up[min(len(node.up), (node.depth - depth).bit_length()) - 1]
        return node


def before(x: Node, y: Node) -> bool:
    """Whether the letters of x come before those of y in ASCII order."""
    depth = min(x.depth, y.depth)
    a, b = x.at(depth), y.at(depth)
    if a is not b and a.hash != b.hash:
        for k in range(len(a.up) - 1, -1, -1):
            if k < len(a.up) and a.up[k] is not b.up[k] and a.up[k].hash != b.up[k].hash:
                a, b = a.up[k], b.up[k]
    # all before a and b has equal hashes (or a and b themselves): verified here, as the first difference decides
    less = x.depth < y.depth
    while a is not b:
        if a.letter != b.letter:
            less = a.letter < b.letter
        a, b = a.up[0], b.up[0]
    return less


def common(nodes: list[Node]) -> Node:
    """The deepest node that all of them share."""
    depth = min(n.depth for n in nodes)
    nodes = [n.at(depth) for n in nodes]
    while any(n is not nodes[0] for n in nodes):
        jump = next((k for k in range(len(nodes[0].up) - 1, -1, -1) if any(n.up[k] is not nodes[0].up[k] for n in nodes)), 0)
        nodes = [n.up[jump] for n in nodes]
    return nodes[0]


def path(top: Node, node: Node) -> list[Node]:
    """Nodes after ``top`` down to ``node``."""
    out = []
    while node is not top:
        out.append(node)
        node = node.up[0]
    return out[::-1]


class AuditDP:
    """Best edits per state for the rows seen so far; settled edits are handed out by :meth:`commit`."""

    def __init__(self) -> None:
        root = Node(None, "", START)
        self.root = root
        self.best: dict[int, tuple[int, Node]] = {}
        self._offer(self.best, START, 0, root)
        self._insert(self.best)

    @staticmethod
    def _offer(best: dict[int, tuple[int, Node]], state: int, cost: int, node: Node) -> None:
        old = best.get(state)
        if old is None or cost < old[0] or (cost == old[0] and before(node, old[1])):
            best[state] = (cost, node)

    def _step(self, into: dict[int, tuple[int, Node]], pairs, letter: str, cost: int, source: dict[int, tuple[int, Node]]) -> None:
        for state, after in pairs:
            if state in source:
                c, node = source[state]
                if after not in into or c + cost <= into[after][0]:
                    self._offer(into, after, c + cost, Node(node, letter, after))

    def _insert(self, best: dict[int, tuple[int, Node]]) -> None:
        for initial in "ua":
            self._step(best, NEXT[initial], "I", INSERT, best)

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        new: dict[int, tuple[int, Node]] = {}
        self._step(new, [(s, s) for s in (START, S, U, A)], "D", DELETE, self.best)
        if not must_go:
            extra = TRUNCATED * truncated
            self._step(new, NEXT.get(initial, ()), "K", extra, self.best)
            for role in "ua":
                self._step(new, NEXT[role], "R", REROLE + extra, self.best)
        self._insert(new)
        # a row after a is as good as a row after nothing or after s, but for a kept s, which deletion replaces
        if A in new:
            if START in new and new[A][0] + DELETE < new[START][0]:
                del new[START]
            if S in new and new[A][0] < new[S][0]:
                del new[S]
        self.best = new

    def commit(self) -> list[Node]:
        """The edits that all states share, which become the new root."""
        live = [n for _, n in self.best.values()]
        top = common(live)
        done = path(self.root, top)
        self.root = Node(None, "", top.state)
        made = {top: self.root}
        for node in live:
            for n in path(top, node):
                if n not in made:
                    made[n] = Node(made[n.up[0]], n.letter, n.state)
        self.best = {s: (c, made[n]) for s, (c, n) in self.best.items()}
        return done

    def end(self) -> tuple[int, list[Node]]:
        """Cost of the whole, and the edits not handed out yet."""
        ends: dict[int, tuple[int, Node]] = {}
        for s in (START, A):
            if s in self.best:
                self._offer(ends, 0, *self.best[s])
        cost, node = ends[0]
        return cost, path(self.root, node)


@dataclass
class Row:
    turn: int | None
    role: str
    text: str


class Conversation:
    """One conversation read as a stream; ``edits`` yields (letter, row or None, role, text) as they settle."""

    def __init__(self) -> None:
        self.dp, self.open = AuditDP(), deque()
        self.seen: set[bytes] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.rows = 0
        self.first: int | None = None
        self.last: int | None = None
        self.initial: str | None = None

    @property
    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.turns

    def add(self, row: Row) -> Iterator[tuple[str, Row | None, str, str]]:
        if row.turn is not None and (self.first is None or row.turn != self.last):
            self.first = row.turn if self.first is None else self.first
            self.last, self.turns = row.turn, self.turns + 1
        initial = row.role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        key = hashlib.blake2b(f"{len(row.role)}:{row.role}{row.text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        shown = row.text.rstrip(BLANK)
        blank, again = not shown, key in self.seen
        cut = not blank and not again and shown[-1] not in ".!?"
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += cut
        self.seen.add(key)
        self.dp.row(initial, blank or again, cut)
        self.open.append(row)
        self.rows += 1
        if self.rows % COMMIT_ROWS == 0:
            yield from self._told(self.dp.commit())

    def _told(self, nodes: list[Node]) -> Iterator[tuple[str, Row | None, str, str]]:
        for n in nodes:
            row = None if n.letter == "I" else self.open.popleft()
            if n.letter == "K":
                yield n.letter, row, row.role, row.text
            elif n.letter == "D":
                yield n.letter, row, "", ""
            else:
                yield n.letter, row, ROLE[n.state], row.text if row else ""

    def close(self) -> tuple[int, Iterator[tuple[str, Row | None, str, str]]]:
        cost, rest = self.dp.end()
        return cost, self._told(rest)


def _stream(df: DataFrame, conv: str, turn: str, role: str, text: str, gone: Column | None) -> DataFrame:
    """conv, key, turn, role, text, gone: whole conversations in one partition each, in order."""
    rows = df.select(
        F.col(conv).alias("conv"), F.col(conv).cast("string").alias("key"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
        (F.lit(False) if gone is None else gone).alias("gone"),
    )
    return rows.repartition("key").sortWithinPartitions("key", F.col("turn").asc_nulls_first(), "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, object, Row | None]]:
    """(whether a conversation begins, its id, its row or None) for each row."""
    last, begun = None, False
    for batch in batches:
        conv, key, turn, gone = (batch.column(i).to_pylist() for i in (0, 1, 2, 5))
        for i in range(batch.num_rows):
            new, last, begun = not begun or key[i] != last, key[i], True
            yield new, conv[i], None if gone[i] else Row(turn[i], batch.column(3)[i].as_py(), batch.column(4)[i].as_py())


def repair_report(df: DataFrame, conv: str, turn: str, role: str, text: str, gone: Column | None = None) -> DataFrame:
    """One row per conversation: counts of faults, cost and letters of its repair, SHA-256 of the repaired ``role:text`` lines.

    Rows for which ``gone`` holds only name their conversation.
    """
    kind = df.select(F.col(conv)).schema.fields[0].dataType
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = T.StructType([T.StructField(conv, kind), *[T.StructField(c, T.LongType()) for c in counts],
                           T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held, id_type = 0, None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field(0).type
                yield b

        def batch() -> pa.RecordBatch:
            kinds = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=schema.fieldNames())

        name, talk, digest, letters = None, None, None, []

        def take(edits) -> None:
            for letter, _, r, t in edits:
                letters.append(letter)
                if letter != "D":
                    digest.update(f"{digest_sep[0]}{r}:{t}".encode("utf-8", "surrogatepass"))
                    digest_sep[0] = "\n"

        def closed() -> None:
            cost, rest = talk.close()
            take(rest)
            out.append((name, talk.gaps, talk.blank, talk.duplicate, talk.truncated, talk.illegal, cost, "".join(letters), digest.hexdigest()))

        digest_sep = [""]
        for new, conv_id, row in _conversations(typed()):
            if new:
                if talk is not None:
                    closed()
                    held += 200 + len(letters)
                    if held > BATCH_CHARS:
                        yield batch()
                        out, held = [], 0
                name, talk, digest, letters = conv_id, Conversation(), hashlib.sha256(), []
                digest_sep[0] = ""
            if row is not None:
                take(talk.add(row))
        if talk is not None:
            closed()
            yield batch()

    return _stream(df, conv, turn, role, text, gone).mapInArrow(run, schema)


def repaired(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The repaired conversations: conversation, position from 0, edit (Keep, Rerole or Insert), turn (null if inserted), role, text."""
    kind = df.select(F.col(conv)).schema.fields[0].dataType
    fields = [(conv, kind), ("position", T.LongType()), ("edit", T.StringType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held, id_type, name, talk, position = 0, None, None, None, 0

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field(0).type
                yield b

        def take(edits) -> None:
            nonlocal position, held
            for letter, row, r, t in edits:
                if letter != "D":
                    out.append((name, position, letter, row.turn if row else None, r, t))
                    position, held = position + 1, held + 64 + len(t)

        def batch() -> pa.RecordBatch:
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=schema.fieldNames())

        for new, conv_id, row in _conversations(typed()):
            if new:
                if talk is not None:
                    take(talk.close()[1])
                name, talk, position = conv_id, Conversation(), 0
            take(talk.add(row))
            if held > BATCH_CHARS:
                yield batch()
                out, held = [], 0
        if talk is not None:
            take(talk.close()[1])
        if out:
            yield batch()

    return _stream(df, conv, turn, role, text, None).mapInArrow(run, schema)
