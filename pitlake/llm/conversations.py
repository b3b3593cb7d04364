"""Repair of damaged conversations by a Viterbi search whose survivors coalesce.

A repaired conversation has roles with initials (s?(ua)+)?: an optional system row, then user and assistant
in turns. The search walks a conversation's rows once, keeping for every state of that pattern the cheapest
way to reach it, the ASCII-least of equally cheap ones. Ways share a tree of backpointers; a node counts the
survivors and nodes that hang on it and goes when none is left. As soon as all survivors descend from one
node, the edits down to it are settled and leave the tree. What is held is the part on which survivors
still differ; ties are decided on that whole part, up to their common ancestor.

One exchange deals rows by conversation. Spark sorts them there (spilling where it must) and each task
streams through its rows, so a conversation is never gathered. That a conversation runs through one task in order
lies in the result: SHA-256 of its repaired text has no parallel form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

SPACE = b" \t\n\x0b\x0c\r"
#: States by what was written last: nothing, s, u, a. Entries: state after writing u or a, or None.
WRITE = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
ROLES = {"u": b"user", "a": b"assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5


class Node:
    """An edit in the backpointer tree. `held` counts children and survivors that end here."""

    __slots__ = ("parent", "edit", "role", "row", "held", "depth", "children")

    def __init__(self, parent, edit: str, role: bytes | None, row):
        self.parent, self.edit, self.role, self.row = parent, edit, role, row
        self.held, self.depth, self.children = 0, parent.depth + 1 if parent else 0, []
        if parent:
            parent.held += 1
            parent.children.append(self)


class Repair:
    """Cheapest edits of one conversation, emitted as (edit, role, row) once no survivor can change them.

    `role` is the role written, None for a deletion; `row` is what was pushed, None for an insertion.
    """

    def __init__(self):
        self.root = Node(None, "", None, None)
        self.best: list[tuple[int, Node] | None] = [(0, self.root), None, None, None]
        self.root.held = 1
        self.most = 0  # most nodes held at once
        self.nodes = 1

    def _less(self, a: Node, b: Node) -> bool:
        """Whether the edits down to a come before those down to b, by their whole parts below the common ancestor."""
        left, right = [], []
        while a is not b:
            if a.depth >= b.depth:
                left.append(a.edit)
                a = a.parent
            else:
                right.append(b.edit)
                b = b.parent
        return left[::-1] < right[::-1]

    def _offer(self, to: list, state: int, cost: int, node: Node) -> bool:
        """Let a way end in a state; the loser goes. A node that is offered is new or held elsewhere."""
        node.held += 1
        have = to[state]
        if have is not None and (have[0] < cost or (have[0] == cost and not self._less(node, have[1]))):
            self._drop(node)
            return False
        to[state] = (cost, node)
        if have is not None:
            self._drop(have[1])
        return True

    def _drop(self, node: Node) -> None:
        node.held -= 1
        while node.held == 0 and node.parent is not None:
            above = node.parent
            above.children.remove(node)
            above.held -= 1
            self.nodes -= 1
            node = above

    def _node(self, parent: Node, edit: str, role: bytes | None, row) -> Node:
        self.nodes += 1
        self.most = max(self.most, self.nodes)
        return Node(parent, edit, role, row)

    def _insertions(self, to: list) -> None:
        """Ways that insert rows here. Two in a row reach every state, a third would only go round."""
        for _ in range(2):
            for state in range(4):
                if to[state] is not None:
                    cost, node = to[state]
                    for initial, role in ROLES.items():
                        after = WRITE[state].get(initial)
                        if after is not None:
                            have = to[after]
                            if have is None or have[0] >= cost + INSERT:
                                self._offer(to, after, cost + INSERT, self._node(node, "I", role, None))

    def _settled(self) -> Iterator[tuple[str, bytes | None, object]]:
        while len(self.root.children) == 1 and self.root.held == 1:
            self.root = self.root.children[0]
            self.root.parent = None
            self.nodes -= 1
            yield self.root.edit, self.root.role, self.root.row
            self.root.row = None

    def push(self, role: bytes, faulty: bool, truncated: bool, row) -> Iterator[tuple[str, bytes | None, object]]:
        """One more row: faulty ones (blank or duplicate) must be deleted. Edits settled by it."""
        if not faulty:
            self._insertions(self.best)
        to: list[tuple[int, Node] | None] = [None] * 4
        extra = TRUNCATED if truncated else 0
        initial = role[:1].decode("latin-1")
        for state, way in enumerate(self.best):
            if way is None:
                continue
            cost, node = way
            self._offer(to, state, cost + DELETE, self._node(node, "D", None, row))
            if not faulty:
                for written, after in WRITE[state].items():
                    if written == initial:
                        self._offer(to, after, cost + KEEP + extra, self._node(node, "K", role, row))
                    elif written in ROLES:
                        self._offer(to, after, cost + REROLE + extra, self._node(node, "R", ROLES[written], row))
        for way in self.best:
            if way is not None:
                self._drop(way[1])
        self.best = to
        self._forget_dominated()
        return self._settled()

    def _forget_dominated(self) -> None:
        """All that may follow nothing or s may follow an assistant as well, a system row aside, which can go for 2."""
        after = self.best[3]
        if after is not None:
            for state, more in ((0, DELETE), (1, 0)):
                way = self.best[state]
                if way is not None and way[0] > after[0] + more:
                    self._drop(way[1])
                    self.best[state] = None

    def finish(self) -> tuple[int, Iterator[tuple[str, bytes | None, object]]]:
        """Cost of all edits, and those that were not settled yet."""
        self._insertions(self.best)
        ends = [(self.best[s][0], s) for s in ENDS if self.best[s] is not None]
        cost = min(c for c, _ in ends)
        last = None
        for c, s in ends:
            node = self.best[s][1]
            if c == cost and (last is None or self._less(node, last)):
                last = node
        for way in self.best:
            if way is not None and way[1] is not last:
                self._drop(way[1])
        rest = []
        while last is not None and last.parent is not None:
            rest.append((last.edit, last.role, last.row))
            last = last.parent
        return cost, iter(rest[::-1])


class Conversation:
    """Rows of one conversation in order: counts of faults, and its repair."""

    def __init__(self, key):
        self.key, self.repair = key, Repair()
        self.turns = self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.turn = self.role = None
        self.rows = 0

    def add(self, turn, role: bytes, text: bytes, seen: bool):
        """Edits that are settled after this row."""
        if turn is not None and turn != self.turn:
            self.distinct += 1
            self.first = turn if self.first is None else self.first
            self.turn = turn
        if self.rows and self.role[:1] + role[:1] not in (b"su", b"ua", b"au"):
            self.illegal += 1
        self.role, self.rows = role, self.rows + 1
        said = text.rstrip(SPACE)
        blank, open_end = not said, said[-1:] not in (b".", b"!", b"?")
        self.blank += blank
        self.duplicate += seen and not blank
        cut = open_end and not blank and not seen
        self.truncated += cut
        return self.repair.push(role, blank or seen, cut, (turn, text))

    @property
    def gaps(self) -> int:
        return self.turn - self.first + 1 - self.distinct if self.first is not None else 0


def said(c: str) -> Column:
    """A column as text; null is one space."""
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(key, turn, role, text, copies) with one fault in some rows; a dropped row has 0 copies, a repeated one 2.

    Nulls in role or text, and in the number that decides the fault, are read as one space.
    """
    fault = F.crc32(F.concat(said(key), F.lit(":"), said(turn)).cast("binary")) % 20
    body = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(said(text), ".!?", "")).otherwise(said(text))
    return rows.select(F.col(key).alias("key"), F.col(turn).cast("long").alias("turn"), F.when(fault == 4, F.lit("user")).otherwise(said(role)).alias("role"),
                       body.alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))


def whole(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """The same columns of rows as they are."""
    return rows.select(F.col(key).alias("key"), F.col(turn).cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"), F.lit(1).alias("copies"))


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows by conversation and turn, nulls first, then role and text; `seen` marks copies of an earlier row.

    Finding copies needs no exchange beyond the one by conversation.
    """
    same = Window.partitionBy("key", "role", "digest").orderBy(F.expr("copies = 0"), F.col("turn").asc_nulls_first())
    dealt = rows.withColumn("digest", F.sha2("text", 256)).repartition("key")
    return dealt.withColumn("seen", (F.row_number().over(same) > 1) & (F.col("copies") > 0)).drop("digest").sortWithinPartitions(
        F.col("key").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "seen").select(
        "key", "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), "copies", "seen")


def _conversations(batches: Iterator[pa.RecordBatch]):
    """(conversation, its edits so far) after every row, and at last (conversation, None)."""
    now: Conversation | None = None
    slices = (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256))
    for part in slices:
        for key, turn, role, text, copies, seen in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if now is None or key != now.key:
                if now is not None:
                    yield now, None
                now = Conversation(key)
            for k in range(copies):
                yield now, now.add(turn, role, text, seen or k > 0)
    if now is not None:
        yield now, None


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage: bool = False) -> DataFrame:
    """(key, place, edit, turn, role, text): every edit of every conversation in order; see `report` for the rules.

    edit is K, R, D or I; role and text are those of the repaired row, both null for a deletion. A
    conversation without rows has no edits. place counts from 0.
    """
    kind = rows.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, place long, edit string, turn long, role string, text string"
    ordered = _in_order((damaged if damage else whole)(rows, key, turn, role, text))

    def run(batches):
        types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = [key, "place", "edit", "turn", "role", "text"]
        out: list[tuple] = []
        size, place, of = 0, 0, None

        def flush():
            columns = zip(*out, strict=True) if out else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)

        for conversation, edits in _conversations(batches):
            if conversation is not of:
                of, place = conversation, 0
            for edit, written, row in edits if edits is not None else conversation.repair.finish()[1]:
                at, body = row or (None, b"")
                out.append((conversation.key, place, edit, at, None if written is None else written.decode(), None if written is None else body.decode()))
                place, size = place + 1, size + 64 + len(body)
                if size > 1 << 24:
                    yield flush()
                    out, size = [], 0
        yield flush()

    return ordered.mapInArrow(run, schema)


def report(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage: bool = False) -> DataFrame:
    """One row per key: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows come by turn, nulls first; rows of one turn by role and text. A row's first fault counts: blank (nothing
    but ASCII white space), duplicate (role and text seen earlier in the conversation), truncated (its last
    other character is not one of .!?). Keeping a row costs 0, another role 1, deleting 2, inserting an empty
    row 5; blank and duplicate rows must be deleted, truncated ones that stay cost 5 more. The cheapest edits that leave
    roles with initials (s?(ua)+)? are taken, the ASCII-least of equally cheap ones. illegal counts neighbours
    whose initials are not su, ua or au; gaps counts turn numbers that are missing between the first and last.

    Null roles and texts are one space; rows with a null key are a conversation of their own. Repeated rows are
    duplicates. With `damage`, rows are damaged first; a conversation that loses all rows has zeros, an
    empty audit and the hash of an empty text. An empty table gives no rows; extra columns are ignored.

    Memory: the edits on which survivors still differ, with their texts, and one character per row for the audit.
    A conversation built so that two ways stay equally cheap from its first to its last row is held whole.
    """
    kind = rows.schema[key].dataType
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = f"`{key}` {kind.simpleString()}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string"
    ordered = _in_order((damaged if damage else whole)(rows, key, turn, role, text))

    def run(batches):
        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in done], type=to_arrow_type(kind)), *(pa.array([r[1][i] for r in done], pa.int64()) for i in range(6)),
                 *(pa.array([r[i] for r in done], pa.string()) for i in (2, 3))], names=[key, *counts, "audit", "repaired_sha256"])

        done: list[tuple] = []
        of, size, total = None, 0, 0
        audit, digest, first = bytearray(), hashlib.sha256(), True
        for conversation, edits in _conversations(batches):
            if conversation is not of:
                of, audit, digest, first = conversation, bytearray(), hashlib.sha256(), True
            ended = edits is None
            if ended:
                total, edits = conversation.repair.finish()
            for edit, written, row in edits:
                audit += edit.encode()
                if written is not None:
                    digest.update((b"" if first else b"\n") + written + b":" + (b"" if row is None else row[1]))
                    first = False
            if ended:
                c = conversation
                done.append((c.key, (c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, total), audit.decode(), digest.hexdigest()))
                size += 200 + len(audit)
                if size > 1 << 22:
                    yield flush()
                    done, size = [], 0
        yield flush()

    return ordered.mapInArrow(run, schema)
