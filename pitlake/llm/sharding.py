"""Shards of equal bytes by a histogram sort, in DataFrame functions only.

Rows are ordered by (hash of the text, hash of the key, row number), so equal texts lie together. Shard
boundaries are found by counting, not by sorting: every round deals the part of the key space around each
unresolved boundary into even cells, sums bytes per cell over all partitions (map-side combined, a few
hundred rows for the driver), and keeps the one cell that the boundary's target falls into. A boundary
is settled as soon as an edge of a cell lies within the tolerance of its target. An edge between two
hashes of texts never parts equal texts; only where a group of copies is itself too large does the search
go on inside it, by the hash of the key and at last by row number, down to single rows.

After that every row knows its shard by comparing itself with the boundaries, and one exchange numbers
the rows of each shard: shards are cut into pieces of bounded size by a hash of the row, each piece starts
after those before it. So neither a hot text nor a whole shard meets in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.functions.landing import land

#: Parts of the sort key, each a number from 0 to 2^63 - 1.
PARTS = ("_h", "_d", "_r")
#: Cells per unresolved boundary and round.
CELLS = 1024
#: Rows, and bytes of text, of a shard that are numbered and written in one task, about.
PIECE_ROWS, PIECE_BYTES = 1 << 20, 1 << 29


@dataclass
class Boundary:
    """A shard boundary and the cell it still lies in: the keys that begin with `prefix` and go on in [low, high]."""

    target: int
    below: int  # bytes before the cell
    prefix: tuple[int, ...] = ()
    low: int = 0
    high: int = 2**63 - 1
    #: Once settled: rows with a key below this one belong to earlier shards.
    key: tuple[int, ...] | None = field(default=None)

    @property
    def cell(self) -> tuple:
        return (self.prefix, self.low, self.high)

    @property
    def width(self) -> int:
        return -(-(self.high - self.low + 1) // CELLS)


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """Size, crc32 and sort key of every row; with `keep` all columns as well, gathered in one struct."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = [F.col(key).alias("_key"), (F.octet_length(body) + 1).cast("long").alias("_size"), F.crc32(body.cast("binary")).alias("_crc"),
           F.shiftrightunsigned(F.xxhash64(body), 1).alias("_h"), F.shiftrightunsigned(F.xxhash64(F.col(key)), 1).alias("_d"),
           F.monotonically_increasing_id().alias("_r")]
    return docs.select(*own, *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")] if keep else []))


def _under(prefix: tuple[int, ...]) -> Column:
    held = F.lit(True)
    for name, value in zip(PARTS, prefix, strict=False):
        held = held & (F.col(name) == value)
    return held


def _counts(rows: DataFrame, cells: list[Boundary]) -> dict[int, list]:
    """Per cell: (number of the slice, bytes, rows, least and largest key in it), ascending. One pass over the rows."""
    which, slot, own = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long")
    for i, b in enumerate(cells):
        name = PARTS[len(b.prefix)]
        inside = _under(b.prefix) & F.col(name).between(b.low, b.high)
        which = F.when(inside, F.lit(i)).otherwise(which)
        slot = F.when(inside, F.expr(f"({name} - {b.low}L) div {b.width}L")).otherwise(slot)
        own = F.when(inside, F.col(name)).otherwise(own)
    found = rows.select(which.alias("i"), slot.alias("s"), own.alias("k"), "_size").where("i is not null").groupBy("i", "s").agg(
        F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("k").alias("low"), F.max("k").alias("high"))
    out: dict[int, list] = {}
    for r in found.collect():  # at most CELLS rows per unresolved boundary
        out.setdefault(r.i, []).append((r.s, r.bytes, r.n, r.low, r.high))
    return {i: sorted(v) for i, v in out.items()}


def _narrowed(b: Boundary, slices: list, tolerance: float) -> Boundary:
    """The boundary with the slice its target falls into, or settled at one of that slice's edges."""
    below = b.below
    for _, size, n, low, high in slices:
        if below + size >= b.target:
            break
        below += size
    before, after = b.target - below, below + size - b.target
    if n == 1 or min(before, after) <= tolerance:
        b.key = (*b.prefix, low) if before <= after else (*b.prefix, high + 1)
        return b
    if low == high:
        return Boundary(b.target, below, (*b.prefix, low))
    return Boundary(b.target, below, b.prefix, low, high)


def boundaries(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, ...]]:
    """First key of every shard but the first, each a prefix of the sort key. `tolerance` is a share of a shard's bytes."""
    total = rows.agg(F.sum("_size")).first()[0] or 0
    open_ = [Boundary(total * i // shards, 0) for i in range(1, shards)] if total else []
    done: list[Boundary] = []
    while open_:
        cells = {b.cell: b for b in open_}  # boundaries that share a cell share its counts
        counts = _counts(rows, list(cells.values()))
        by_cell = {c: counts[i] for i, c in enumerate(cells)}
        moved = [_narrowed(b, by_cell[b.cell], tolerance * total / shards) for b in open_]
        done += [b for b in moved if b.key is not None]
        open_ = [b for b in moved if b.key is None]
    return [b.key for b in sorted(done, key=lambda b: b.target)]


def _reaches(bound: tuple[int, ...]) -> Column:
    """Whether the row's key is not below the boundary's."""
    held = F.lit(True)
    for name, value in reversed(list(zip(PARTS, bound, strict=False))):
        held = (F.col(name) > value) | ((F.col(name) == value) & held) if value < 2**63 else F.lit(False)
    return held


def placed(rows: DataFrame, shards: int, tolerance: float) -> DataFrame:
    """Landed keyed rows with _shard and _slot."""
    shard = F.lit(0)
    for bound in boundaries(rows, shards, tolerance):
        shard = shard + _reaches(bound).cast("int")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("bytes")).first()
    pieces = 1 + max(size.n // (PIECE_ROWS * shards), (size.bytes or 0) // (PIECE_BYTES * shards))
    dealt = rows.withColumn("_shard", shard).withColumn("_piece", F.pmod(F.xxhash64("_r"), F.lit(pieces)).cast("int"))
    before = dealt.groupBy("_shard", "_piece").agg(F.count(F.lit(1)).alias("_n")).select(
        "_shard", "_piece", F.expr("sum(_n) over (partition by _shard order by _piece) - _n").alias("_before"))
    return dealt.withColumn("_own", F.expr("row_number() over (partition by _shard, _piece order by _h, _d, _r)")).join(
        before, ["_shard", "_piece"]).withColumn("_slot", F.col("_before") + F.col("_own") - 1)


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", tolerance: float = 0.005) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row under the law `bytes`.

    Size is the text's UTF-8 bytes plus 1. Every boundary between shards lies within `tolerance` of a shard's
    bytes from its place, or else at the edge of a row that is nearest to it, so a shard is off by at most the larger of
    2 * tolerance and one row. Equal texts share a shard unless that would break the law. Slots count from 0
    in each shard. grown_shard is null: a further shard moves every boundary.

    A null text is like an empty one: size 1, crc32 0. Null keys and repeated rows are rows like any other; those
    equal in key and text are told apart by their number in the landed table. An empty table gives no
    rows. Extra columns are ignored, whatever their names.
    """
    rows = placed(land(keyed(docs, key, text), "keys"), shards, tolerance)
    return rows.select(F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                       F.col("_shard").alias("shard"), F.col("_slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, key: str = "doc_id", text: str = "text", tolerance: float = 0.005) -> DataFrame:
    """Whole rows written to path/shard=N, ordered by slot within a file; returns what was written, read back.

    All columns are kept; a column of docs named shard or slot gives way to the operator's. Edge cases as in `shard`.
    """
    rows = placed(land(keyed(docs, key, text, keep=True), "rows"), shards, tolerance)
    own = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("shard", "slot")]
    out = rows.select(*own, F.col("_slot").cast("long").alias("slot"), F.col("_shard").alias("shard"))
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)
