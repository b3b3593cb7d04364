"""N-gram Jaccard join: size-aware heavy-light set similarity join on word shingles.

Sets are hashed word shingles. Each set looks only at its rarest shingles (a prefix, by exact document
frequency): two sets of similarity s share at least c of the first n - ceil(s n) + c. Small ("light")
sets enumerate the c = 2 subsets of that prefix and meet by equal subset; large ("heavy") sets put
single shingles into inverted lists. The size at which enumeration becomes dearer than scanning is
chosen from summed costs. Lists only say which sets have to be looked at together: small connected groups
share a task, a large group is dealt into blocks so that sets that meet mostly stand together, and
two of its blocks are looked at together only where some key has sets in both. A task scans its sets by
inverted lists, which gives the exact overlap of all its pairs. Pairs stay inside the task; it emits link
counts and a spanning forest.

Exact frequencies cost one packed shuffle: hashes travel as sorted binary blobs per hash bucket, and
only shingles that at least two sets have come back. A set with no such shingle in its prefix can have
no link and goes no further. Shingles are compared as 50-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.functions.landing import land
from pitlake.llm.graph import components
from pitlake.llm.words import U64, mix, shingles, texts, words

#: Bits of a shingle's hash. The gaps of a chunk's sorted hashes then fill four bytes; two given documents
#: of n shingles each confuse two of them with a chance of n * n / 2^50.
BITS = 50
_DROP = U64(64 - BITS)
SUBSET = 2
BLOCK = 256
SCAN = 2048  # list entries that a task scans (a few ns each) in the time of shuffling one row (a few us)
_MAX_ROWS = 1 << 15  # rows of a chunk fit in 16 bits
_PACK = np.dtype([("v", "u8"), ("df", "u4"), ("row", "u2")])
_TABLE = np.dtype([("id", "i8"), ("known", "?"), ("n", "i8"), ("p", "u8"), ("q", "u8"), ("lead", "?")])


def _planes(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as byte planes of their gaps, which the shuffle's compression packs."""
    gaps = np.diff(values, prepend=U64(0))
    return gaps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(blob: bytes) -> np.ndarray:
    gaps = np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(U64).ravel()
    return np.cumsum(gaps, dtype=U64)


_CHUNK = pa.schema([("dest", pa.int64()), ("chunk", pa.int64()), ("values", pa.binary()), ("rows", pa.binary()),
                    ("ids", pa.binary())])
_CHUNK_SQL = "dest long, chunk long, values binary, rows binary, ids binary"


def _chunks(width: int, buckets: int):
    """Documents -> per chunk one row of its documents (dest -1 - bucket) and a blob per hash bucket."""

    def run(batches):
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0)
            known = np.asarray(ids.is_valid())
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo in range(0, len(batch), _MAX_ROWS):
                hi = min(len(batch), lo + _MAX_ROWS)
                group, size, done = [], 0, lo
                for a, b, data, offsets in texts(batch.column(1).slice(lo, hi - lo)):
                    w = words(data, offsets, "space")
                    for r in range(b - a):
                        own = w.hash[w.first[r] : w.first[r + 1]]
                        if len(own) >= width:
                            own = np.unique(shingles(own, width) >> _DROP)
                        elif len(own):
                            own = mix(shingles(own, len(own)) + U64(len(own))) >> _DROP
                        group.append(own)
                    size += len(data)
                    if size >= 1 << 24:
                        yield from _emit(group, ids[done : lo + b], known[done : lo + b], (part << 32) + count, buckets)
                        group, size, done, count = [], 0, lo + b, count + 1
                if group:
                    yield from _emit(group, ids[done:hi], known[done:hi], (part << 32) + count, buckets)
                    count += 1

    return run


def _emit(sets, ids, known, chunk, buckets):
    n = np.array([len(s) for s in sets], np.int64)
    prints = np.zeros((len(sets), 2), U64)
    first: dict = {}
    with np.errstate(over="ignore"):
        for i, s in enumerate(sets):
            if len(s):
                prints[i] = s.sum(dtype=U64), mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64)
    lead = np.zeros(len(sets), bool)  # the smallest id of equal sets in this chunk speaks for them
    for i in np.argsort(ids, kind="stable"):
        if n[i] and known[i] and first.setdefault((n[i], *prints[i]), i) == i:
            lead[i] = True
    table = np.rec.fromarrays([ids, known, n, prints[:, 0], prints[:, 1], lead],
                              dtype=_TABLE)
    out = [(-1 - chunk % buckets, chunk, None, None, table.tobytes())]
    rows = np.flatnonzero(lead)
    if len(rows):
        every = np.concatenate([sets[i] for i in rows])
        owner = np.repeat(rows, n[rows]).astype(np.uint16)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        cuts = np.searchsorted(every, [U64((k << BITS) // buckets) for k in range(buckets)]).tolist() + [len(every)]
        for k in range(buckets):
            a, b = cuts[k], cuts[k + 1]
            if b > a:
                out.append((k, chunk, _planes(every[a:b]), owner[a:b].tobytes(), None))
    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _CHUNK, strict=True)], schema=_CHUNK)


def _count_bucket(table: pa.Table) -> pa.Table:
    """Frequencies of one hash bucket; goes back to the chunks: shared values, owners, frequencies."""
    passed = table.filter(pc.less(table["dest"], 0))
    table = table.filter(pc.greater_equal(table["dest"], 0))
    out = [(c, None, None, i) for c, i in zip(passed["chunk"].to_pylist(), passed["ids"].to_pylist(), strict=True)]
    if len(table):
        parts = [_unplanes(b.as_py()) for b in table["values"]]
        size = [len(p) for p in parts]
        rows = np.concatenate([np.frombuffer(b.as_py(), np.uint16) for b in table["rows"]])
        values = np.concatenate(parts)
        del parts
        order = np.argsort(values, kind="stable")
        values = values[order]
        heads = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        times = np.diff(np.append(heads, len(values)))
        shared = np.repeat(times > 1, times)
        order, values = order[shared], values[shared]
        times = times[times > 1]
        df = np.repeat(times, times).astype(np.uint32)
        cuts = np.cumsum([0, *size])
        source = np.searchsorted(cuts, order, "right") - 1
        back = np.argsort(source, kind="stable")
        pack = np.rec.fromarrays([values[back], df[back], rows[order[back]]], dtype=_PACK)
        ends = np.searchsorted(source[back], np.arange(len(size) + 1))
        out += [(c, pack[a:b].tobytes(), None, None) for c, a, b in zip(table["chunk"].to_pylist(), ends[:-1], ends[1:], strict=True) if b > a]
    cols = list(zip(*out)) if out else [(), (), (), ()]
    return pa.Table.from_arrays(
        [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[3], pa.binary())],
        names=["chunk", "shared", "ids"])


_SETS_SQL = "doc long, n long, p long, q long, lead boolean, prefix binary, freq binary, last boolean, shared binary"


def _need(n: np.ndarray | int, percent: int):
    """Smallest overlap with any partner: ceil(percent / 100 * n)."""
    return -(-percent * n // 100)


def _assemble(percent: int):
    """One chunk: every document with its shared shingles and the shared part of its prefix."""

    def run(table: pa.Table) -> pa.Table:
        packs = [np.frombuffer(b.as_py(), _PACK) for b in table["shared"] if b.is_valid]
        docs = np.concatenate([np.frombuffer(b.as_py(), _TABLE) for b in table["ids"] if b.is_valid])
        pack = np.concatenate(packs) if packs else np.zeros(0, _PACK)
        pack = pack[np.lexsort((pack["v"], pack["df"], pack["row"]))]
        cuts = np.searchsorted(pack["row"], np.arange(len(docs) + 1))
        n = docs["n"]
        left = n - _need(n, percent) + SUBSET - (n - np.diff(cuts))  # of the prefix, after unshared ones
        prefix, freq, last, shared = [], [], [], []
        for i in range(len(docs)):
            a, b = cuts[i], cuts[i + 1]
            if b > a and left[i] > 0:
                head = pack[a : min(b, a + left[i])]
                prefix.append(head["v"].tobytes())
                freq.append(head["df"].tobytes())
                last.append(bool(left[i] <= b - a))  # its last entry is beyond the one-shingle prefix
                shared.append(np.sort(pack["v"][a:b]).tobytes())
            else:
                prefix.append(None), freq.append(None), last.append(None), shared.append(None)
        return pa.Table.from_arrays(
            [pa.array(docs["id"], mask=~docs["known"]), pa.array(n), pa.array(docs["p"].astype(np.int64)),
             pa.array(docs["q"].astype(np.int64)), pa.array(docs["lead"]), pa.array(prefix, pa.binary()),
             pa.array(freq, pa.binary()), pa.array(last, pa.bool_()), pa.array(shared, pa.binary())],
            names=["doc", "n", "p", "q", "lead", "prefix", "freq", "last", "shared"])

    return run


def _spoken(prefix, freq, copies):
    """Prefix entries that another set has too: more sets than this one's own copies count them."""
    v, f = np.frombuffer(prefix, U64), np.frombuffer(freq, np.uint32)
    keep = f > copies
    return v[keep], f[keep], keep


def _size_class(n: int) -> int:
    return int(4 * math.log2(n))


def _costs(batches):
    """Per size class: rows of enumerated subsets, against list rows and the entries their lists hold."""
    for batch in batches:
        rows = []
        for n, prefix, freq, copies in zip(*(batch.column(k).to_pylist() for k in ("n", "prefix", "freq", "copies")), strict=True):
            v, f, _ = _spoken(prefix, freq, copies)
            rows.append((_size_class(n), SCAN * (len(v) * (len(v) - 1) // 2), SCAN * len(v) + int(f.sum())))
        cols = list(zip(*rows)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["size", "light", "heavy"])


def _keys(boundary: int, percent: int):
    """Sets -> (key, doc): 2-subsets of light prefixes, single shingles of heavy ones and of those near.

    Near: a partner may be as many size classes larger as the similarity allows. Sets that may share a
    single shingle with a partner are in the lists too.
    """
    span = math.ceil(4 * math.log2(100 / percent))

    def run(batches):
        for batch in batches:
            keys, docs = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
            for doc, n, prefix, freq, last, copies in zip(
                *(batch.column(k).to_pylist() for k in ("doc", "n", "prefix", "freq", "last", "copies")), strict=True
            ):
                v, _, keep = _spoken(prefix, freq, copies)
                if _size_class(n) <= boundary and n >= SUBSET:
                    s = np.sort(v)
                    i, j = np.triu_indices(len(s), 1)
                    with np.errstate(over="ignore"):
                        keys.append(mix(mix(s[i] + U64(1)) ^ s[j]))
                    docs.append(np.full(len(i), doc))
                if _need(n, percent) < SUBSET or _size_class(n) > boundary - span:
                    if last and keep[-1] and _need(n, percent) >= SUBSET:
                        v = v[:-1]
                    keys.append(v)
                    docs.append(np.full(len(v), doc))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(docs).astype(np.int64))],
                names=["key", "doc"])

    return run


def _verify(percent: int):
    """Exact overlaps of a block of sets, or of two blocks, by scanning their inverted lists."""

    def run(table: pa.Table) -> pa.Table:
        doc = table["doc"].to_numpy()
        n, weight, side = table["n"].to_numpy(), table["members"].to_numpy(), table["side"].to_numpy()
        parts = [np.frombuffer(b.as_py(), U64) for b in table["shared"]]
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        values = np.concatenate(parts)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        heads = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        length = np.diff(np.append(heads, len(values)))
        k = len(doc)
        overlap = np.zeros((k, k), np.int32)
        for size in np.unique(length[length > 1]):
            at = heads[length == size]
            if size <= 16:
                lists = owner[at[:, None] + np.arange(size)]
                for i in range(size):
                    for j in range(i + 1, size):
                        x, y = lists[:, i], lists[:, j]
                        np.add.at(overlap, (np.minimum(x, y), np.maximum(x, y)), 1)
            else:
                for a in at:
                    m = owner[a : a + size]
                    overlap[m[:, None], m] += 1
        overlap = np.maximum(overlap, overlap.T)
        link = 100 * overlap.astype(np.int64) >= percent * (n[:, None] + n - overlap)
        link &= (doc[:, None] != doc) & (overlap > 0)
        if side.any() and not side.all():  # two blocks: pairs within one are another task's
            link &= side[:, None] != side
        partners = link @ weight
        seen, forest = np.zeros(k, bool), []
        for i in range(k):
            if not seen[i]:
                seen[i], stack = True, [i]
                while stack:
                    x = stack.pop()
                    new = np.flatnonzero(link[x] & ~seen)
                    seen[new] = True
                    forest += [(doc[x], doc[y], 0) for y in new]
                    stack += new.tolist()
        rows = [(d, None, int(p)) for d, p in zip(doc, partners, strict=True) if p] + forest
        cols = list(zip(*rows)) if rows else [(), (), ()]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "n_links"])

    return run


def _block_pairs(lists: DataFrame, heads: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Large groups -> (doc, block) and (i, j), the pairs of blocks, i <= j, where some key has sets in both.

    A group's sets are dealt by the smallest set they share a key with, in equal ranges of it, so the sets of
    a list mostly stand together and a long chain of sets meets few blocks. A range that holds more than a
    block is split by a hash. A group of n sets has at most about 2 n / BLOCK blocks.
    """
    near = lists.join(heads, "key").groupBy("doc").agg(F.min("head").alias("near"))
    placed = large.select(F.col("node").alias("doc"), "component", "size").join(near, "doc")
    ends = placed.groupBy("component").agg(F.min("near").cast("double").alias("lo"), F.max("near").cast("double").alias("hi"))
    share = (F.col("near").cast("double") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1)
    placed = land(placed.join(ends, "component").select(
        "doc", "component", F.floor(share * F.ceil(F.col("size") / BLOCK)).alias("range")), "shingle-ranges")
    held = placed.groupBy("component", "range").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    blocks = land(placed.join(held, ["component", "range"]).select(
        "doc", F.xxhash64("component", "range", F.pmod(F.xxhash64("doc"), F.col("parts"))).alias("block")), "shingle-blocks")
    on = lists.join(heads.select("key"), "key").join(blocks, "doc").select("key", "block").distinct()
    met = on.withColumnRenamed("block", "i").join(on.withColumnRenamed("block", "j"), "key").where("i <= j")
    return blocks, met.select("i", "j").distinct()


def _boundary(sets: DataFrame) -> int:
    """Size class up to which enumerating subsets costs less than scanning lists; at most ~70 rows come here."""
    cost = sets.mapInArrow(_costs, "size long, light long, heavy long").groupBy("size").agg(
        F.sum("light").alias("light"), F.sum("heavy").alias("heavy")).collect()
    total = sum(r.heavy for r in cost)
    best, at = total, -1
    for r in sorted(cost, key=lambda r: r.size):
        total += r.light - r.heavy
        if total < best:
            best, at = total, r.size
    return at


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: key, n_shingles, component_id, n_links.

    Two documents are linked when 100 * |A and B| >= percent * |A or B| over their distinct shingles of
    width words; a text with fewer words is one shingle, one without words (or null) has an empty set and
    no links. component_id is the smallest key reachable by links, itself included; n_links counts linked
    documents. Rows that repeat a key are one node. A null key is returned with its n_shingles, a null
    component and no links. Extra columns are ignored, whatever they are called. Empty in, empty out.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = land(
        plain.mapInArrow(_chunks(width, buckets), _CHUNK_SQL)
        .withColumn("bucket", F.when(F.col("dest") < 0, -1 - F.col("dest")).otherwise(F.col("dest")))
        .groupBy("bucket").applyInArrow(lambda t: _count_bucket(t.select(_CHUNK.names)), "chunk long, shared binary, ids binary")
        .groupBy("chunk").applyInArrow(_assemble(percent), _SETS_SQL),
        "shingle-sets",
    )
    mark = ["n", "p", "q"]
    classes = sets.where("n > 0 and doc is not null").groupBy(*mark).agg(
        F.min("doc").alias("rep"), F.countDistinct("doc").alias("members"),
        F.count(F.when(F.col("lead"), 1)).alias("copies"))
    nodes = land(
        sets.where("lead and prefix is not null").join(classes, mark).where("doc = rep")
        .dropDuplicates(["doc", *mark]).select("doc", "n", "prefix", "freq", "last", "shared", "copies", "members"),
        "shingle-nodes",
    )
    narrow = nodes.select("doc", "n", "prefix", "freq", "last", "copies")
    lists = narrow.mapInArrow(_keys(_boundary(narrow), percent), "key long, doc long")
    heads = lists.groupBy("key").agg(F.min("doc").alias("head"), F.max("doc").alias("tail")).where("head < tail")
    groups = components(lists.join(heads, "key").select(F.col("doc").alias("a"), F.col("head").alias("b")))
    groups = land(groups.join(groups.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component"), "shingle-groups")
    small = groups.where(F.col("size") <= 2 * BLOCK)
    bins = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(2 * BLOCK)))
    n_bins = int(small.select(bins).first()[0])
    blocks, pairs = _block_pairs(lists, heads, groups.where(F.col("size") > 2 * BLOCK))
    ends = pairs.select(F.col("i").alias("block"), "i", "j").unionByName(
        pairs.where("i < j").select(F.col("j").alias("block"), "i", "j"))
    tasks = small.select(
        F.col("node").alias("doc"), F.pmod(F.xxhash64("component"), F.lit(n_bins)).alias("i"),
        F.lit(None).cast("long").alias("j"), F.lit(False).alias("side"),
    ).unionByName(blocks.join(ends, "block").select("doc", "i", "j", (F.col("block") != F.col("i")).alias("side")))
    dealt = nodes.select("doc", "n", "shared", "members").join(tasks, "doc").select(
        F.struct("i", "j").alias("task"), "doc", "n", "members", "side", "shared")
    found = land(dealt.groupBy("task").applyInArrow(lambda t: _verify(percent)(t), "a long, b long, n_links long"), "shingle-links")
    # A key that repeats with other texts ties the classes of its rows together.
    repeated = sets.where("doc is not null").join(classes, mark).groupBy("doc").agg(
        F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    joined = components(found.where("b is not null").select("a", "b").unionByName(repeated.select("a", "b")))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n_links").alias("n_links"))
    classes = (
        classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").join(counts.withColumnRenamed("a", "rep"), "rep", "left")
        .select(*mark, F.coalesce("component", "rep").alias("c"), (F.coalesce("n_links", F.lit(0)) + F.col("members") - 1).alias("l"))
    )
    return sets.select("doc", *mark).join(classes, mark, "left").select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), F.coalesce("c", "doc")).alias("component_id"),
        F.when(F.col("doc").isNull(), 0).otherwise(F.coalesce("l", F.lit(0))).alias("n_links"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Documents without the copies: of each linked group the smallest key stays. Null keys and empty texts stay."""
    gone = jaccard_join(docs, key, text, width, percent).where(f"{key} <> component_id").select(F.col(key).alias("_gone"))
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")
