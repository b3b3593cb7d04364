"""Line dedup: repeated runs of lines found through a suffix array over line ids, DataFrame functions only.

Each document is its sequence of non-blank lines; a line's id is a 128-bit hash. Lines seen once in the
corpus cannot repeat, so only stretches of repeated lines are sorted. Prefix doubling refines the order:
round k ranks every suffix by its first 2^k lines, as (first line, suffixes of that group before it). A
rank moves by a window over the distinct (rank, rank 2^k lines on) pairs of a group, counted before the
shuffle, so a line that a third of the corpus has costs its distinct continuations, not its copies.

Two runs of m lines are equal when their first and their last 2^k lines have equal ranks, with 2^k <= m <
2^(k+1): they lie in one longest-common-prefix interval of depth m. A run counts from min_words words on.
Every such run is covered by the shortest ones that begin or end at each of its lines; each of those keeps
its first place in the corpus and is deleted at all later ones, and what is deleted together is the
maximal repeated run. As no line is blank, a shortest run has at most min_words lines, which bounds the
rounds and every frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.functions.landing import land

_DOC = ["d", "th"]
_INK = r"[^ \t\n\x0B\f\r]"


def _identity(key: str, text: str) -> list:
    """Columns that tell documents apart and order them; a null key comes first."""
    return [F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th")]


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(d, th, seq, line_no, h1, h2, words) of every non-blank line."""
    line = F.filter(F.transform(F.split(F.col(text), "\n", -1), lambda x, i: F.struct(i.alias("no"), x.alias("line"))), lambda s: s["line"].rlike(_INK))
    return docs.select(*_identity(key, text), F.posexplode(line).alias("seq", "x")).select(
        *_DOC, "seq", F.col("x.no").alias("line_no"), F.xxhash64("x.line").alias("h1"), F.xxhash64(F.lit(1), "x.line").alias("h2"),
        F.regexp_count("x.line", F.lit(_INK + "+")).alias("words"))


def _repeated(lines: DataFrame) -> DataFrame:
    """Lines that the corpus has more than once, each with the stretch of such lines it stands in."""
    often = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    own = lines.join(often, ["h1", "h2"], "left_semi").dropDuplicates([*_DOC, "seq"])
    return own.withColumn("stretch", F.expr("seq - row_number() over (partition by d, th order by seq)")).withColumn(
        "ranks", F.array(F.lit(0).cast("long")))


def _double(rows: DataFrame, step: int) -> DataFrame:
    """Ranks by twice as many lines: order each group by the rank of what follows step lines on."""
    group = ["h1", "h2", "o"]
    rows = rows.withColumn("o", F.element_at("ranks", -1)).withColumn("next", F.expr(
        "max(struct(h1, h2, o)) over (partition by d, th, stretch order by seq"
        f" range between {step} following and {step} following)"))
    then = ["more", "n1", "n2", "n3"]  # a stretch that ends comes before one that goes on
    rows = rows.withColumn("more", F.col("next").isNotNull())
    for name, field in zip(then[1:], group, strict=True):
        rows = rows.withColumn(name, F.coalesce(F.col("next")[field], F.lit(0)))
    pairs = rows.groupBy(*group, *then).agg(F.count(F.lit(1)).alias("n"))
    moved = pairs.withColumn("new", F.expr("o + sum(n) over (partition by h1, h2, o order by more, n1, n2, n3) - n")).drop("n")
    return rows.join(moved, [*group, *then]).select(
        *_DOC, "seq", "line_no", "h1", "h2", "words", "stretch", F.concat("ranks", F.array("new")).alias("ranks"))


def suffix_ranks(docs: DataFrame, key: str, text: str, depth: int) -> DataFrame:
    """Repeated lines with their suffix's rank by the first 1, 2, 4 ... lines, up to depth."""
    rows, step = land(_repeated(_lines(docs, key, text)), "lines"), 1
    while 2 * step <= depth:
        rows, step = land(_double(rows, step), "ranks"), 2 * step
    return rows


def _shortest_runs(rows: DataFrame, min_words: int) -> DataFrame:
    """(d, th, start, m): the shortest runs of min_words words that begin, or end, at each line."""
    def reach(words):
        full = F.aggregate(
            words, F.struct(F.lit(0).alias("m"), F.lit(0).alias("w")),
            lambda a, x: F.when(a["w"] >= min_words, a).otherwise(F.struct((a["m"] + 1).alias("m"), (a["w"] + x).alias("w"))))
        return F.when(full["w"] >= min_words, full["m"])

    frame = "over (partition by d, th, stretch order by seq rows between {} and {})"
    ahead = F.expr("collect_list(words) " + frame.format("current row", f"{min_words - 1} following"))
    back = F.expr("collect_list(words) " + frame.format(f"{min_words - 1} preceding", "current row"))
    runs = rows.select(*_DOC, "seq", ahead.alias("ahead"), back.alias("back")).select(
        *_DOC, "seq", reach(F.col("ahead")).alias("f"), reach(F.reverse("back")).alias("b"))
    return runs.select(*_DOC, F.explode(F.array(
        F.struct(F.col("seq").alias("start"), F.col("f").alias("m")),
        F.struct((F.col("seq") - F.col("b") + 1).alias("start"), F.col("b").alias("m")))).alias("r")).select(
        *_DOC, "r.start", "r.m").where("m is not null").distinct()


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """(d, th, gone): for each document with later copies of runs, the sorted numbers of its deleted lines."""
    ranks = suffix_ranks(docs, key, text, min_words)
    runs = _shortest_runs(ranks, min_words).withColumn("k", F.floor(F.log2("m") + F.lit(1e-9)).cast("int"))
    at = ranks.select(*_DOC, "seq", "h1", "h2", "ranks")
    head = at.select(*_DOC, F.col("seq").alias("start"), F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("ranks").alias("a"))
    tail = at.select(*_DOC, F.col("seq").alias("last"), F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("ranks").alias("b"))
    named = land(
        runs.join(head, [*_DOC, "start"]).withColumn("last", F.expr("start + m - shiftleft(1, k)").cast("int")).join(tail, [*_DOC, "last"])
        .select(*_DOC, "start", "m", "a1", "a2", F.expr("a[k]").alias("a3"), "b1", "b2", F.expr("b[k]").alias("b3")),
        "runs",
    )
    name = ["m", "a1", "a2", "a3", "b1", "b2", "b3"]
    place = F.struct("d", "start", "th")
    first = named.groupBy(*name).agg(F.min(place).alias("first"), F.max(place).alias("final")).where("first < final").drop("final")
    later = named.join(first, name).where(F.struct("d", "start", "th") > F.col("first"))
    gone = later.select(*_DOC, F.explode(F.expr("sequence(start, start + m - 1)")).alias("seq")).distinct()
    return gone.join(ranks.select(*_DOC, "seq", "line_no"), [*_DOC, "seq"]).groupBy(*_DOC).agg(F.sort_array(F.collect_list("line_no")).alias("gone"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """All columns of docs with the text's later copies of line runs taken out, and n_lines, n_removed.

    A run of consecutive non-blank lines with at least min_words words that stands earlier in the corpus, by
    (key, line), is deleted; a run may overlap its earlier place. Blank lines are skipped in comparing and
    stay. A null text stays null with 0 lines, an empty one has one blank line. A null key comes before all
    others; rows that repeat a key and text count once and get the same result; rows that repeat a key with
    another text are ordered by the text's hash where their lines tie. Other columns pass through, whatever
    they are called but for n_lines and n_removed, which are replaced. An empty table gives no rows.
    """
    gone = repeated_lines(docs, key, text, min_words)
    own = docs.drop("n_lines", "n_removed")
    at, drop = (_unused(own, name) for name in ("_at", "_gone"))
    own = own.select("*", F.struct(*_identity(key, text)).alias(at))
    gone = gone.select(F.struct(*_DOC).alias(at), F.col("gone").alias(drop))
    lines = F.split(F.col(text), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(drop, i)), "\n")
    return own.join(gone, at, "left").withColumns({
        "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)),
        "n_removed": F.coalesce(F.size(drop), F.lit(0)),
        text: F.when(F.col(drop).isNull(), F.col(text)).otherwise(kept),
    }).drop(at, drop)


def _unused(df: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name
