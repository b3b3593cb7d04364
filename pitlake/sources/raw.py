"""Scans, sinks and source verification."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.functions.scalar import clean_id, parse_date, to_number
from pitlake.operators.contracts import ContractError

# Required raw columns per study table (extra columns are ignored).
RAW_SCHEMAS: dict[str, tuple[str, ...]] = {
    "competitions": ("competition_id", "competition_code", "type"),
    "games": (
        "game_id",
        "competition_id",
        "season",
        "date",
        "home_club_id",
        "away_club_id",
        "home_club_goals",
        "away_club_goals",
    ),
    "appearances": (
        "appearance_id",
        "game_id",
        "player_id",
        "player_club_id",
        "competition_id",
        "date",
        "goals",
        "assists",
        "minutes_played",
        "yellow_cards",
        "red_cards",
    ),
    "game_lineups": ("game_id", "player_id", "position"),
    "players": ("player_id", "name", "date_of_birth", "position"),
    "transfers": (
        "player_id",
        "transfer_date",
        "transfer_season",
        "from_club_id",
        "to_club_id",
        "from_club_name",
        "to_club_name",
        "transfer_fee",
    ),
    "player_valuations": ("player_id", "date", "market_value_in_eur"),
}


# Texts that stand for a missing value in the source files.
NULL_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)


def read_csv_text(spark: SparkSession, path: str, columns: Sequence[str], multi_line: bool = True) -> DataFrame:
    """CSV (plain or gzip) with every column kept as text, pruned to the wanted columns.

    Quotes inside quoted fields are doubled, and fields may hold line ends; texts that stand for a
    missing value are null. Missing columns raise. A file is then one split: land it as Parquet once and
    work on that, or set multi_line to False where no field holds a line end.
    """
    df = spark.read.options(header=True, multiLine=multi_line, escape='"', quote='"').csv(path)
    rows = typed_scan(df, {c: "string" for c in columns})
    return rows.select(*(F.when(~F.col(c).isin(*NULL_TEXTS), F.col(c)).alias(c) for c in columns))


def typed_scan(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Select required columns with their types. Text that does not fit becomes null."""
    missing = [c for c in types if c not in df.columns]
    if missing:
        raise ContractError(f"missing required columns: {missing}")
    have = dict(df.dtypes)
    cols = [
        F.col(c) if have[c] == t else F.col(c).try_cast(t).alias(c) for c, t in types.items()
    ]
    return df.select(*cols)


def schema_profile(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """(table, column, present, rows, null share) for every required column, one scan per table."""
    parts = []
    for name, (df, required) in tables.items():
        present = [c for c in required if c in df.columns]
        stats = df.agg(
            F.count(F.lit(1)).alias("rows"), *(F.count(F.col(c)).alias(c) for c in present)
        )
        entries = [
            F.struct(
                F.lit(name).alias("table_name"),
                F.lit(c).alias("column_name"),
                F.lit(c in present).alias("present"),
                F.col("rows").alias("rows"),
                (
                    F.when(F.col("rows") > 0, 1 - F.col(c) / F.col("rows"))
                    if c in present
                    else F.lit(None).cast("double")
                ).alias("null_share"),
            )
            for c in required
        ]
        parts.append(stats.select(F.explode(F.array(*entries)).alias("e")).select("e.*"))
    return reduce(DataFrame.unionByName, parts)


def context_scan(appearances: DataFrame, ids_of_interest: DataFrame) -> DataFrame:
    """Second projection of raw appearances: typed, complete rows, only the wanted players."""
    typed = appearances.select(
        clean_id("player_id").alias("player_id"),
        clean_id("competition_id").alias("competition_id"),
        parse_date("date").alias("match_date"),
        to_number("goals").alias("goals"),
        to_number("minutes_played").alias("minutes"),
    ).na.drop(subset=["match_date", "goals", "minutes"])
    return typed.join(ids_of_interest.select("player_id"), "player_id", "left_semi")


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: Bytes of a file that are held at once while it is hashed.
CHUNK = 1 << 22


def _opened(path: str):
    """A stream over a file of any store that pyarrow reads (file, hdfs, viewfs, s3, gs, abfs)."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_stream(unquote(urlparse(path).path))
    if path.startswith("viewfs:"):
        return fs.HadoopFileSystem.from_uri(path).open_input_stream(urlparse(path).path)
    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_stream(inside)


def file_hashes(spark: SparkSession, path_glob: str) -> DataFrame:
    """(file, bytes, sha256) of raw files of any size; `file` is the path from the folder of the glob's last part.

    A folder that the glob names gives its files, each as folder/name, so equal names in two folders stay apart.

    Spark lists the files, without their content, and deals them to tasks; a task streams through a file in
    pieces of CHUNK bytes, so neither a row nor a task ever holds one. A file that ends up with
    other bytes than were listed fails the job.
    """
    def parts(path: str) -> list[str]:
        return re.sub(r"^\w+:(//[^/]*)?", "", path).rstrip("/").split("/")

    above = len(parts(path_glob)) - 1

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path, length in zip(batch["path"].to_pylist(), batch["length"].to_pylist(), strict=True):
                digest, read = hashlib.sha256(), 0
                with _opened(path) as stream:
                    while part := stream.read(CHUNK):
                        digest.update(part)
                        read += len(part)
                if read != length:
                    raise OSError(f"{path}: listed with {length} bytes, read {read}")
                digests.append(digest.hexdigest())
            names = ["/".join(parts(p)[above:]) for p in batch["path"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch["length"], pa.array(digests, pa.string())], names=["file", "bytes", "sha256"])

    listed = spark.read.format("binaryFile").load(path_glob).select("path", "length")
    return listed.repartition(max(1, listed.count())).mapInArrow(hashed, "file string, bytes bigint, sha256 string")


def table_hashes(files: DataFrame) -> DataFrame:
    """(file, bytes, sha256) per table: a plain file as it is; a folder of part files by their names and digests."""
    part = F.instr("file", "/") > 0
    digests = F.sort_array(F.collect_list(F.concat_ws(" ", "sha256", "file")))  # one short text per file of a table
    return files.groupBy(F.substring_index("file", "/", 1).alias("table")).agg(
        F.sum("bytes").alias("bytes"),
        F.when(F.max(part), F.sha2(F.array_join(digests, "\n"), 256)).otherwise(F.min("sha256")).alias("sha256"),
    ).withColumnRenamed("table", "file")


def verify_hashes(actual: DataFrame, recorded: DataFrame) -> DataFrame:
    """Rows that break the record: a file missing, not recorded, or with other bytes."""
    a, r = actual.alias("a"), recorded.alias("r")
    problem = (
        F.when(F.col("a.file").isNull(), "missing")
        .when(F.col("r.file").isNull(), "unrecorded")
        .when(F.col("a.sha256") != F.col("r.sha256"), "differs")
    )
    return a.join(r, F.col("a.file") == F.col("r.file"), "full_outer").select(
        F.coalesce("a.file", "r.file").alias("file"), problem.alias("problem")
    ).where("problem is not null")


def fingerprint(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """Row count and an order-insensitive content sum; equal tables give equal rows."""
    text = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit(r"\N")) for c in columns))
    part = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("decimal(20,0)")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("content_sum"),
    )


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
