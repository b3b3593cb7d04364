"""Time holdout, expanding chronological folds and split summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.operators import contracts as C


def with_partition(df: DataFrame, on: str, test_start: Column) -> DataFrame:
    return df.withColumn("partition", F.when(F.col(on) >= test_start, "test").otherwise("train"))


def holdout_gates(
    df: DataFrame, key: str, min_total: int, min_test: int, min_train: int = 1
) -> DataFrame:
    """(gate, required, actual, passed) for a frame carrying ``partition``; the repeated-key gate
    counts rows beyond the first of each key and requires none."""
    per_key = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(F.when(F.col("partition") == "train", 1)).alias("_train"),
    )
    counts = per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("_n") - F.col("_train")), F.lit(0)).alias("test_rows"),
        F.coalesce(F.sum("_train"), F.lit(0)).alias("train_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeated_keys"),
    )
    minimum = C.gates(
        counts, {"total_rows": min_total, "test_rows": min_test, "train_rows": min_train}
    )
    unique = counts.select(
        F.lit("repeated_keys").alias("gate"),
        F.lit(0).cast("bigint").alias("required"),
        F.col("repeated_keys").cast("bigint").alias("actual"),
        (F.col("repeated_keys") == 0).alias("passed"),
    )
    return minimum.unionByName(unique)


def fold_table(train: DataFrame, n_folds: int, cycle: str = "transfer_cycle") -> DataFrame:
    """(fold, validation_cycle): the last n cycles in order. One row per distinct cycle is ranked."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(cycle))
    return (
        train.where(F.col(cycle).isNotNull())
        .select(cycle)
        .distinct()
        .withColumn("_back", F.row_number().over(w))
        .where(F.col("_back") <= n_folds)
        .select(
            (F.lit(n_folds) - F.col("_back")).cast("int").alias("fold"),
            F.col(cycle).alias("validation_cycle"),
        )
    )


def fold_roles(train: DataFrame, n_folds: int, cycle: str = "transfer_cycle") -> DataFrame:
    """Rows once per fold with role train / validation; rows after the fold's cycle are left out."""
    folds = F.broadcast(fold_table(train, n_folds, cycle))  # n_folds rows
    spread = train.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    role = F.when(F.col(cycle) < F.col("validation_cycle"), "train").when(
        F.col(cycle) == F.col("validation_cycle"), "validation"
    )
    return spread.join(folds, "fold").withColumn("role", role).where("role is not null")


def fold_summary(
    train: DataFrame,
    n_folds: int,
    min_train: int,
    min_val: int,
    on: str = "transfer_date",
    cycle: str = "transfer_cycle",
) -> DataFrame:
    """Per fold: rows and dates per role and whether the fold is usable.

    Rows are counted once per cycle; a fold's training side is the running total of earlier
    cycles, so rows are not copied per fold.
    """
    per = train.where(F.col(cycle).isNotNull()).groupBy(cycle).agg(
        F.count(F.lit(1)).alias("validation_rows"),
        F.min(on).alias("validation_first"),
        F.max(on).alias("validation_last"),
    )
    w = Window.partitionBy(F.lit(0)).orderBy(cycle)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(F.lit(0)).orderBy(F.desc(cycle))
    ranked = (
        per.withColumn("train_rows", F.coalesce(F.sum("validation_rows").over(earlier), F.lit(0)))
        .withColumn("train_last", F.max("validation_last").over(earlier))
        .withColumn("_back", F.row_number().over(back))
        .where(F.col("_back") <= n_folds)
    )
    ok = (
        (F.col("train_rows") >= min_train)
        & (F.col("validation_rows") >= min_val)
        & (F.col("train_last") < F.col("validation_first"))
    )
    return ranked.select(
        (F.lit(n_folds) - F.col("_back")).cast("int").alias("fold"),
        F.col(cycle).alias("validation_cycle"),
        "train_rows",
        "validation_rows",
        "train_last",
        "validation_first",
        "validation_last",
        F.coalesce(ok, F.lit(False)).alias("usable"),
    )


def split_summary(df: DataFrame, entity: str, on: str, cycle: str, proxy: str) -> DataFrame:
    """One row per side plus repeat entities in the side and entities on both sides.

    Entities are counted per (entity) first, so a hot entity is one row per map task.
    """
    per_entity = df.groupBy(entity).agg(
        *(
            F.count(F.when(F.col("partition") == s, 1)).alias(f"_{s}") for s in ("train", "test")
        )
    )
    ent = per_entity.agg(
        F.count(F.when(F.col("_train") > 0, 1)).alias("train"),
        F.count(F.when(F.col("_test") > 0, 1)).alias("test"),
        F.count(F.when(F.col("_train") > 1, 1)).alias("train_repeat"),
        F.count(F.when(F.col("_test") > 1, 1)).alias("test_repeat"),
        F.count(F.when((F.col("_train") > 0) & (F.col("_test") > 0), 1)).alias("both"),
    )
    ent = ent.select(
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(s).alias("partition"),
                        F.col(s).alias("unique_entities"),
                        F.col(f"{s}_repeat").alias("repeat_entities"),
                        F.col("both").alias("entities_on_both_sides"),
                    )
                    for s in ("train", "test")
                )
            )
        ).alias("x")
    ).select("x.*")
    flag = F.col(proxy).cast("int")
    side = df.groupBy("partition").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(on).alias("date_min"),
        F.max(on).alias("date_max"),
        F.array_join(F.sort_array(F.collect_set(cycle)).cast("array<string>"), ",").alias("cycles"),
        F.sum(flag).alias("proxy_rows"),
        (100 * F.avg(flag)).alias("proxy_pct"),
    )
    return side.join(F.broadcast(ent), "partition")
