"""Order-dependent operators without a single ordered partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.session import settle


def running_total(df: DataFrame, order_by: list[str], values: dict[str, Column]) -> DataFrame:
    """``df`` with running totals ``name`` (this row included) of each value, in the order of ``order_by``.

    Rows are split by range of the order, so that a partition holds its share of all rows whatever they are; inside
    one the totals run, and each partition starts from the sum of those before it (one row a partition).  The order
    must be total; nulls in values count as 0 and null keys come first.  An empty table stays empty.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parted = df.withColumns({f"__{k}": F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in values.items()})
    parted = settle(parted.repartitionByRange(n, *order_by).withColumn("__part", F.spark_partition_id()))
    sums = parted.groupBy("__part").agg(*[F.sum(f"__{k}").alias(f"__sum_{k}") for k in values])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__part", *[F.coalesce(F.sum(f"__sum_{k}").over(before), F.lit(0.0)).alias(f"__from_{k}") for k in values])
    w = Window.partitionBy("__part").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    out = parted.join(F.broadcast(sums), "__part")  # at most n rows
    return out.withColumns({k: F.col(f"__from_{k}") + F.sum(f"__{k}").over(w) for k in values}).drop("__part", *[f"__{k}" for k in values], *[f"__from_{k}" for k in values])


def previous(df: DataFrame, group: list[str], order_by: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the ``value`` of the row before in its group, null for the first.

    Rows are split by range of group and order, so a hot group lies in many parts; a part's first row takes its value
    from the last row of the part before it (one row a part), if that is of its group.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parted = settle(df.repartitionByRange(n, *group, *order_by).withColumn("__part", F.spark_partition_id()))
    place = F.struct(*group, *order_by)
    last = parted.groupBy("__part").agg(F.max_by(F.struct(F.struct(*group).alias("g"), F.col(value).alias("v")), place).alias("x"))
    last = last.select("__part", F.lag("x").over(Window.orderBy("__part")).alias("__last"))  # one row a part
    w = Window.partitionBy("__part", *group).orderBy(*order_by)
    out = parted.join(F.broadcast(last), "__part").withColumn("__k", F.row_number().over(w)).withColumn(name, F.lag(value).over(w))
    carried = F.when((F.col("__k") == 1) & F.col("__last.g").eqNullSafe(F.struct(*group)), F.col("__last.v"))
    return out.withColumn(name, F.when(F.col("__k") == 1, carried).otherwise(F.col(name))).drop("__part", "__last", "__k")


def failure_runs(df: DataFrame, order_by: list[str], failed: Column, at_least: int) -> DataFrame:
    """(run, first, length): runs of at least ``at_least`` failures in a row; ``first`` is the first row's last order key.

    A run is numbered by the successes before it; it is counted by a combining aggregate, however long it is.
    """
    ok = F.when(F.coalesce(failed, F.lit(False)), 0).otherwise(1)
    marked = running_total(df.withColumn("__ok", ok), order_by, {"run": F.col("__ok")})
    runs = marked.where("__ok = 0").groupBy(F.col("run").cast("long").alias("run")).agg(F.min(F.struct(*order_by))[order_by[-1]].alias("first"), F.count("*").alias("length"))
    return runs.where(F.col("length") >= at_least)


def islands(df: DataFrame, key: list[str], line: str, gap: int, name: str = "island") -> DataFrame:
    """``df`` (rows distinct in key and line) with the first line of each row's island: lines at most ``gap`` apart.

    The window holds the distinct lines of one key, which the length of a file bounds.
    """
    w = Window.partitionBy(*key).orderBy(line)
    start = F.when(F.coalesce(F.col(line) - F.lag(line).over(w) <= gap, F.lit(False)), F.lit(None)).otherwise(F.col(line))
    df = df.withColumn("__start", start)
    return df.withColumn(name, F.last("__start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__start")


def near_line_fold(df: DataFrame, key: list[str], line: str, confidence: str, order: str, within: int = 3) -> DataFrame:
    """The kept rows (key, line, order, confidence) of the fold that drops near repetitions.

    In order of line a row within ``within`` lines of the row kept last replaces it if it is strictly more confident,
    and is dropped otherwise; the distance counts from the kept row, not from the previous one.  Rows of one line are
    reduced first (highest confidence, then lowest order): the fold ends the same.  Islands of lines further than
    ``within`` apart can't touch, so each is folded alone.  Rows with a null line or key never merge and are left out.
    """
    rows = df.dropna(subset=[*key, line])
    best = F.max_by(F.struct(F.col(confidence).alias("c"), F.col(order).alias("o")), F.struct(F.coalesce(confidence, F.lit(-1.0)), -F.col(order)))
    per_line = rows.groupBy(*key, line).agg(best.alias("b")).select(*key, line, "b.c", "b.o")
    grouped = islands(per_line, key, line, within).groupBy(*key, "island")
    xs = F.array_sort(F.collect_list(F.struct(F.col(line).alias("l"), "o", "c")))
    folded = grouped.agg(xs.alias("xs")).select(*key, F.explode(fold_sorted("xs", within)).alias("x"))
    return folded.select(*key, F.col("x.l").alias(line), F.col("x.o").alias(order), F.col("x.c").alias(confidence))


def fold_sorted(xs: str, within: int) -> Column:
    """The fold itself over an array of (l, o, c) in order; an island's length is bounded by its lines."""
    return F.expr(
        f"""aggregate({xs}, array_repeat(element_at({xs}, 1), 0), (acc, x) -> CASE
          WHEN size(acc) = 0 OR x.l - element_at(acc, -1).l > {within} THEN concat(acc, array(x))
          WHEN coalesce(x.c, -1.0) > coalesce(element_at(acc, -1).c, -1.0) THEN concat(slice(acc, 1, size(acc) - 1), array(x))
          ELSE acc END)"""
    )
