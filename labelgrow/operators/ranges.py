"""Running totals in the order of a value and joins of counted keys, without one task holding a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import work_dir


def running_totals(df: DataFrame, by: list[str], value: str, amount: str) -> DataFrame:
    """Adds ``below`` and ``total``: the sum of ``amount`` over a group's rows of smaller ``value``, and over all of them.

    ``df`` has one row for each (by..., value); a group may hold any share of them. Rows are ranged by
    (by..., value) and stored with the number of their range, ``range``; sums of ranges are carried over
    in a small table of one row for each group and range. A null in ``by`` is a group of its own.
    """
    spark = df.sparkSession
    group = F.struct(*by) if by else F.struct(F.lit(0))
    ranged = df.repartitionByRange(*by, value).withColumns({"_group": group, "range": F.spark_partition_id()})
    path = work_dir(spark, "ranges")
    ranged.write.parquet(path)
    rows = spark.read.schema(ranged.schema).parquet(path)
    before = lambda w: F.coalesce(F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = rows.groupBy("_group", "range").agg(F.sum(amount).alias("_sum"))
    groups = Window.partitionBy("_group")
    carried = sums.select("_group", "range", before(groups.orderBy("range")).alias("_carried"), F.sum("_sum").over(groups).alias("total"))
    own = Window.partitionBy("range", "_group").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_own", F.coalesce(F.sum(amount).over(own), F.lit(0)))
    return placed.join(carried, ["range", "_group"]).withColumn("below", F.col("_carried") + F.col("_own")).drop("_group", "_own", "_carried")


#: Keys that hold more than this share of all rows, and more rows than LEAST, are joined where their rows are.
HOT_SHARE, LEAST = 1e-5, 1000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], n_col: str, total: int, least: int | None = None) -> DataFrame:
    """``rows`` joined with ``counted``, which has one row for each key and in ``n_col`` how many of the ``total`` rows have it.

    Keys of more than ``HOT_SHARE`` of all rows are fewer than 1 / HOT_SHARE: they are broadcast, and
    their rows stay where they are. The others meet by their key.
    """
    most = max(LEAST if least is None else least, int(total * HOT_SHARE))
    hot = F.broadcast(counted.filter(F.col(n_col) > most).drop(n_col))
    cold = counted.filter(F.col(n_col) <= most).drop(n_col)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))
