"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode only."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="labelgrow-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/labelgrow/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, gives Spark the true size."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch of texts.
TEXT_BATCH = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def text_batches(df: DataFrame) -> DataFrame:
    """The table, after its session was told to hand texts to Python in batches of at most ``TEXT_BATCH`` bytes.

    Otherwise a batch is 10,000 texts of any length, of which JVM and worker hold several.
    """
    conf = df.sparkSession.conf
    if int(str(conf.get(_BATCH)).rstrip("b") or 0) > TEXT_BATCH:
        conf.set(_BATCH, str(TEXT_BATCH))
    return df


def split_join(rows: DataFrame, counted: DataFrame, key: str | list[str], n_col: str, total: int, most: int = 100_000, least: int = 1000) -> DataFrame:
    """``rows`` joined with ``counted``, one row for each key, that says in ``n_col`` how many of the ``total`` rows have it.

    Keys of more than ``total / most`` rows (and more than ``least``) are fewer than ``most``: they are
    broadcast, so that their rows stay where they are. The others are joined by their key.
    """
    hot = F.broadcast(counted.filter(F.col(n_col) > max(least, total // most)).drop(n_col))
    cold = counted.filter(F.col(n_col) <= max(least, total // most)).drop(n_col)
    return rows.join(hot, key).unionByName(rows.join(hot.select(*([key] if isinstance(key, str) else key)), key, "left_anti").join(cold, key))


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often and in whatever lambda it stands there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(numbers: Column, chunk: int = 64) -> Column:
    """The sums of an array of integers up to each place, itself included.

    Sums of chunks are carried in a short array and the numbers of one chunk added to them, so a long
    array takes about ``chunk`` / 2 steps an element; nothing grows by appending element by element.
    """

    def sums(a: Column) -> Column:
        last = F.floor((F.size(a) - 1) / F.lit(chunk)).cast("int")
        total = lambda x: F.aggregate(x, F.lit(0), lambda acc, y: acc + y)
        zero = F.array(F.lit(0))
        carried = F.aggregate(F.sequence(F.lit(0), last), zero, lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + total(F.slice(a, c * chunk + 1, F.lit(chunk))))))
        return let(carried, lambda base: F.transform(a, lambda _, i: F.get(base, F.floor(i / F.lit(chunk)).cast("int")) + total(F.slice(a, i - i % chunk + 1, i % chunk + 1))))

    return F.when(F.size(numbers) == 0, F.array().cast("array<int>")).otherwise(let(numbers, sums))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that the table doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
