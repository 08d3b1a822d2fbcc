"""Selection from both ends of the probability range, with class-balanced quotas, and seeded samples."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SamplerConfig


#: Hexadecimal digits of a hash by which it is counted at once; hashes that the driver may see.
DIGITS, MOST = 3, 4096


def hash_order(id_col: str, seed: int) -> Column:
    """A random but repeatable order of ids; a missing id counts as an empty one."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def kth_hash(df: DataFrame, k: int, id_col: str, seed: int = 42) -> tuple[str, int, int] | None:
    """(hash, r, n): the first k rows in hash order are all below the hash and r of the n rows that have it; None if k is all rows or more.

    Rows are counted by the first digits of their hash, then by more digits within the cell where the
    k-th lies, until that cell's hashes are few: each round reads the ids alone and hands the driver
    16 ** DIGITS counts, or MOST.
    """
    hashes = df.select(hash_order(id_col, seed).alias("h"))
    prefix, before = "", 0
    while len(prefix) < 32:
        width = min(len(prefix) + DIGITS, 32)
        for whole in (False, True):
            cell = F.col("h") if whole else F.substring("h", 1, width)
            counts = sorted(tuple(x) for x in hashes.filter(F.col("h").startswith(prefix)).groupBy(cell.alias("c")).count().collect())
            for c, n in counts:
                if before + n >= k:
                    break
                before += n
            else:
                return None
            if whole:
                return c, k - before, n
            prefix = c
            if n > MOST:
                break
    return prefix, k - before, n


def sample(df: DataFrame, k: int, id_col: str, seed: int = 42) -> DataFrame:
    """k rows without replacement, the first in hash order: a filter on the hash, whatever k is.

    No row but those that share the k-th row's hash, as repeated ids do, is sorted or moved.
    """
    if k <= 0:
        return df.limit(0)
    found = kth_hash(df, k, id_col, seed)
    if found is None:
        return df
    last, r, n = found
    h = hash_order(id_col, seed)
    return df.filter(h <= last) if r == n else df.filter(h < last).unionByName(df.filter(h == last).limit(r))


def split_sizes(counts: dict, fraction: float) -> dict:
    """How many rows of each class go to the test part: largest remainders, ceil(fraction * n) in all."""
    total = math.ceil(fraction * sum(counts.values()) - 1e-9)
    exact = {c: fraction * n for c, n in counts.items()}
    sizes = {c: int(x + 1e-9) for c, x in exact.items()}
    for c in sorted(counts, key=lambda c: (-(exact[c] - sizes[c]), str(c)))[: total - sum(sizes.values())]:
        sizes[c] += 1
    return sizes


def stratified_split(df: DataFrame, y: str, id_col: str, fraction: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test), exact in each class; rows without a label are in neither."""
    labeled = df.filter(F.col(y).isNotNull())
    sizes = split_sizes({x[y]: x["count"] for x in labeled.groupBy(y).count().collect()}, fraction)
    parts = [sample(labeled.filter(F.col(y) == c), k, id_col, seed) for c, k in sorted(sizes.items(), key=lambda x: str(x[0]))]
    test = parts[0] if parts else labeled.limit(0)
    for part in parts[1:]:
        test = test.unionByName(part)
    return labeled.join(test.select(id_col), id_col, "left_anti"), test


def approximate_split(df: DataFrame, id_col: str, fraction: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a filter on the hash: no shuffle, class shares as chance has it."""
    share = F.conv(F.substring(hash_order(id_col, seed), 1, 8), 16, 10).cast("double") / float(2**32)
    return df.filter(share >= fraction), df.filter(share < fraction)


def confident(df: DataFrame, prob: str = "prob", hi: float = 0.9, lo: float = 0.1) -> DataFrame:
    """Adds ``pseudo_label``: 1 from ``hi`` up, else 0 from ``lo`` down, else null."""
    p = F.col(prob)
    return df.withColumn("pseudo_label", F.when(p >= hi, 1).when(p <= lo, 0))


def balance_quota(n_pos: int, n_neg: int, pos: int, neg: int, ratio: float = 1.0, min_per_class: int = 10) -> tuple[int, int]:
    """How many of the available confident rows to take, so that training moves towards ``ratio``."""
    if ratio <= 0:
        raise ValueError("ratio must be above 0")
    if (pos / neg if neg else math.inf) < ratio:
        take_pos = min(n_pos, int(ratio * neg - pos))
        take_neg = min(n_neg, int(take_pos / ratio))
    else:
        take_neg = min(n_neg, int(pos / ratio - neg))
        take_pos = min(n_pos, int(take_neg * ratio))
    return min(n_pos, max(take_pos, min_per_class)), min(n_neg, max(take_neg, min_per_class))


def cap_quota(n_pos: int, n_neg: int, cap: int | None) -> tuple[int, int]:
    """Both counts cut so that they add up to at most ``cap``, halves first."""
    if cap is None or n_pos + n_neg <= cap:
        return n_pos, n_neg
    half = cap // 2
    take_pos = min(n_pos, half)
    take_neg = min(n_neg, cap - take_pos)
    return (min(n_pos, cap - take_neg), take_neg) if take_neg < half else (take_pos, take_neg)


def relax(hi: float, lo: float, n_pos: int, n_neg: int, min_per_class: int = 10, step: float = 0.05) -> tuple[float, float]:
    """Thresholds for the next round: a class that got too few moves its own towards 0.5."""
    return (max(0.5, hi - step) if n_pos < min_per_class else hi), (min(0.5, lo + step) if n_neg < min_per_class else lo)


@dataclass
class SamplerState:
    """Thresholds in force and what was selected with which."""

    hi: float
    lo: float
    history: list[tuple[int, int, int, float, float]] = field(default_factory=list)

    def reset(self, hi: float, lo: float) -> None:
        self.hi, self.lo, self.history = hi, lo, []


def select_two_ended(
    scored: DataFrame, distribution: dict[int, int] | None, state: SamplerState, cfg: SamplerConfig = SamplerConfig(), id_col: str = "id", iteration: int = 1
) -> DataFrame:
    """(id, pseudo_label, prob, iteration) of the rows picked from both ends.

    One aggregate counts the confident rows, the quotas are arithmetic on the driver, and each class is
    a top-k in hash order. The state's history keeps the counts before the cap; thresholds relax after it.
    """
    marked = confident(scored, "prob", state.hi, state.lo).filter("pseudo_label is not null")
    n = marked.agg(F.count_if(F.col("pseudo_label") == 1).alias("pos"), F.count_if(F.col("pseudo_label") == 0).alias("neg")).first()
    quota = (n["pos"], n["neg"])
    if distribution is not None:
        quota = balance_quota(*quota, distribution.get(1, 0), distribution.get(0, 0), cfg.ratio, cfg.min_per_class)
    state.history.append((iteration, *quota, state.hi, state.lo))
    taken = cap_quota(*quota, cfg.cap)
    if cfg.adapt:
        state.hi, state.lo = relax(state.hi, state.lo, *taken, cfg.min_per_class, cfg.step)
    picks = [sample(marked.filter(F.col("pseudo_label") == c), k, id_col, cfg.seed) for c, k in ((1, taken[0]), (0, taken[1]))]
    return picks[0].unionByName(picks[1]).select(id_col, "pseudo_label", "prob", F.lit(iteration).alias("iteration"))


def selection_history(spark, state: SamplerState) -> DataFrame:
    return spark.createDataFrame(state.history, "iteration int, n_pos_before_cap long, n_neg_before_cap long, threshold_high double, threshold_low double")


def selection_quality(selection: DataFrame, by: str = "iteration") -> DataFrame:
    """Counts and confidence of each iteration's picks; confidence is the probability of the given label."""
    p = F.when(F.col("pseudo_label") == 1, F.col("prob")).otherwise(1 - F.col("prob"))
    return selection.groupBy(by).agg(
        F.count("*").alias("n_selected"),
        F.count_if(F.col("pseudo_label") == 1).alias("n_positive"),
        F.count_if(F.col("pseudo_label") == 0).alias("n_negative"),
        F.avg(p).alias("mean_confidence"),
        F.stddev_pop(p).alias("std_confidence"),
        F.min(p).alias("min_confidence"),
        F.max(p).alias("max_confidence"),
    )


def quality_totals(quality: DataFrame) -> DataFrame:
    return quality.agg(
        F.count("*").alias("n_iterations"),
        F.sum("n_selected").alias("total_selected"),
        F.avg("n_selected").alias("mean_selected"),
        F.avg("mean_confidence").alias("mean_confidence"),
        F.sum("n_positive").alias("total_positive"),
        F.sum("n_negative").alias("total_negative"),
    )


def take_selected(pool: DataFrame, selection: DataFrame, id_col: str = "id") -> DataFrame:
    """The selected rows with their labels; Spark broadcasts the selection if it is small."""
    return pool.join(selection.select(id_col, "pseudo_label", "iteration"), id_col)


def remaining_pool(pool: DataFrame, selection: DataFrame, id_col: str = "id") -> DataFrame:
    return pool.join(selection.select(id_col), id_col, "left_anti")


def expand(train: DataFrame, taken: DataFrame, y: str = "y") -> DataFrame:
    """Training rows and pseudo-labelled ones, with where they come from."""
    base = train if "source" in train.columns else train.withColumns({"source": F.lit("labeled"), "iteration": F.lit(0)})
    new = taken.withColumn(y, F.col("pseudo_label")).withColumn("source", F.lit("pseudo")).select(*base.columns)
    return base.unionByName(new)


def within_class_rank(y: str, id_col: str, seed: int) -> Column:
    """For small tables: the place of a row in its class in hash order."""
    return F.row_number().over(Window.partitionBy(y).orderBy(hash_order(id_col, seed), id_col))
