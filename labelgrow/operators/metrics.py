"""Binary metrics of predictions, ROC-AUC, and the best configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .ranges import running_totals

METRICS = ("accuracy", "precision", "recall", "specificity", "npv", "f1", "mcc", "roc_auc")


def roc_auc(predictions: DataFrame, by: list[str], y: str = "y", prob: str = "prob") -> DataFrame:
    """(by..., roc_auc) with ties at one half; null where a class is missing.

    Rows are counted by distinct score first; the counts are added up range by range.
    """
    counts = predictions.filter(F.col(y).isNotNull() & F.col(prob).isNotNull()).groupBy(*by, prob).agg(
        F.count_if(F.col(y) == 1).cast("double").alias("pos"), F.count_if(F.col(y) == 0).cast("double").alias("neg")
    )
    won = running_totals(counts, by, prob, "neg").withColumn("won", F.col("pos") * (F.col("below") + F.lit(0.5) * F.col("neg")))
    return won.groupBy(*by).agg(F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def confusion(y: Column, pred: Column) -> list[Column]:
    return [F.count_if((y == a) & (pred == b)).alias(name) for name, a, b in (("tp", 1, 1), ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0))]


def binary_metrics(predictions: DataFrame, by: list[str], y: str = "y", pred: str = "pred", prob: str = "prob") -> DataFrame:
    """Counts and rates for each group; a rate with a zero denominator is 0, ROC-AUC of one class is null."""
    counts = predictions.groupBy(*by).agg(*confusion(F.col(y), F.col(pred)))
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    precision, recall = ratio(tp, tp + fp, 0.0), ratio(tp, tp + fn, 0.0)
    rates = counts.select(
        *by, "tp", "tn", "fp", "fn",
        ratio(tp + tn, tp + tn + fp + fn, 0.0).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        ratio(tn, tn + fp, 0.0).alias("specificity"),
        ratio(tn, tn + fn, 0.0).alias("npv"),
        ratio(2 * tp, 2 * tp + fp + fn, 0.0).alias("f1"),
        ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0.0).alias("mcc"),
    )
    auc = roc_auc(predictions, by, y, prob).withColumnsRenamed({c: f"_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return (rates.join(auc, same, "left") if by else rates.crossJoin(auc)).drop(*[f"_{c}" for c in by])


def top_configs(grid: DataFrame, n: int = 10, metric: str = "roc_auc", seq: str = "seq") -> DataFrame:
    """The n best rows: nulls last, ties by evaluation order."""
    return grid.orderBy(F.col(metric).desc_nulls_last(), seq).limit(n)


def best_config(grid: DataFrame, metric: str = "roc_auc", seq: str = "seq") -> DataFrame:
    return top_configs(grid.filter(F.col(metric).isNotNull()), 1, metric, seq)


def class_distribution(df: DataFrame, y: str = "y") -> DataFrame:
    return df.groupBy(y).agg(F.count("*").alias("n"))
