"""Whitening of embeddings by the weighted covariance of their distinct vectors.

Equal vectors are grouped first, so a vector that a third of all rows share is one row of every later
pass; counts or ones are the weights of the fit. Tasks multiply centred blocks in numpy and hand on one
matrix each, Spark adds those up, and the driver gets one d x d matrix for each width d.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, stored

#: Steps of the grid are 1 / SCALE; SHIFT makes usual entries positive.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this many steps are clipped, so that a double holds each of them exactly.
LARGEST = 1 << 53
COMPONENTS = 16
#: Vectors of so many different lengths at most; each length is whitened on its own.
MOST_WIDTHS = 64
#: Sums go in two parts of so many low bits and the rest, which no task can overflow.
_LOW = 20


@dataclass(frozen=True)
class Model:
    """The fit of one width: ``n`` and exact ``sums`` of the weighted vectors, unit ``components`` by row, their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def centre(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part is taken off as integers, so no digit is lost to the shift."""
        low, rest = self.whole()
        return (x - low) - rest / self.n

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """S = n * low + rest."""
        low = [s // self.n for s in self.sums]
        return np.array(low, dtype=np.int64), np.array([s - self.n * m for s, m in zip(self.sums, low, strict=True)], dtype=np.int64)

    def explained(self) -> list[float | None]:
        return [float(e / self.trace) if self.trace > 0 else None for e in self.values]

    def solid(self) -> np.ndarray:
        """Components whose eigenvalue is more than rounding noise."""
        return self.values > len(self.sums) * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.coalesce(~F.exists(vector.cast("array<double>"), bad), F.lit(False))


def on_grid(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry, as longs."""
    step = lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long") + SHIFT
    return F.transform(vector.cast("array<double>"), step)


def distinct_vectors(x: DataFrame) -> DataFrame:
    """(x, n_rows) of a table of one array column: partial counts before the shuffle."""
    return x.toDF("x").groupBy("x").agg(F.count("*").alias("n_rows"))


def _blocks(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, row numbers, matrix) of a batch, for each width in it."""
    lists = batch.column(batch.schema.get_field_index(name))
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for width in np.unique(sizes):
        rows = np.flatnonzero(sizes == width)
        yield int(width), rows, flat[starts[rows][:, None] + np.arange(width)]


def _weights(batch: pa.RecordBatch, rows: np.ndarray, weighted: bool) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("n_rows")).to_numpy()[rows] if weighted else np.ones(len(rows), dtype=np.int64)


def _sums(vectors: DataFrame, weighted: bool) -> dict[int, tuple[int, tuple[int, ...]]]:
    """Width -> (weight, exact sums of x)."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for width, rows, x in _blocks(batch, "x"):
                w = _weights(batch, rows, weighted)
                n, high, low = total.setdefault(width, [0, np.zeros(width, dtype=object), np.zeros(width, dtype=object)])
                total[width] = [n + int(w.sum()), high + (w @ (x >> _LOW)), low + (w @ (x & ((1 << _LOW) - 1)))]
        for width, (n, high, low) in total.items():
            sums = [str((int(h) << _LOW) + int(s)) for h, s in zip(high, low, strict=True)]
            yield pa.RecordBatch.from_pydict({"width": [width], "parts": [[str(n), *sums]]})

    parts = vectors.mapInArrow(add, "width long, parts array<string>").select("width", F.posexplode("parts").alias("i", "v"))
    got: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("width", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        got.setdefault(r.width, {})[r.i] = int(r.v)
        if len(got) > MOST_WIDTHS:
            raise ValueError(f"vectors of more than {MOST_WIDTHS} different lengths")
    return {width: (v[0], tuple(v[i] for i in range(1, width + 1))) for width, v in got.items()}


def _covariances(vectors: DataFrame, column: str, centres: dict[int, tuple[np.ndarray, np.ndarray]], totals: dict[int, int], weighted: bool) -> dict[int, np.ndarray]:
    """Width -> sum of w (v - a - b)(v - a - b)' over the table, by its total weight; (a, b) are the two parts of the centre."""

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, rows, v in _blocks(batch, column):
                if width:
                    a, b = centres[width]
                    c = (v - a) - b
                    total[width] = total.get(width, 0) + (c * _weights(batch, rows, weighted)[:, None]).T @ c
        for width, m in total.items():
            yield pa.RecordBatch.from_pydict({"width": [width] * width, "i": list(range(width)), "row": m.tolist()})

    rows = vectors.mapInArrow(multiply, "width long, i long, row array<double>").select("width", "i", F.posexplode("row").alias("j", "v"))
    out = {width: np.zeros((width, width)) for width in totals}
    for r in rows.filter("j >= i").groupBy("width", "i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.width][r.i, r.j] = out[r.width][r.j, r.i] = r.v / totals[r.width]
    return out


def fit(vectors: DataFrame, weights: str = "one", components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each width of a table (x, n_rows) of distinct vectors.

    ``weights`` is ``one`` (each distinct vector counts once) or ``count`` (as often as rows have it).
    The covariance's divisor is the total weight. At most ``components`` leading components are kept.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights are one or count")
    weighted, out = weights == "count", {}
    sums = _sums(vectors, weighted)
    if not sums:
        return {}
    means = {width: Model(n, s, np.zeros((0, width)), np.zeros(0), 0.0) for width, (n, s) in sums.items()}
    centres = {width: (m.whole()[0], m.whole()[1] / m.n) for width, m in means.items()}
    for width, v in _covariances(vectors, "x", centres, {width: n for width, (n, _) in sums.items()}, weighted).items():
        values, axes = np.linalg.eigh(v)
        keep = np.argsort(-values, kind="stable")[:components]
        out[width] = Model(*sums[width], axes[:, keep].T.copy(), np.maximum(values[keep], 0.0), float(np.trace(v)))
    return out


def _deviations(model: Model, x: np.ndarray) -> list[int | None]:
    """sum (n x - S)^2, exact; None where it doesn't fit in a long."""
    low, rest = model.whole()
    y, n = x - low, model.n
    if x.shape[1] * n * (int(np.abs(y).max(initial=0)) + 1) < 1 << 62 and x.shape[1] * (int(np.abs(y).max(initial=0)) ** 2) < 1 << 62:
        squares, mixed = (y * y).sum(axis=1).tolist(), (y @ rest).tolist()
        constant = sum(r * r for r in rest.tolist())
        out = [n * n * a - 2 * n * b + constant for a, b in zip(squares, mixed, strict=True)]
    else:
        out = [sum((n * a - r) ** 2 for a, r in zip(row, rest.tolist(), strict=True)) for row in y.tolist()]
    return [v if v < 1 << 63 else None for v in out]


def project(vectors: DataFrame, models: dict[int, Model]) -> DataFrame:
    """``deviation`` and ``whitened`` (null for components without variance) for each distinct vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deviation, whitened = [None] * batch.num_rows, [None] * batch.num_rows
            for width, rows, x in _blocks(batch, "x"):
                model = models[width]
                solid = model.solid()
                w = model.centre(x) @ model.components[solid].T / np.sqrt(model.values[solid])
                full = np.full((len(rows), len(solid)), None, dtype=object)
                full[:, solid] = w
                for row, d, v in zip(rows, _deviations(model, x), full.tolist(), strict=True):
                    deviation[row], whitened[row] = d, v
            arrays = [*batch.columns, pa.array(deviation, pa.int64()), pa.array(whitened, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "deviation", "whitened"])

    return vectors.mapInArrow(run, "x array<bigint>, n_rows bigint, deviation bigint, whitened array<double>")


def identity_errors(projected: DataFrame, models: dict[int, Model], weights: str = "one") -> dict[int, float | None]:
    """Width -> the largest absolute entry of the whitened vectors' covariance minus the identity; None without any component."""
    weighted, out = weights == "count", {}
    w = F.col("n_rows") if weighted else F.lit(1)
    for width, model in models.items():
        k = int(model.solid().sum())
        if not k:
            out[width] = None
            continue
        solid = projected.filter(F.size("x") == width).select(F.filter("whitened", lambda c: c.isNotNull()).alias("v"), "n_rows")
        sums = solid.select(F.posexplode("v").alias("i", "v"), w.alias("w")).groupBy("i").agg(F.sum(F.col("v") * F.col("w")).alias("s")).collect()
        mean = np.zeros(k)
        for r in sums:
            mean[r.i] = r.s / model.n
        cov = _covariances(solid, "v", {k: (mean, np.zeros(k))}, {k: model.n}, weighted)[k]
        out[width] = float(np.abs(cov - np.eye(k)).max())
    return out


def whiten(df: DataFrame, vector_col: str = "embedding", weights: str = "one", components: int = COMPONENTS) -> DataFrame:
    """The rows of ``df`` with a usable vector, with what their vector on the grid is after whitening.

    Adds n (total weight of the fit), deviation (sum of (n x - S)^2), and, by component, whitened and
    explained (share of the variance), as arrays of equal length, and identity_error. Names that the
    table has already get underscores in front. Rows whose vector is null or has null, NaN or infinite
    entries go. Entries of more than 2^53 steps are clipped. Vectors of different lengths are whitened
    apart; an empty vector has no components. A component without variance (one distinct vector,
    constant or dependent entries) has whitened null; explained is null if nothing varies at all;
    identity_error covers the other components and is null if there are none. A deviation beyond a
    long is null. Rows that repeat stay; an empty table gives an empty one.
    """
    x, n_rows, n, deviation, whitened, explained, error = fresh(df, "x", "n_rows", "n", "deviation", "whitened", "explained", "identity_error")
    rows = df.filter(usable(F.col(f"`{vector_col}`"))).withColumn(x, on_grid(F.col(f"`{vector_col}`")))
    vectors = stored(distinct_vectors(rows.select(x)), "vectors")
    models = fit(vectors, weights, components)
    done = stored(project(vectors, models), "whitened")
    errors = identity_errors(done, models, weights)
    spark = df.sparkSession
    facts = [(width, m.n, m.explained(), errors[width]) for width, m in models.items()]
    by_width = spark.createDataFrame(facts, "width int, n long, explained array<double>, identity_error double")
    back = done.join(F.broadcast(by_width), F.size("x") == F.col("width"))  # MOST_WIDTHS rows at most
    named = {"x": x, "n": n, "deviation": deviation, "whitened": whitened, "explained": explained, "identity_error": error}
    # The vector of a third of all rows is one row here: Spark splits that key's rows on the other side.
    return rows.join(back.select(*[F.col(a).alias(b) for a, b in named.items()]), x).drop(x)
