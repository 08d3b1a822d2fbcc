import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelgrow.config import LoopConfig, SamplerConfig
from labelgrow.operators import metrics, monitor, sampling
from labelgrow.operators.neighbors import knn
from labelgrow.plans.loop import history_table, monitor_table, run_loop


@pytest.mark.parametrize(
    ("pos", "neg", "ratio", "p", "n", "picks"),
    [
        (50, 100, 1.0, 80, 200, (50, 50)),
        (100, 50, 1.0, 5, 200, (5, 50)),
        (50, 50, 1.0, 80, 80, (10, 10)),
        (20, 0, 1.0, 40, 40, (20, 20)),
        (10, 100, 0.5, 15, 200, (15, 30)),
        (50, 100, 1.0, 0, 200, (0, 10)),
    ],
)
def test_quota(pos, neg, ratio, p, n, picks):
    assert sampling.balance_quota(p, n, pos, neg, ratio) == picks


@pytest.mark.parametrize(("args", "out"), [((50, 10, 30), (20, 10)), ((50, 50, 31), (15, 16)), ((3, 50, 20), (3, 17)), ((5, 5, 20), (5, 5))])
def test_cap(args, out):
    assert sampling.cap_quota(*args) == out


def test_relax():
    assert sampling.relax(0.9, 0.1, 5, 50) == (pytest.approx(0.85), 0.1)
    assert sampling.relax(0.52, 0.48, 5, 5) == (0.5, 0.5)
    with pytest.raises(ValueError):
        sampling.balance_quota(1, 1, 1, 1, 0)


def test_confident_bounds(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.9, 0.1, 0.5, None])], "id long, prob double")
    assert [r["pseudo_label"] for r in sampling.confident(df).orderBy("id").collect()] == [1, 0, None, None]
    assert sampling.confident(df, hi=0.5, lo=0.5).filter("id = 2").first()["pseudo_label"] == 1


def test_samples_and_splits(spark, monkeypatch):
    df = spark.range(1000).selectExpr("id", "cast(id % 3 as int) as y")
    order = [r["id"] for r in df.orderBy(sampling.hash_order("id", 42)).collect()]
    for digits, most in ((3, 4096), (1, 5)):
        monkeypatch.setattr(sampling, "DIGITS", digits)
        monkeypatch.setattr(sampling, "MOST", most)
        for k in (0, 137, 1000, 2000):
            assert {r["id"] for r in sampling.sample(df, k, "id").collect()} == set(order[:k])
    repeated = df.filter("id < 5").crossJoin(spark.range(4).toDF("copy")).unionByName(spark.createDataFrame([(None, 0, 0)] * 3, "id long, y int, copy long"))
    assert [sampling.sample(repeated, k, "id").count() for k in (1, 7, 22, 24)] == [1, 7, 22, 23]
    assert "TakeOrdered" not in sampling.sample(df, 137, "id")._jdf.queryExecution().executedPlan().toString()
    train, test = sampling.stratified_split(df, "y", "id")
    assert (train.count(), test.count()) == (800, 200)
    assert train.join(test, "id").count() == 0
    assert sampling.split_sizes({0: 3, 1: 4}, 0.2) == {0: 1, 1: 1}


def test_metrics(spark):
    rows = [(1, 1)] * 3 + [(0, 0)] * 4 + [(0, 1)] + [(1, 0)] * 2
    m = metrics.binary_metrics(spark.createDataFrame([("a", y, p, float(p)) for y, p in rows], "g string, y int, pred int, prob double"), ["g"]).first()
    expected = {"accuracy": 0.7, "precision": 0.75, "recall": 0.6, "specificity": 0.8, "npv": 0.666667, "f1": 0.666667, "mcc": 0.408248}
    assert all(m[k] == pytest.approx(v, abs=1e-6) for k, v in expected.items())
    auc = lambda ys, ps: metrics.roc_auc(spark.createDataFrame(list(zip(ys, ps)), "y int, prob double"), []).first()["roc_auc"]
    assert auc((0, 0, 1, 1), (0.1, 0.4, 0.35, 0.8)) == 0.75
    assert auc((0, 1), (0.3, 0.3)) == 0.5
    assert auc((1, 1), (0.3, 0.4)) is None
    none = metrics.binary_metrics(spark.createDataFrame([(1, 0, 0.1)], "y int, pred int, prob double"), []).first()
    assert (none["precision"], none["f1"], none["mcc"], none["roc_auc"]) == (0, 0, 0, None)


def test_top(spark):
    grid = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.7), (4, 0.5)], "seq int, roc_auc double")
    assert [r["seq"] for r in metrics.top_configs(grid, 3).collect()] == [3, 1, 4]
    assert [r["seq"] for r in metrics.top_configs(grid.filter("seq < 4"), 3).collect()] == [3, 1, 2]
    assert metrics.best_config(grid).first()["seq"] == 3


@pytest.mark.parametrize(
    ("scores", "best", "stop"),
    [
        ([0.70, 0.75, 0.7505, 0.74, 0.7509, 0.90], 2, 5),
        ([0.70, 0.71, 0.72, 0.73], 4, None),
        ([0.50, 0.5009, 0.5018, 0.60], 4, None),
        ([0.60, 0.60, 0.60, 0.60], 1, 4),
    ],
)
def test_convergence(spark, scores, best, stop):
    df = spark.createDataFrame([("r", i + 1, s) for i, s in enumerate(scores)], "run_id string, iteration int, score double")
    row = monitor.convergence(df).first()
    assert (row["best_iteration"], row["stop_iteration"]) == (best, stop)
    m, stopped = monitor.Monitor(), None
    for i, s in enumerate(scores):
        if m.update(i + 1, s) and stopped is None:
            stopped = i + 1
            break
    assert stopped == stop and m.best_iteration == best


def test_knn_ties_by_id(spark):
    train = spark.createDataFrame([(5, [0.0]), (3, [2.0]), (4, [1.0]), (9, [1.0])], "id long, features array<double>")
    got = [(r["tid"], r["rank"]) for r in knn(spark.createDataFrame([(1, [1.0])], "id long, features array<double>"), train, 3).orderBy("rank").collect()]
    assert got == [(4, 1), (9, 2), (3, 3)]


def test_knn_in_blocks(spark):
    rows = [(i, [float(i * 7 % 31), float(i * 3 % 5)]) for i in range(200)]
    train = spark.createDataFrame(rows, "id long, features array<double>")
    query = spark.createDataFrame([(i, [i * 1.5, 2.0]) for i in range(40)], "id long, features array<double>").repartition(3)
    got = {(r["qid"], r["rank"]): r["tid"] for r in knn(query, train, 3, block_bytes=500).collect()}
    want = {}
    for q in range(40):
        order = sorted((((q * 1.5 - x) ** 2 + (2.0 - y) ** 2), i) for i, (x, y) in rows)
        want |= {(q, n + 1): order[n][1] for n in range(3)}
    assert got == want
    assert knn(query, train.limit(0), 3).count() == 0 and knn(query.limit(0), train, 3, block_bytes=500).count() == 0


def test_loop(spark, tmp_path):
    rows = [(i, [float(i % 2) + 0.01 * (i % 7), 1.0], i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, features array<double>, y int")
    labeled, pool = df.filter("id < 60"), df.filter("id >= 60").drop("y")
    done = run_loop(labeled, pool, f"file://{tmp_path}", "knn", cfg=LoopConfig(max_iterations=3, patience=5), sampler=SamplerConfig(cap=40))
    picked = [r["id"] for r in done.selections.collect()]
    assert len(picked) == len(set(picked)) and min(picked) >= 60
    assert done.pool.count() + len(picked) == 240
    assert all(h["n_labeled"] + h["n_unlabeled"] == 48 + 240 for h in done.history)
    assert history_table(spark, done).count() == len(done.history) and monitor_table(spark, done).count() >= len(done.history)
    truth = {r["id"]: r["id"] % 2 for r in pool.collect()}
    assert all(r["pseudo_label"] == truth[r["id"]] for r in done.selections.collect())
    small = run_loop(labeled, pool.limit(5), f"file://{tmp_path}", "knn")
    assert small.history == [] and small.best is not None


def test_gbt_is_registered_with_its_default_rounds(spark, monkeypatch):
    from labelgrow import queries
    from labelgrow.plans.boosting import Boosting

    seen = {}
    monkeypatch.setattr(queries, "evaluate_one", lambda name, sets, train, test, **parameters: seen.update({name: parameters}))
    monkeypatch.setattr(queries, "grid_metrics", lambda made: made)
    queries.queries()["gbt"](spark, "/root/testdata/sf0.001")
    assert Boosting(**seen["gbt"]).rounds == 100


def test_model_grid_fits_all_models_by_their_defaults(spark, monkeypatch):
    from labelgrow import queries
    from labelgrow.plans.models import NAMES

    seen = {}
    monkeypatch.setattr(queries, "evaluate_grid", lambda sets, models, work_dir=None, **more: (seen.update(models=models, sets=sets, more=more), []))
    queries.queries()["model_grid"](spark, "/root/testdata/sf0.001")
    assert set(seen["models"]) == set(NAMES) and len(seen["sets"]) == 2
    assert not seen["more"].get("parameters")  # gbt had 20 rounds of 100


@pytest.mark.parametrize("width", [1, 3, 40])
@pytest.mark.parametrize("block_bytes", [1 << 20, 60_000])
def test_knn_leaves_out_far_cells(spark, monkeypatch, width, block_bytes):
    from labelgrow.operators import neighbors

    def rows(n, seed):
        x = np.random.default_rng(seed).integers(0, 40, (n, width)) * [1000.0 if i == 0 else 1.0 for i in range(width)]
        return x + 1e6

    x, q, pairs = rows(1500, 1), np.concatenate([rows(700, 2), rows(50, 1)]), []
    frame = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, features array<double>")
    monkeypatch.setattr(neighbors, "CELL", 64)
    d2 = np.cumsum((q[:, None] - x[None]) ** 2, axis=2)[:, :, -1]
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d2.shape), d2), axis=1)[:, :4]
    want = {(i, n + 1): (int(t), float(np.sqrt(d2[i, t]))) for i in range(len(q)) for n, t in enumerate(order[i])}
    assert {(r["qid"], r["rank"]): (r["tid"], r["dist"]) for r in knn(frame(q), frame(x), 4, block_bytes=block_bytes).collect()} == want
    block, product = neighbors._Block(np.arange(len(x)), x), np.lexsort
    monkeypatch.setattr(neighbors.np, "lexsort", lambda keys, *a: pairs.append(len(keys[0])) or product(keys, *a))
    assert sum(b.num_rows for b in block.nearest(np.arange(len(q)), q, 4)) == 4 * len(q)
    assert sum(pairs) < 0.1 * len(q) * len(x)  # the old way took the differences of all pairs


def test_knn_missing_and_copies(spark):
    train = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(50)] + [(90, [None, 1.0]), (91, [float("nan"), 1.0]), (92, [3.0, 1.0])], "id long, features array<double>")
    query = spark.createDataFrame([(1, [1.0, 1.0]), (2, [3.0, 1.0]), (3, [None, 1.0]), (4, [1.0, 1.0])], "id long, features array<double>")
    got = {q: [r["tid"] for r in sorted(knn(query, train, 3).collect(), key=lambda r: r["rank"]) if r["qid"] == q] for q in (1, 2, 3, 4)}
    assert got == {1: [0, 1, 2], 2: [92, 0, 1], 3: [], 4: [0, 1, 2]}


def test_validation_scores_rows_once(spark, tmp_path):
    from labelgrow.plans.loop import validate
    from labelgrow.plans.models import Fitted

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(y):
        seen.add(1)
        return float(y)

    val = spark.createDataFrame([(i, i % 2) for i in range(20)], "id long, y int")
    fitted = Fitted("any", lambda df: df.withColumn("prob", score("y")).withColumn("pred", F.col("prob").cast("int")), {})
    assert validate(fitted, val, f"file://{tmp_path}/scored")["roc_auc"] == 1.0
    assert seen.value <= 40  # the column may be made for prob and pred; metrics made it three times as often


@pytest.mark.parametrize("size,shift", [(1.0, 0.0), (1e-3, 1e6), (1e20, 0.0), (1e-200, 0.0), (1e100, 1e100)])
def test_knn_single_precision_loses_nothing(size, shift):
    from labelgrow.operators import neighbors

    rng = np.random.default_rng(2)
    x, q = (rng.normal(size=(n, 8)) * size + shift for n in (700, 60))
    x[:20], q[:20] = x[20:40], x[20:40]  # ties
    d2 = np.cumsum((q[:, None] - x[None]) ** 2, axis=2)[:, :, -1]
    want = np.lexsort((np.broadcast_to(np.arange(len(x)), d2.shape), d2), axis=1)[:, :4]
    got = pa.Table.from_batches(neighbors._Block(np.arange(len(x)), x).nearest(np.arange(len(q)), q, 4))
    assert got["tid"].to_numpy().reshape(-1, 4).tolist() == want.tolist()


def test_knn_by_blocks_uses_all_cores(spark, monkeypatch):
    from labelgrow.operators import neighbors

    df, seen, by_blocks = spark.createDataFrame([(i, [float(i)]) for i in range(40)], "id long, features array<double>"), [], neighbors._by_blocks
    monkeypatch.setattr(neighbors, "_by_blocks", lambda *a: seen.append(a[3] * a[4]) or by_blocks(*a))
    assert knn(df, df, 1, block_bytes=320).count() == 40
    assert seen[0] >= 3 * spark.sparkContext.defaultParallelism  # two blocks of one piece were two tasks


def test_whole_job_is_registered_with_its_whole_setting(spark, monkeypatch):
    from types import SimpleNamespace

    from labelgrow import queries
    from labelgrow.functions.features import SETS
    from labelgrow.plans.models import NAMES

    seen = {"errors": []}
    monkeypatch.setattr(queries, "run_pipeline", lambda raw, cfg, folder: seen.update(raw=raw, cfg=cfg) or SimpleNamespace(grid=raw, errors=seen["errors"]))
    queries.queries()["run_pipeline"](spark, "/root/testdata/sf0.001")
    cfg = seen["cfg"]
    assert set(cfg.models) == set(NAMES) and set(cfg.feature_sets) == set(SETS) and not cfg.parameters  # 2 of 5 and 2 of 17
    assert cfg.loop == LoopConfig() and cfg.sampler == SamplerConfig()  # 2 iterations of 50
    plan = seen["raw"].select("key", "quality")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("md5(")  # keys were made of joined texts
    seen["errors"] = [("knn", "PathFP", "lost")]
    with pytest.raises(RuntimeError, match="PathFP"):  # the rest of the grid was returned as if it were all
        queries.queries()["run_pipeline"](spark, "/root/testdata/sf0.001")


def test_texts_of_one_file_are_dealt_out(spark):
    from labelgrow.plans.pipeline import dealt

    few, cores = spark.range(100).coalesce(1), spark.sparkContext.defaultParallelism
    assert dealt(few).rdd.getNumPartitions() >= cores and dealt(few).count() == 100  # one task made all features
    assert dealt(spark.range(100, numPartitions=cores)).rdd.getNumPartitions() == cores
