"""The models' sums, changepoints, recursions and intervals against plain NumPy."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aircast.plans import forecast as FC
from aircast.plans import gram as G
from aircast.plans import intervals as IV
from aircast.plans import models as M
from aircast.plans.daily_tables import feature_table
from aircast.plans.series import each_series
from aircast.sources import fixtures as fx

SF = "/root/testdata/sf0.01"


@pytest.fixture
def small_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def design(n=80, seed=0, bend=None):
    """Rows of one temperature series with weather-like columns and, from day ``bend`` on, another trend."""
    r = np.random.default_rng(seed)
    base = dt.date(2024, 3, 1)
    rows = []
    for i in range(n):
        out = 10 + 5 * np.sin(i / 9) + r.normal()
        trend = 0.15 * max(i - bend, 0) if bend is not None else 0.0
        rows.append((1, base + dt.timedelta(days=i), 18 + 0.2 * out + trend + 0.2 * r.normal(), out, out - 5 + r.normal(), r.random(), int(r.integers(0, 100)), r.random() * 20,
                     r.random() * 10, (i + 4) % 7 >= 5, False, 18 + r.normal(), 18 + r.normal(), np.sin(2 * np.pi * i / 7), np.cos(2 * np.pi * i / 7)))
    return [tuple(v.item() if hasattr(v, "item") else v for v in row) for row in rows]


SCHEMA = (
    "room_id bigint, ds date, temp_mean double, outside_temp_max double, outside_temp_min double, precipitation double, cloudcover int, wind double, "
    "solar_radiation double, is_weekend boolean, is_holiday boolean, temp_lag1 double, temp_lag2 double, day_sin double, day_cos double"
)


def test_sums_by_batches_equal_aggregates(spark, small_batches):
    r = np.random.default_rng(3)
    rows = [(int(k), "ab"[k % 2], [1.0, *map(float, r.normal(size=3))], float(r.normal())) for k in r.integers(0, 9, 200)]
    df = spark.createDataFrame(rows, "room_id int, part string, x array<double>, y double").repartition(5)
    keys = ["room_id", "part"]

    def solver(cols, g, xty, yty):
        return {"g": g[:, np.triu_indices(4)[0], np.triu_indices(4)[1]], "xty": xty, "yty": yty, "top": cols["top"][:, 0]}

    got = {(t.room_id, t.part): t for t in G.fit(df, keys, solver, "g array<double>, xty array<double>, yty double, top double", greatest=["y"]).collect()}
    want = df.groupBy(*keys).agg(*G.gram_exprs(F.col("x"), F.col("y"), 4), F.max(F.abs("y")).alias("top")).collect()
    assert len(got) == len(want)
    for w in want:
        t = got[w.room_id, w.part]
        assert t.n == w.n and np.allclose(t.g, w.xtx) and np.allclose(t.xty, w.xty) and np.isclose(t.yty, w.yty) and t.top == w.top
    assert G.fit(df.limit(0), keys, solver, "g array<double>, xty array<double>, yty double, top double").count() == 0


def test_series_passes_see_whole_series(spark, small_batches):
    rows = [(k, i) for k in (None, 1, 2, 3, 4) for i in range([1, 30, 7, 2, 14][k or 0])]
    df = spark.createDataFrame(rows, "room_id int, day int").repartition(3)

    def run(t: pa.Table, first: np.ndarray) -> dict:
        days = np.asarray(t.column("day"))
        assert all((days[a:z] == np.arange(z - a)).all() for a, z in zip(first[:-1], first[1:]))
        return {"room_id": t.column("room_id").combine_chunks().take(pa.array(first[:-1])), "n": np.diff(first)}

    got = {r.room_id: r.n for r in each_series(df, ["room_id"], "day", run, "room_id int, n bigint").collect()}
    assert got == {None: 1, 1: 30, 2: 7, 3: 2, 4: 14}
    assert each_series(df.where("room_id = 1").drop("room_id"), [], "day", lambda t, f: {"n": np.diff(f)}, "n bigint").first().n == 30


def plain_descent(X, H, y, pen, alpha):
    """Coordinate descent on the rows, every weight in turn."""
    Z = np.hstack([X, H])
    w, r = np.zeros(Z.shape[1]), y.copy()
    square = (Z**2).sum(0)
    k = X.shape[1]
    for _ in range(200_000):
        most = 0.0
        for j in range(Z.shape[1]):
            if square[j] == 0:
                continue
            g = Z[:, j] @ r + square[j] * w[j]
            new = g / (square[j] + pen[j]) if j < k else np.sign(g) * max(abs(g) - alpha, 0) / square[j]
            if new != w[j]:
                r -= Z[:, j] * (new - w[j])
                most = max(most, abs(new - w[j]) * np.sqrt(square[j]))
                w[j] = new
        if most < 1e-11:
            break
    return w


@pytest.mark.parametrize("prior", [0.001, 0.05, 1.0])
def test_changepoints_equal_coordinate_descent_on_rows(spark, prior):
    f = spark.createDataFrame(design(bend=40), SCHEMA)
    m = M.fit_temp(f, prior=prior).first()
    d = M.temp_design(f, M.regressor_gate(f)).orderBy("ds").toPandas()
    X, y = np.array(d.x.tolist()), d.y.to_numpy()
    H = np.array(d.xh.tolist())[:, X.shape[1] :]
    last = int(80 * 0.8) - 1
    assert m.bends == [float(np.rint(last * j / 5)) for j in range(1, 6)]
    std = np.array(M.TEMP_STD) & (X.std(0) > 0)
    keep = (X.std(0) > 0) | (np.arange(X.shape[1]) == 0)
    Z = np.where(std, (X - X.mean(0)) / np.where(std, X.std(0), 1), X)[:, keep]
    pen = np.array(M.TEMP_PEN, float)[keep]
    ridge = np.linalg.solve(Z.T @ Z + np.diag(pen), Z.T @ y)
    alpha = ((y - Z @ ridge) ** 2).mean() / (prior * np.abs(y).max())
    w = plain_descent(Z, H, y, pen, alpha)
    fit = X @ np.array(m.beta) + H @ np.array(m.delta)
    assert np.allclose(np.array(m.delta), w[len(pen) :], atol=1e-8 * max(1, np.abs(w).max()))
    assert np.allclose(fit, np.hstack([Z, H]) @ w, atol=1e-7)

    def objective(c, delta):
        return 0.5 * ((y - Z @ c - H @ delta) ** 2).sum() + 0.5 * (pen * c * c).sum() + alpha * np.abs(delta).sum()

    assert objective(w[: len(pen)], w[len(pen) :]) <= objective(ridge, np.zeros(5)) + 1e-9
    assert (m.n_bends > 0) == (prior == 1.0) or prior == 0.05
    got = {r.ds: r.yhat for r in M.temp_fitted(f, M.fit_temp(f, prior=prior)).collect()}
    assert np.allclose([got[x] for x in d.ds], fit, atol=1e-8)


def test_short_spans_have_no_changepoints(spark):
    m = M.fit_temp(spark.createDataFrame(design(n=21, bend=5), SCHEMA), prior=10.0).first()
    assert m.span_days == 20 and m.n_bends == 0 and m.delta == [0.0] * 5 and m.bends == [None] * 5
    assert M.fit_temp(spark.createDataFrame(design(n=22, bend=5), SCHEMA), prior=10.0).first().n_bends > 0


def plain_recursion(X, y, lam):
    """The recursion of ``extended_least_squares``, afresh for every day from all earlier ones."""
    n, k = X.shape
    preds = []
    for test in range(n):
        theta, P, e = np.zeros(k + 4), np.eye(k + 4) / lam, 0.0
        for t in range(test + 1):
            lag = [y[t - j] - X[t - j] @ theta[:k] if t >= j else 0.0 for j in (1, 2)]
            psi = np.array([*X[t], *lag, t + 1.0, e])
            if t == test:
                preds.append(psi @ theta)
                break
            gain = P @ psi / (1 + psi @ P @ psi)
            theta = theta + gain * (y[t] - psi @ theta)
            P = P - np.outer(gain, psi @ P)
            e = y[t] - psi @ theta
    return np.array(preds)


def test_walk_forward_with_ma_equals_the_recursion(spark):
    f = feature_table(spark, SF).where("room_id IN (0, 4)")
    for room in (0, 4):
        d = f.where(F.col("room_id") == room).orderBy("ds").toPandas()
        want = plain_recursion(d[M.CO2_EXOG].astype(float).to_numpy(), d.co2_mean.to_numpy(float), 1e-3)
        rows = M.walk_forward_ma(f).where(F.col("room_id") == room).collect()
        place = {x: i for i, x in enumerate(d.ds)}
        assert len(rows) == len(d) - (int(len(d) * 0.6) + 1)
        for r in rows:
            assert abs(r.pred - want[place[r.test_ds]]) <= 1e-6 * max(1, abs(r.pred)) and r.n == place[r.test_ds] - 2
    same = {(r.room_id, r.test_ds, r.n) for r in M.walk_forward(f).collect()}
    assert same == {(r.room_id, r.test_ds, r.n) for r in M.walk_forward_ma(f).collect()}


def test_recursion_finds_the_parameters():
    r = np.random.default_rng(5)
    n, x = 4000, None
    x, e = r.normal(size=(n, 2)), r.normal(size=n)
    u = np.zeros(n)
    for t in range(2, n):
        u[t] = 0.5 * u[t - 1] - 0.3 * u[t - 2] + e[t] + 0.6 * e[t - 1]
    y = x @ [2.0, -1.0] + u
    pred = M.extended_least_squares(y[None], x[None], np.array([n]), 1e-3)[0]
    assert abs((y - pred)[n // 2 :].std() - 1.0) < 0.05  # only the new noise is left


def test_standard_errors_match_the_closed_form(spark):
    f = feature_table(spark, SF).where("room_id = 7")
    m, rows = M.fit_co2(f)
    d = f.orderBy("ds").toPandas()
    X, y = d[M.CO2_EXOG].astype(float).to_numpy(), d.co2_mean.to_numpy(float)
    keep = X.std(0) > 0
    A = X[:, keep]
    inv = np.linalg.inv(A.T @ A + 1e-6 * np.eye(A.shape[1]))
    b = inv @ A.T @ y
    se = np.sqrt(((y - A @ b) ** 2).sum() / (len(y) - A.shape[1]) * np.diag(inv))
    got = {r.term: (r.value, r.std_err) for r in M.co2_coefficients(m).collect()}
    for name, value, error in zip(np.array(M.CO2_EXOG)[keep], b, se):
        assert np.allclose(got[name], (value, error), rtol=1e-5)
    u, r = y - A @ b, rows.orderBy("ds").toPandas()
    Z = np.column_stack([u[2:-1], u[1:-2], np.arange(4, len(u) + 1.0), r.e1.to_numpy(float)[3:]])
    inv = np.linalg.inv(Z.T @ Z + 1e-6 * np.eye(4))
    c = inv @ Z.T @ u[3:]
    se = np.sqrt(((u[3:] - Z @ c) ** 2).sum() / (len(u) - 3 - 4) * np.diag(inv))
    for name, value, error in zip(("ar.L1", "ar.L2", "drift", "ma.L1"), c, se):
        assert np.allclose(got[name], (value, error), rtol=1e-4)


def test_intervals_cover_and_repeat():
    r = np.random.default_rng(11)
    s, steps = 600, 7
    seeds = r.integers(0, 2**62, s)
    base, wide = r.normal(20, 2, (s, steps)), np.full((s, steps), 1e9)
    b1, b2, sigma = np.full(s, 0.5), np.full(s, 0.2), np.full(s, 0.4)
    l1, l2 = r.normal(size=s), r.normal(size=s)
    none = np.zeros((s, 1, steps))
    paths = IV.temp_trajectories(base, -wide, wide, l1, l2, b1, b2, sigma, none, IV.normals(seeds, 1, 500, steps))
    truth = IV.temp_trajectories(base, -wide, wide, l1, l2, b1, b2, sigma, none, r.normal(size=(s, 1, steps)))[:, 0]
    lo, hi = np.quantile(paths, [0.1, 0.9], axis=1)
    assert abs(((truth >= lo) & (truth <= hi)).mean() - 0.8) < 0.03
    assert (np.diff((hi - lo).mean(0)) > 0).all()  # errors feed back through the lags
    again = IV.normals(seeds[::-1].copy(), 1, 500, steps)[::-1]
    assert (again == IV.normals(seeds, 1, 500, steps)).all()
    args = [r.normal(size=s) * 0.1, r.normal(size=s) * 0.1, np.zeros(s), np.full(s, 0.4), np.full(s, 0.2), np.zeros(s), np.full(s, 0.3), np.ones(s)]
    co2 = IV.co2_trajectories(base, np.ones((s, steps)), *args, IV.normals(seeds, 3, 500, steps))
    truth = IV.co2_trajectories(base, np.ones((s, steps)), *args, r.normal(size=(s, 1, steps)))[:, 0]
    lo, hi = np.quantile(co2, [0.1, 0.9], axis=1)
    assert abs(((truth >= lo) & (truth <= hi)).mean() - 0.8) < 0.03
    bends = IV.trend_bends(seeds, np.full((s, 5), 2.0), np.full(s, 10.0), steps, 200)
    assert bends.std() > 0 and (bends[:, :, 0] == 0).all() and not IV.trend_bends(seeds, np.zeros((s, 5)), np.full(s, 10.0), steps, 3).any()


@pytest.fixture(scope="module")
def runs(spark):
    f = feature_table(spark, SF).where("room_id < 4")
    return f.cache(), FC.forecast_runs(f, fx.weather(spark, SF)).cache()


def test_runs_see_only_earlier_days(spark, runs):
    f, got = runs
    w = fx.weather(spark, SF)
    last = {r.room_id: r.d for r in f.groupBy("room_id").agg(F.max("ds").alias("d")).collect()}
    assert {(r.room_id, (last[r.room_id] - r.run_id).days) for r in got.collect()} == {(k, n) for k in last for n in (0, 7, 14)}
    cut = f.where(F.col("room_id") == 2).where(F.col("ds") <= last[2] - dt.timedelta(days=7))
    alone = {r.ds: r for r in FC.run_forecast(cut, w).collect()}
    for r in got.where(F.col("room_id") == 2).where(F.col("h") > 0).collect():
        if (last[2] - r.run_id).days == 7:
            assert abs(r.pred_temp - alone[r.ds].pred_temp) < 1e-9 and abs(r.pred_co2 - alone[r.ds].pred_co2) <= 1e-6 * max(1, abs(r.pred_co2))
            assert r.advies == alone[r.ds].advies and r.status == alone[r.ds].status


def test_bounds_hold_the_prediction(runs):
    for r in runs[1].collect():
        assert r.pred_temp_lower <= r.pred_temp_upper and r.pred_co2_lower < r.pred_co2 < r.pred_co2_upper
    twice = FC.run_forecast(runs[0], fx.weather(runs[0].sparkSession, SF)).select("room_id", "ds", "pred_co2_lower", "pred_temp_upper")
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, twice.repartition(3).collect()))


def test_too_few_days_say_so(spark, runs):
    short = runs[0].where(F.col("ds") < "2024-01-06")
    rows = FC.run_forecast(short, fx.weather(spark, SF)).collect()
    assert rows and all(r.status == "too_few_days" and r.pred_temp is None and r.pred_co2 is None and r.advies is None for r in rows)
    assert FC.forecast_runs(short, fx.weather(spark, SF)).count() == 0  # refused
