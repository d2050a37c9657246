"""Per-series models fitted from distributed sums.

Prophet and SARIMAX are single-machine solvers; the re-aim (see README) is, for temperature,
a ridge regression per series (Gaussian priors = ridge penalty) whose trend may
bend at changepoints (Laplace prior = L1 penalty), and, for CO2, a regression with AR(2)
errors, drift and MA(1) estimated in least-squares passes (Hannan-
Rissanen).  Each model needs one matrix of sums per series (``gram.fit``): lags and
the first and last rows are columns of the design, so all passes, the forecast's
seeds and the standard errors follow from it.  Predictions are built-in array expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import DEFAULT_KEYS
from ..keys import kjoin
from ..operators.windows import neighbours
from . import gram as G
from .series import each_series

# ------------------------------------------------------------ temperature
# The regressors of both models.
TEMP_REGRESSORS = [
    "outside_temp_max", "outside_temp_min", "precipitation", "cloudcover", "wind", "solar_radiation",
    "is_weekend", "is_holiday", "temp_lag1", "temp_lag2", "day_sin", "day_cos",
]
TEMP_SMALL = ["outside_temp_max", "outside_temp_min", "temp_lag1"]
FOURIER_ORDER = 3  # weekly seasonality order
#: Places where the trend may bend, the part of the days that they lie in, the prior's scale,
#: and the span from which there are any (as for all but the key regressors).
CHANGEPOINTS, CHANGEPOINT_RANGE, CHANGEPOINT_PRIOR, FULL_SPAN = 5, 0.8, 0.001, 21
FOURIER_TERMS = [f"wk_{f}{k}" for k in range(1, FOURIER_ORDER + 1) for f in ("sin", "cos")]
TEMP_TERMS = ["const", "t", *TEMP_REGRESSORS, *FOURIER_TERMS]
BOOL_TERMS = {"is_weekend", "is_holiday", "rapid_rise"}
LAG1_IDX = TEMP_TERMS.index("temp_lag1")
LAG2_IDX = TEMP_TERMS.index("temp_lag2")


#: Fixed value: days of a year in the yearly terms.
YEAR = 365.25


def weekly_fourier(df: DataFrame, *, day: str = "ds", order: int = FOURIER_ORDER, yearly: int = 0) -> DataFrame:
    """K3: sin / cos(2 pi k t / 7), t in days since 1970-01-01, k = 1..order; and the same by the
    year, up to the order ``yearly`` (the older variant has 10)."""
    t = F.date_diff(F.col(day), F.lit("1970-01-01").cast("date")).cast("double")
    for name, period, last in (("wk", 7.0, order), ("yr", YEAR, yearly)):
        for k in range(1, last + 1):
            a = F.lit(2 * math.pi * k) * t / F.lit(period)
            df = df.withColumn(f"{name}_sin{k}", F.sin(a)).withColumn(f"{name}_cos{k}", F.cos(a))
    return df


def temp_terms(yearly: int = 0) -> list[str]:
    """The terms of the temperature design."""
    return TEMP_TERMS + [f"yr_{f}{k}" for k in range(1, yearly + 1) for f in ("sin", "cos")]


def gate_columns(span: Column, *, yearly: int = 0, bends: int = CHANGEPOINTS, full_span: int = FULL_SPAN) -> dict[str, Column]:
    """K2 by the span of the days that are fitted: the regressors in use, and the days (from the first
    one) where the trend may bend: evenly over the first 80 % of the days."""
    small = span < full_span
    terms = temp_terms(yearly)
    masks = [[t in ("const", "t", *TEMP_SMALL) for t in terms], [True] * len(terms)]
    small_use, full_use = (F.array(*[F.lit(b) for b in m]) for m in masks)
    last = F.floor((span + 1) * CHANGEPOINT_RANGE) - 1
    places = F.array(*[F.rint(last * F.lit(j / bends)) for j in range(1, bends + 1)])
    none = F.array(*[F.lit(None).cast("double")] * bends)
    return {
        "n_regressors": F.when(small, len(TEMP_SMALL)).otherwise(len(TEMP_REGRESSORS)).cast("bigint"),
        "weekly": ~small,
        "n_changepoints": F.when(small, 0).otherwise(bends).cast("bigint"),
        "warn_small": span < 30,
        "use": F.when(small, small_use).otherwise(full_use),
        "bends": F.when(small, none).otherwise(places),
    }


def regressor_gate(feats: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, **how) -> DataFrame:
    """K2: per series span -> regressor set, weekly terms, changepoints (``how``: see ``gate_columns``)."""
    span = F.date_diff(F.max("ds"), F.min("ds"))
    g = feats.groupBy(*keys).agg(span.cast("bigint").alias("span_days"), F.min("ds").alias("first_ds"))
    cols = gate_columns(F.col("span_days"), **how)
    return g.select(*keys, "span_days", "first_ds", *[c.alias(n) for n, c in cols.items()])


def hinges(t: Column, bends: Column, span: Column) -> Column:
    """max(t - bend, 0) in spans, of each changepoint (0 where there is none)."""
    wide = F.greatest(span.cast("double"), F.lit(1.0))
    return F.transform(bends, lambda s: F.coalesce(F.greatest(t.cast("double") - s, F.lit(0.0)) / wide, F.lit(0.0)))


def temp_vector(t: Column, cols: dict[str, Column] | None = None, yearly: int = 0) -> Column:
    """Design vector in the order of ``temp_terms`` from current-row columns."""
    cols = cols or {}
    parts = []
    for term in temp_terms(yearly):
        if term == "const":
            parts.append(F.lit(1.0))
        elif term == "t":
            parts.append(t.cast("double"))
        else:
            parts.append(cols.get(term, F.col(term)).cast("double"))
    return F.array(*parts)


def temp_design(feats: DataFrame, gate: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, yearly: int = 0) -> DataFrame:
    """y, x (``temp_terms``), t (days from the first one) and xh (x and the changepoints' hinges)."""
    d = kjoin(weekly_fourier(feats, yearly=yearly), gate.select(*keys, "first_ds", "span_days", "use", "bends"), keys)
    d = d.withColumn("t", F.date_diff(F.col("ds"), F.col("first_ds")).cast("double"))
    d = d.withColumn("x", temp_vector(F.col("t"), yearly=yearly)).withColumn("y", F.col("temp_mean").cast("double"))
    return d.withColumn("xh", F.concat("x", hinges(F.col("t"), F.col("bends"), F.col("span_days"))))


TEMP_STD = [t not in ("const", *BOOL_TERMS) for t in TEMP_TERMS]
TEMP_PEN = [t not in ("const", "t") for t in TEMP_TERMS]
TEMP_FIT = "beta array<double>, status string, dropped array<int>, delta array<double>, sigma double, n_bends bigint"


def temp_solver(lam: float, prior: float | None, yearly: int = 0):
    """Ridge on the regressors and L1 on the hinges, from the sums alone.

    For given hinges the ridge part has a closed form; put into the objective it leaves a
    problem in the few hinge weights, which coordinate descent solves.  The L1 weight is that of
    a Laplace prior of scale ``prior`` on the trend in units of the largest |y|, with the ridge
    fit's noise; None: no hinges."""
    p = len(TEMP_TERMS) + 2 * yearly
    std, pen = (np.array(f + [True] * (2 * yearly)) for f in (TEMP_STD, TEMP_PEN))

    def run(cols: dict, g: np.ndarray, xty: np.ndarray, yty: np.ndarray) -> dict:
        use = G.matrix(cols["use"]) > 0
        beta, status, dropped, a, inverse = G.ridge(g[:, :p, :p], xty[:, :p], use, std, pen, lam)
        n = np.maximum(cols["n"], 1)

        def squares(w: np.ndarray) -> np.ndarray:
            return np.maximum(yty - 2 * np.einsum("si,si->s", w, xty) + np.einsum("si,sij,sj->s", w, g, w), 0)

        delta = np.zeros((len(g), g.shape[1] - p))
        whole = np.hstack([beta, delta])
        if prior is not None and delta.shape[1]:
            weight = squares(whole) / n / np.maximum(prior * cols["top"][:, 0], 1e-12)
            project = a.transpose(0, 2, 1) @ inverse @ a
            gh = g[:, :p, p:]
            q = g[:, p:, p:] - gh.transpose(0, 2, 1) @ project @ gh
            r = xty[:, p:] - np.einsum("sph,spq,sq->sh", gh, project, xty[:, :p])
            ok = (np.asarray(status) == "ok") & np.isfinite(q).all((1, 2))
            delta[ok] = G.lasso(q[ok], r[ok], weight[ok])
            beta = np.einsum("spq,sq->sp", project, xty[:, :p] - np.einsum("sph,sh->sp", gh, delta))
            whole = np.hstack([beta, delta])
        # the noise per degree of freedom: a penalised weight takes less than one
        kept = np.einsum("sii->si", inverse) > 0
        held = lam * (np.einsum("sii->si", inverse) * pen).sum(1)
        free = np.maximum(n - kept.sum(1) + held - (delta != 0).sum(1), 1)
        return {
            "beta": beta, "status": list(status), "dropped": dropped, "delta": delta + 0.0,
            "sigma": np.sqrt(squares(whole) / free), "n_bends": (delta != 0).sum(1),
        }

    return run


def fit_temp(feats: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, lam: float = 1.0, gate: DataFrame | None = None,
             prior: float | None = CHANGEPOINT_PRIOR, yearly: int = 0) -> DataFrame:
    """K4: ridge per series on the K2-gated design (standardised columns,
    penalty lam on every term but intercept and trend) with changepoints of the trend.  ``yearly``: the order
    of yearly seasonal terms (``gate`` must be made with the same)."""
    gate = gate if gate is not None else regressor_gate(feats, keys=keys, yearly=yearly)
    d = temp_design(feats, gate, keys=keys, yearly=yearly)
    m = G.fit(d, keys, temp_solver(lam, prior, yearly), TEMP_FIT, x="xh", carry=["first_ds", "span_days", "use", "bends"], greatest=["y"])
    return with_status(m.drop("use"), temp_terms(yearly))


def temp_value(x: Column, t: Column, *, bends: str = "bends", span: str = "span_days") -> Column:
    """The model's value from the columns beta, delta, bends and span_days."""
    return G.dot(x, F.col("beta")) + G.dot(hinges(t, F.col(bends), F.col(span)), F.col("delta"))


def with_status(m: DataFrame, terms: Sequence[str], *, min_days: int = 7) -> DataFrame:
    """Per-series model status (never an exception): too_few_days / the
    solve's ok or singular; span flags; dropped terms by name."""
    names = F.array(*[F.lit(t) for t in terms])
    st = F.when(F.col("n") < min_days, F.lit("too_few_days")).otherwise(F.col("status"))
    out = m.withColumn("status", st).withColumn("dropped_terms", F.transform("dropped", lambda i: F.element_at(names, i + 1)))
    if "span_days" in m.columns:
        out = (
            out.withColumn("span_lt_14", F.col("span_days") < 14)
            .withColumn("span_lt_21", F.col("span_days") < 21)
            .withColumn("span_lt_30", F.col("span_days") < 30)
        )
    return out


def temp_trend_ols(feats: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """K5: the one-regressor case (temp on outside max), pure SQL aggregates."""
    y, x = F.col("temp_mean"), F.col("outside_temp_max")
    return feats.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )


def temp_fitted(feats: DataFrame, models: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, yearly: int = 0) -> DataFrame:
    """K9 (temperature): in-sample predictions."""
    d = kjoin(weekly_fourier(feats, yearly=yearly), models.select(*keys, "first_ds", "span_days", "bends", "beta", "delta"), keys)
    t = F.date_diff(F.col("ds"), F.col("first_ds")).cast("double")
    return d.select(*keys, "ds", F.col("temp_mean").alias("y"), temp_value(temp_vector(t, yearly=yearly), t).alias("yhat"))


# -------------------------------------------------------------------- CO2
CO2_EXOG = ["presence_ratio", "hum_mean", "is_weekend", "is_holiday", "co2_diff1", "rapid_rise"]
CO2_TERMS = ["const", *CO2_EXOG]
# the older variant's nine exogenous columns (adds temp_diff, cloudcover,
# day_cos, sleep_time_ratio; drops is_weekend)
CO2_EXOG_OLD = ["presence_ratio", "hum_mean", "is_holiday", "co2_diff1", "rapid_rise", "temp_diff", "cloudcover",
                "day_cos", "sleep_time_ratio"]


def co2_exog(feats: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, leak_free: bool = False,
             exog: Sequence[str] = tuple(CO2_EXOG)) -> DataFrame:
    """x = the six exogenous columns as doubles; ``leak_free`` replaces the
    two that contain the target by their one-day lags (0 on the first day)."""
    d = feats
    if leak_free:
        w = Window.partitionBy(*keys).orderBy("ds")
        d = d.withColumn("co2_diff1", F.coalesce(F.lag("co2_diff1").over(w), F.lit(0.0))).withColumn(
            "rapid_rise", F.coalesce(F.lag("rapid_rise").over(w), F.lit(False))
        )
    return d.withColumn("x", F.array(F.lit(1.0), *[F.col(c).cast("double") for c in exog])).withColumn(
        "y", F.col("co2_mean").cast("double")
    )


def co2_lags(feats: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, leak_free: bool = False,
             exog: Sequence[str] = tuple(CO2_EXOG)) -> DataFrame:
    """``co2_exog`` with t (the row number) and y1..y3, x1..x3 (lags; x without its constant)."""
    w = Window.partitionBy(*keys).orderBy("ds")
    d = co2_exog(feats, keys=keys, leak_free=leak_free, exog=exog).withColumn("t", F.row_number().over(w).cast("double"))
    d = d.withColumn("xe", F.slice("x", 2, len(exog)))
    lags = {f"{c}{n}": F.lag(v, n).over(w) for n in (1, 2, 3) for c, v in (("y", "y"), ("x", "xe"))}
    return d.withColumns({**lags, "last": F.lead("ds").over(w).isNull()})


class Layout:
    """Places in the stacked design: 1, y and x, their lags 1 to 3, t, and flags of rows 1, 2, 3 and the last."""

    def __init__(self, k: int):
        self.k, self.p = k, 4 * k + 6
        self.y = [1 + n * (k + 1) for n in range(4)]
        self.t = 4 * k + 5
        self.x = [0, *range(2, k + 2)]  # with the constant

    def columns(self) -> Column:
        """The design (missing lags are 0) with its flags, from the columns of ``co2_lags``."""
        zeros = F.array(*[F.lit(0.0)] * self.k)
        parts = [F.array(F.lit(1.0))]
        for n in ("", "1", "2", "3"):
            parts += [F.array(F.coalesce(f"y{n}", F.lit(0.0))), F.coalesce(F.col(f"x{n}" if n else "xe"), zeros)]
        flags = [(F.col("t") == v).cast("double") for v in (1, 2, 3)] + [F.col("last").cast("double")]
        return F.concat(*parts, F.array(F.col("t"), *flags))

    def rows(self, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The design of one series (without flags)."""
        out = np.zeros((len(y), self.p))
        out[:, 0], out[:, self.t] = 1.0, np.arange(1, len(y) + 1)
        for n, at in enumerate(self.y):
            out[n:, at] = y[: len(y) - n]
            out[n:, at + 1 : at + 1 + self.k] = x[: len(y) - n]
        return out

    def residual(self, bx: np.ndarray, lag: int) -> np.ndarray:
        """(S, p): u at a lag, y - x.beta, as a linear form of the design."""
        out = np.zeros((len(bx), self.p))
        at = self.y[lag]
        out[:, at], out[:, at + 1 : at + 1 + self.k] = 1.0, -bx
        return out


def co2_system(lay: Layout, g: np.ndarray, heads: np.ndarray, lam: float, ma: bool) -> dict:
    """All passes of K6 for many series from their matrices ``g`` (S, p, p) and their first three
    design rows ``heads`` (S, 3, p; zero where there are fewer)."""
    s, one = len(g), np.zeros((len(g), lay.p))
    one[:, 0] = 1.0
    n = g[:, 0, 0]
    ga = g[:, lay.x][:, :, lay.x]
    use = np.array([False] + [True] * lay.k)
    beta, status, dropped, _, inverse = G.ridge(ga, g[:, lay.x, 1], use, np.zeros(lay.k + 1, bool), np.ones(lay.k + 1, bool), lam)
    rss = g[:, 1, 1] - 2 * np.einsum("si,si->s", beta, g[:, lay.x, 1]) + np.einsum("si,sij,sj->s", beta, ga, beta)
    used = np.array([lay.k - len(d) for d in dropped])
    free = np.maximum(n - used, 1)
    se = np.sqrt(np.maximum(rss, 0)[:, None] / free[:, None] * np.einsum("sii->si", inverse))
    u = [lay.residual(beta[:, 1:], lag) for lag in range(4)]
    time = np.zeros((s, lay.p))
    time[:, lay.t] = 1.0
    with np.errstate(invalid="ignore"):
        gb = g - np.einsum("shi,shj->sij", heads[:, :2], heads[:, :2])  # days with both lags
        gc = gb - heads[:, 2, :, None] * heads[:, 2, None, :]  # and with a lagged residual of the first pass

    def regress(forms: list[np.ndarray], sums: np.ndarray, days: np.ndarray):
        basis = np.stack([one, *forms], 1)
        inner, right = basis @ sums @ basis.transpose(0, 2, 1), np.einsum("sbi,sij,sj->sb", basis, sums, u[0])
        flags = np.array([False] + [True] * len(forms))
        c, _, _, _, inv = G.ridge(inner, right, flags, ~flags & False, np.ones(len(flags), bool), lam)
        left = np.einsum("si,sij,sj->s", u[0], sums, u[0]) - 2 * np.einsum("sb,sb->s", c, right) + np.einsum("sb,sbd,sd->s", c, inner, c)
        spread = np.maximum(left, 0)
        errors = np.sqrt(spread[:, None] / np.maximum(days - len(forms), 1)[:, None] * np.einsum("sii->si", inv))
        c, errors = (np.where(days[:, None] > 0, v, np.nan) for v in (c, errors))
        return c, errors, np.sqrt(spread / np.maximum(days - len(forms) - used, 1))

    first, errors, sigma = regress([u[1], u[2], time], gb, n - 2)
    out = {"beta": beta, "status": status, "dropped": dropped, "se": se, "first": first, "forms": u}
    if ma:
        b = np.nan_to_num(first)
        e1 = u[1] - b[:, 1:2] * u[2] - b[:, 2:3] * u[3] - b[:, 3:4] * (time - one)
        coef, errors, sigma = regress([u[1], u[2], time, e1], gc, n - 3)
        out["e1"] = e1
    else:
        coef = np.hstack([first, np.zeros((s, 1))])
        errors = np.hstack([errors, np.zeros((s, 1))])
    return out | {"coef": coef, "coef_se": errors, "sigma": np.where(np.isnan(coef[:, 1]), np.nan, sigma)}


CO2_FIT = (
    "beta array<double>, phi1 double, phi2 double, delta double, theta double, u_last double, u_prev double, eps_last double, "
    "t_last double, status string, dropped array<int>, sigma double, first array<double>, se array<double>, coef_se array<double>"
)


def none_for_nan(x: np.ndarray) -> pa.Array:
    return pa.array(x, mask=np.isnan(x))


def co2_solver(lay: Layout, lam: float, ma: bool):
    def run(cols: dict, g: np.ndarray, xty: np.ndarray, yty: np.ndarray) -> dict:
        p = lay.p
        heads, end = g[:, p : p + 3, :p], g[:, p + 3, :p]
        m = co2_system(lay, g[:, :p, :p], heads, lam, ma)
        u, coef, n = m["forms"], m["coef"], cols["n"]
        last, prev = (np.einsum("si,si->s", end, u[i]) for i in (0, 1))
        seen = [prev, np.einsum("si,si->s", end, u[2]), end[:, lay.t]]
        if ma:
            seen.append(np.einsum("si,si->s", end, m["e1"]))
        eps = last - sum(coef[:, i + 1] * v for i, v in enumerate(seen))
        return {
            "beta": m["beta"], **{c: none_for_nan(coef[:, i]) for i, c in ((1, "phi1"), (2, "phi2"), (3, "delta"), (4, "theta"))},
            "u_last": last, "u_prev": none_for_nan(np.where(n > 1, prev, np.nan)), "eps_last": none_for_nan(eps), "t_last": end[:, lay.t],
            "status": np.where(np.isnan(coef[:, 1]), "too_short", m["status"]).tolist(), "dropped": m["dropped"],
            "sigma": none_for_nan(m["sigma"]), "first": m["first"], "se": m["se"], "coef_se": m["coef_se"],
        }

    return run


def explosive(phi1: Column, phi2: Column) -> Column:
    """Whether u = phi1 u-1 + phi2 u-2 grows without bound (the source doesn't enforce stationarity)."""
    return ~((F.abs(phi2) < 1) & (phi1 + phi2 < 1) & (phi2 - phi1 < 1))


def fit_co2(feats: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, leak_free: bool = False, lam: float = 1e-6,
            ma: bool = True, exog: Sequence[str] = tuple(CO2_EXOG)) -> tuple[DataFrame, DataFrame]:
    """K6: y = x.beta + u, u = phi1 u-1 + phi2 u-2 + delta t + e + theta e-1.

    Pass A: beta from the Gram of (x, y).  Pass B: u on (u-1, u-2, t) gives
    phi, delta and the residual e.  Pass C: the same with e-1 added gives
    theta.  u and e are linear in y, x and their lags, so the sums of all passes
    are forms of one matrix.  Returns (models, rows) where rows carry u, e and fitted values."""
    keys, lay = list(keys), Layout(len(exog))
    d = co2_lags(feats, keys=keys, leak_free=leak_free, exog=exog)
    m = G.fit(d.withColumn("z", lay.columns()), keys, co2_solver(lay, lam, ma), CO2_FIT, x="z")
    models = with_status(m, ["const", *exog]).withColumn("explosive", explosive(F.col("phi1"), F.col("phi2")))
    j = kjoin(d, m.select(*keys, F.slice("beta", 2, len(exog)).alias("bx"), "phi1", "phi2", "delta", "theta", F.col("first").alias("f")), keys)
    j = j.withColumns({n: F.col(y) - G.dot(F.col(x), F.col("bx")) for n, y, x in (("u", "y", "xe"), ("u1", "y1", "x1"), ("u2", "y2", "x2"), ("u3", "y3", "x3"))})
    f = F.nanvl(F.col("f")[1], F.lit(None)), F.nanvl(F.col("f")[2], F.lit(None)), F.nanvl(F.col("f")[3], F.lit(None))
    j = j.withColumn("e", F.col("u") - (f[0] * F.col("u1") + f[1] * F.col("u2") + f[2] * F.col("t")))
    e1 = F.col("u1") - (f[0] * F.col("u2") + f[1] * F.col("u3") + f[2] * (F.col("t") - 1))
    j = j.withColumn("e1", e1 if ma else F.lit(None).cast("double"))
    ar = F.col("phi1") * F.col("u1") + F.col("phi2") * F.col("u2") + F.col("delta") * F.col("t")
    if ma:
        ar = ar + F.col("theta") * F.col("e1")
    j = j.withColumn("eps", F.col("u") - ar)
    return models, j.select(*keys, "ds", "t", "x", "y", "u", "u1", "u2", "e", "e1", "eps", (F.col("y") - F.col("eps")).alias("yhat"))


def co2_coefficients(models: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, exog: Sequence[str] = tuple(CO2_EXOG)) -> DataFrame:
    """K7: (keys, term, value, std_err) rows from the model table; the standard errors are those of the inverse
    penalised information matrix and the residual sum of each term's own pass."""
    terms = [(c, F.col("beta")[i], F.col("se")[i]) for i, c in enumerate(exog, start=1)]
    own = (("ar.L1", "phi1"), ("ar.L2", "phi2"), ("drift", "delta"), ("ma.L1", "theta"))
    terms += [(name, F.col(c), F.nanvl(F.col("coef_se")[i], F.lit(None))) for i, (name, c) in enumerate(own, start=1)]
    rows = F.array(*[F.struct(F.lit(t).alias("term"), v.alias("value"), e.alias("std_err")) for t, v, e in terms])
    return models.select(*keys, F.inline(rows))


def model_aic(rows: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, k: int = 10, model: str = "co2") -> DataFrame:
    """K8: n ln(RSS/n) + 2k over the fitted rows (k: estimated parameters)."""
    r = rows.where(F.col("yhat").isNotNull()).withColumn("_r", F.col("y") - F.col("yhat"))
    g = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_r") * F.col("_r")).alias("rss"))
    return g.select(*keys, F.lit(model).alias("model"), "n", "rss",
                    (F.col("n") * F.log(F.col("rss") / F.col("n")) + 2 * k).alias("aic"))


def temp_optimality(feats: DataFrame, models: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, lam: float = 1.0) -> DataFrame:
    """(keys, term, gradient): K4's normal equations, from the rows: what is left of z'(y - fit) - lam c for each
    term in use, relative to the size of its sums.  Zero where the fit is optimal (for the hinges the
    L1 weight decides, see the tests)."""
    keys = list(keys)
    m = models.select(*keys, "first_ds", "span_days", "bends", "beta", "delta")
    d = kjoin(weekly_fourier(feats), m, keys)
    t = F.date_diff(F.col("ds"), F.col("first_ds")).cast("double")
    d = d.withColumn("x", temp_vector(t))
    d = d.withColumn("r", F.col("temp_mean") - temp_value(F.col("x"), t))
    flags = [F.struct(F.lit(n).alias("term"), F.lit(s).alias("std"), F.lit(p).alias("pen")) for n, s, p in zip(TEMP_TERMS, TEMP_STD, TEMP_PEN)]
    rows = d.select(*keys, "r", F.inline(F.arrays_zip(F.array(*flags).alias("f"), F.col("x"), F.col("beta"))))
    g = rows.groupBy(*keys, "f").agg(
        F.count(F.lit(1)).alias("n"), F.first("beta").alias("b"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"),
        F.sum("r").alias("sr"), F.sum(F.col("x") * F.col("r")).alias("sxr"), F.sum(F.abs(F.col("x") * F.col("r"))).alias("size"),
    )
    mean = F.when(F.col("f.std"), F.col("sx") / F.col("n")).otherwise(F.lit(0.0))
    wide = F.when(F.col("f.std"), F.sqrt(F.greatest(F.col("sxx") / F.col("n") - mean * mean, F.lit(0.0)))).otherwise(F.lit(1.0))
    left = (F.col("sxr") - mean * F.col("sr")) / wide - F.when(F.col("f.pen"), lam * F.col("b") * wide).otherwise(F.lit(0.0))
    used = g.where((F.col("b") != 0) & (wide > 0))
    return used.select(*keys, "f.term", (left / (1 + F.col("size") / wide)).alias("gradient"))


def co2_optimality(rows: DataFrame, models: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, lam: float = 1e-6,
                   exog: Sequence[str] = tuple(CO2_EXOG)) -> DataFrame:
    """(keys, term, gradient): the same for the passes A (x on y) and C (u's lags, t, e-1 on u) of K6."""
    keys = list(keys)
    j = kjoin(rows, models.select(*keys, "beta", "phi1", "phi2", "delta", "theta"), keys)
    a = [F.struct(F.lit(c).alias("term"), F.col("x")[i].alias("v"), F.col("u").alias("r"), F.col("beta")[i].alias("b")) for i, c in enumerate(exog, 1)]
    own = (("ar.L1", "u1", "phi1"), ("ar.L2", "u2", "phi2"), ("drift", "t", "delta"), ("ma.L1", "e1", "theta"))
    c = [F.when(F.col("e1").isNotNull(), F.struct(F.lit(n).alias("term"), F.col(v).alias("v"), F.col("eps").alias("r"), F.col(b).alias("b"))) for n, v, b in own]
    x = j.select(*keys, F.inline(F.filter(F.array(*a, *c), lambda s: s.isNotNull())))
    g = x.groupBy(*keys, "term").agg(F.first("b").alias("b"), F.sum(F.col("v") * F.col("r")).alias("s"), F.sum(F.abs(F.col("v") * F.col("r"))).alias("size"))
    return g.where("b != 0").select(*keys, "term", ((F.col("s") - lam * F.col("b")) / (1 + F.col("size"))).alias("gradient"))


# ------------------------------------------------------- evaluation plans
def split_80_20(df: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, frac: float = 0.2) -> DataFrame:
    """The last max(int(frac n), 1) rows of each series are test."""
    w = Window.partitionBy(*keys).orderBy("ds")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    test = F.greatest(F.floor(n * frac), F.lit(1))
    return df.withColumn("rn", F.row_number().over(w)).withColumn("n_rows", n).withColumn(
        "is_test", F.col("rn") > F.col("n_rows") - test
    )


def cutoffs(feats: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, horizon: int = 1, period: int = 1, min_initial: int = 7) -> DataFrame:
    """Rolling-origin cutoffs (initial = max(min_initial, span - 3)
    days, ``period`` days apart, from max(ds) - horizon back) and the rows
    each one predicts: ds in (cutoff, cutoff + horizon].

    Each row proposes only the ``horizon`` cutoffs that could predict it and
    meets the cutoff table on (keys, cutoff) by equality, so the work is
    rows x horizon, never cutoffs x rows."""
    keys = list(keys)
    b = feats.groupBy(*keys).agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    b = b.withColumn("initial", F.greatest(F.lit(min_initial), F.date_diff("hi", "lo") - 3))
    c = b.where(F.date_add("lo", F.col("initial")) <= F.date_sub("hi", horizon)).select(
        *keys, F.explode(F.sequence(F.date_sub("hi", horizon), F.date_add("lo", F.col("initial")), F.expr(f"INTERVAL {-period} DAYS"))).alias("cutoff")
    )
    rows = feats.select(*keys, "ds").withColumn(
        "cutoff", F.explode(F.sequence(F.date_sub("ds", horizon), F.date_sub("ds", 1)))
    )
    return rows.join(c, [*keys, "cutoff"]).select(*keys, "cutoff", "ds")


def expanding_slices(feats: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, start: float = 0.6, block_days: int | None = None) -> DataFrame:
    """For i from int(start n): train rows <= day i, test day i+1
    (``lead``, no self join).  ``block_days``: without a window over a whole series."""
    if block_days:
        d = neighbours(feats.select(*keys, "ds"), keys=keys, number="rn", count="n_rows", leads={"test_ds": "ds"}, block_days=block_days)
    else:
        w = Window.partitionBy(*keys).orderBy("ds")
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        d = feats.select(*keys, "ds", F.row_number().over(w).alias("rn"), n.alias("n_rows"), F.lead("ds").over(w).alias("test_ds"))
    i0 = F.floor(F.col("n_rows") * start)
    return d.where((F.col("rn") >= i0 + 1) & F.col("test_ds").isNotNull()).select(
        *keys, F.col("ds").alias("cutoff"), "test_ds", F.col("rn").alias("n_train")
    )


def walk_forward_ols(feats: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, start: float = 0.6) -> DataFrame:
    """K14, one-regressor form: slope / intercept of temp on outside max
    over the expanding frame up to day i, predicting day i+1 (n >= 3)."""
    w = Window.partitionBy(*keys).orderBy("ds")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    y, x = F.col("temp_mean"), F.col("outside_temp_max")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    d = feats.select(
        *keys, "ds", F.row_number().over(w).alias("rn"), n.alias("n_rows"),
        F.regr_slope(y, x).over(upto).alias("slope"), F.regr_intercept(y, x).over(upto).alias("intercept"),
        F.regr_count(y, x).over(upto).alias("n_fit"),
        F.lead("ds").over(w).alias("test_ds"), F.lead(x).over(w).alias("x_next"), F.lead(y).over(w).alias("actual"),
    )
    d = d.where((F.col("rn") >= F.floor(F.col("n_rows") * start) + 1) & F.col("test_ds").isNotNull() & (F.col("n_fit") >= 3))
    d = d.withColumn("pred", F.col("intercept") + F.col("slope") * F.col("x_next"))
    return d.select(*keys, "test_ds", "n_fit", "slope", "intercept", "pred", "actual", (F.col("actual") - F.col("pred")).alias("err"))


#: Test days whose matrices are formed at once.
WALK_STEP = 512
WALK = "test_ds date, n bigint, pred double, actual double, err double"


def _key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name in keys)


def _rows_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(t.column("y")), G.matrix(t.column("xe").combine_chunks())


def _series_rows(feats: DataFrame, keys, leak_free: bool, exog) -> DataFrame:
    d = co2_exog(feats, keys=keys, leak_free=leak_free, exog=exog)
    return d.select(*keys, "ds", "y", F.slice("x", 2, len(exog)).alias("xe"))


def walk_forward(feats: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, start: float = 0.6, lam: float = 1e-6,
                 leak_free: bool = False, exog: Sequence[str] = tuple(CO2_EXOG)) -> DataFrame:
    """CO2 walk-forward as a refit on all earlier days would do it, from running sums.

    A series' design rows (``Layout``) are added up day by day; from the matrix before a test day follow
    beta (all earlier days) and phi and delta (those with both lags), all test days of a
    batch in one solve.  MA is left out here; ``walk_forward_ma`` carries it."""
    keys, lay = list(keys), Layout(len(exog))
    rows = _series_rows(feats, keys, leak_free, exog)

    def run(t: pa.Table, first: np.ndarray) -> dict | None:
        y, x = _rows_of(t)
        where, preds, counts = [], [], []

        def solve(g: list, z: list, heads: list) -> None:
            m = co2_system(lay, np.concatenate(g), np.concatenate(heads), lam, ma=False)
            z, u, c = np.concatenate(z), m["forms"], m["coef"]
            fit = np.einsum("si,si->s", z[:, lay.x[1:]], m["beta"][:, 1:]) + c[:, 3] * z[:, lay.t]
            preds.append(fit + sum(c[:, i] * np.einsum("si,si->s", z, u[i]) for i in (1, 2)))

        waiting: tuple[list, list, list] = ([], [], [])
        size = 0
        for a, e in zip(first[:-1].tolist(), first[1:].tolist()):
            z = lay.rows(y[a:e], x[a:e])
            begin = max(int((e - a) * start) + 1, 5)  # at least three earlier days with both lags
            sums = z[:begin].T @ z[:begin]  # of the days before the test day
            for lo in range(begin, e - a, WALK_STEP):
                own = z[lo : lo + WALK_STEP]
                run_ = np.cumsum(own[:, :, None] * own[:, None, :], axis=0)
                for part, v in zip(waiting, (np.concatenate([sums[None], sums + run_[:-1]]), own, np.broadcast_to(z[:3], (len(own), 3, lay.p)))):
                    part.append(v)
                sums = sums + run_[-1]
                where.append(a + lo + np.arange(len(own)))
                counts.append(lo - 2 + np.arange(len(own)))
                size += len(own)
                if size >= WALK_STEP:
                    solve(*waiting)
                    waiting, size = ([], [], []), 0
        if size:
            solve(*waiting)
        if not where:
            return None
        at, pred = np.concatenate(where), np.concatenate(preds)
        own = {k: t.column(k).combine_chunks().take(pa.array(at)) for k in keys}
        return own | {"test_ds": t.column("ds").combine_chunks().take(pa.array(at)), "n": np.concatenate(counts), "pred": pred, "actual": y[at], "err": y[at] - pred}

    return each_series(rows, keys, "ds", run, _key_schema(rows, keys) + WALK)


def extended_least_squares(y: np.ndarray, x: np.ndarray, size: np.ndarray, lam: float) -> np.ndarray:
    """One-day-ahead predictions of y (S, T) by recursive extended least squares, for many series of
    ``size`` days, with x (S, T, k).

    The parameters (beta, phi1, phi2, delta, theta) and their covariance are carried from day to day.
    Day t's regressors are x, the last two residuals y - x.beta by the newest beta, t, and the last
    day's remaining error; missing ones are 0.  Prior: parameters 0, covariance I / lam."""
    s, days, k = x.shape
    q = k + 4
    theta, cov = np.zeros((s, q)), np.broadcast_to(np.eye(q) / lam, (s, q, q)).copy()
    error, pred = np.zeros(s), np.full((s, days), np.nan)
    for t in range(days):
        on = np.flatnonzero(size > t)
        psi = np.zeros((len(on), q))
        psi[:, :k], psi[:, k + 2], psi[:, k + 3] = x[on, t], t + 1.0, error[on]
        for lag in (1, 2):
            if t >= lag:
                psi[:, k + lag - 1] = y[on, t - lag] - np.einsum("si,si->s", x[on, t - lag], theta[on, :k])
        pred[on, t] = np.einsum("si,si->s", psi, theta[on])
        way = np.einsum("sij,sj->si", cov[on], psi)
        gain = way / (1.0 + np.einsum("si,si->s", psi, way))[:, None]
        theta[on] += gain * (y[on, t] - pred[on, t])[:, None]
        c = cov[on] - gain[:, :, None] * way[:, None, :]
        cov[on] = (c + c.transpose(0, 2, 1)) / 2
        error[on] = y[on, t] - np.einsum("si,si->s", psi, theta[on])
    return pred


def walk_forward_ma(feats: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, start: float = 0.6, lam: float = 1e-3,
                    leak_free: bool = False, exog: Sequence[str] = tuple(CO2_EXOG)) -> DataFrame:
    """K14 with its MA term: ``extended_least_squares`` through each series, scored on the same
    days as ``walk_forward``."""
    keys = list(keys)
    rows = _series_rows(feats, keys, leak_free, exog)

    def run(t: pa.Table, first: np.ndarray) -> dict | None:
        y, x = _rows_of(t)
        size = np.diff(first)
        at = first[:-1, None] + np.minimum(np.arange(size.max()), size[:, None] - 1)
        pred = extended_least_squares(y[at], x[at], size, lam)
        day = np.arange(size.max())
        test = (day >= np.maximum(np.floor(size * start) + 1, 5)[:, None]) & (day < size[:, None])
        if not test.any():
            return None
        pred, at, n = pred[test], at[test], np.broadcast_to(day - 2, test.shape)[test]
        own = {k: t.column(k).combine_chunks().take(pa.array(at)) for k in keys}
        return own | {"test_ds": t.column("ds").combine_chunks().take(pa.array(at)), "n": n, "pred": pred, "actual": y[at], "err": y[at] - pred}

    return each_series(rows, keys, "ds", run, _key_schema(rows, keys) + WALK)


def rolling_cv(feats: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, lam: float = 1.0, min_span: int = 14,
               prior: float | None = CHANGEPOINT_PRIOR) -> DataFrame:
    """Per cutoff, the temperature model (K4) fitted on all days up to
    the cutoff and scored on the next day.  A series has few cutoffs (E10), so its days are
    dealt to each of them and add up to one matrix per (series, cutoff).  Series with a span under
    ``min_span`` get no CV rows (K19 covers them)."""
    keys = list(keys)
    gate = regressor_gate(feats, keys=keys).where(F.col("span_days") >= min_span).select(*keys, "first_ds", "span_days")
    last = F.date_add("first_ds", F.col("span_days").cast("int"))
    cut = F.sequence(F.date_sub(last, 1), F.date_add("first_ds", F.greatest(F.lit(7), F.col("span_days") - 3).cast("int")), F.expr("INTERVAL -1 DAYS"))
    gate = gate.withColumn("cutoff", F.explode(cut)).withColumn("span_days", F.date_diff("cutoff", "first_ds").cast("bigint"))
    cols = gate_columns(F.col("span_days"))
    gate = gate.select("*", cols["bends"].alias("bends"))
    d = kjoin(weekly_fourier(feats), gate, keys).where(F.col("ds") <= F.date_add("cutoff", 1))
    d = d.withColumn("t", F.date_diff("ds", "first_ds").cast("double"))
    d = d.withColumn("x", temp_vector(F.col("t"))).withColumn("y", F.col("temp_mean").cast("double"))
    d = d.withColumn("xh", F.concat("x", hinges(F.col("t"), F.col("bends"), F.col("span_days"))))
    solver = temp_solver(lam, prior)

    def by_last_day(own: dict, *sums: np.ndarray) -> dict:
        # K2 applied to each training window by the last day that it really has
        small = np.array([t in ("const", "t", *TEMP_SMALL) for t in TEMP_TERMS])
        use = np.where((own["top"][:, 1] < FULL_SPAN)[:, None], small, True)
        return solver(own | {"use": pa.array(use.tolist())}, *sums)

    at = [*keys, "cutoff"]
    m = G.fit(d.where(F.col("ds") <= F.col("cutoff")), at, by_last_day, TEMP_FIT, x="xh", greatest=["y", "t"])
    test = d.where(F.col("ds") > F.col("cutoff")).select(*at, "ds", "t", "x", "y", "bends", "span_days")
    j = test.join(m.select(*at, "n", "beta", "delta", "status"), at)
    return j.select(*at, "ds", "n", "y", temp_value(F.col("x"), F.col("t")).alias("yhat"), "status")


def cv_metrics(cv: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, factor: float = 1.5) -> DataFrame:
    """K12 metrics + E8 + K13: MAE, RMSE, number of cutoffs, persistence
    MAE over the CV rows and the flag MAE > factor x persistence."""
    w = Window.partitionBy(*keys).orderBy("ds")
    c = cv.withColumn("_r", F.col("y") - F.col("yhat")).withColumn("_pd", F.abs(F.col("y") - F.lag("y").over(w)))
    g = c.groupBy(*keys).agg(
        F.avg(F.abs("_r")).alias("mae"), F.sqrt(F.avg(F.col("_r") * F.col("_r"))).alias("rmse"),
        F.countDistinct("cutoff").alias("n_cutoffs"), F.avg("_pd").alias("persistence_mae"),
    )
    return g.withColumn("worse_than_persistence", F.col("mae") > F.col("persistence_mae") * factor)


HOLDOUT = "n_train bigint, status string, n_test bigint, mae double, rmse double"


def holdout_eval(feats: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, leak_free: bool = False, lam: float = 1e-6,
                 frac: float = 0.2, min_days: int = 7, exog: Sequence[str] = tuple(CO2_EXOG)) -> DataFrame:
    """CO2 model on the first 80 %, multi-step forecast of the rest
    (exogenous columns known), MAE / RMSE; < 2 train rows -> status.  The columns are
    lagged over all days, then split: test rows see what training saw."""
    keys, lay = list(keys), Layout(len(exog))
    rows = _series_rows(feats, keys, leak_free, exog)

    def run(t: pa.Table, first: np.ndarray) -> dict:
        y, x = _rows_of(t)
        size = np.diff(first)
        tests = np.maximum(np.floor(size * frac), 1).astype(int)
        g, heads, ends = (np.zeros((len(size), *shape)) for shape in ((lay.p, lay.p), (3, lay.p), (lay.p,)))
        for i, (a, n) in enumerate(zip(first[:-1].tolist(), (size - tests).tolist())):
            z = lay.rows(y[a : a + n], x[a : a + n])
            g[i], heads[i, : min(n, 3)] = z.T @ z, z[:3]
            ends[i] = z[-1] if n else 0
        m = co2_system(lay, g, heads, lam, ma=True)
        c, u = m["coef"], m["forms"]
        u1, u2, u3 = (np.einsum("si,si->s", ends, u[i]) for i in range(3))
        e = u1 - (c[:, 1] * u2 + c[:, 2] * u3 + c[:, 3] * (size - tests) + c[:, 4] * np.einsum("si,si->s", ends, m["e1"]))
        total, squares = np.zeros(len(size)), np.zeros(len(size))
        for h in range(int(tests.max())):
            on = np.flatnonzero(tests > h)
            at = first[on] + size[on] - tests[on] + h
            now = c[on, 1] * u1[on] + c[on, 2] * u2[on] + c[on, 3] * (size[on] - tests[on] + h + 1) + (c[on, 4] * e[on] if h == 0 else 0.0)
            r = y[at] - (np.einsum("si,si->s", x[at], m["beta"][on, 1:]) + now)
            total[on] += np.abs(r)
            squares[on] += r * r
            u2[on], u1[on] = u1[on], now
        n = size - tests
        status = np.where(np.isnan(c[:, 1]), "too_short", m["status"])
        status = np.where(n < 2, "too_few_train_rows", np.where(n < min_days, "too_few_days", status))
        own = {k: t.column(k).combine_chunks().take(pa.array(first[:-1])) for k in keys}
        return own | {
            "n_train": n, "status": status.tolist(), "n_test": pa.array(tests, mask=n < 1),
            "mae": none_for_nan(np.where(n < 1, np.nan, total / tests)), "rmse": none_for_nan(np.where(n < 1, np.nan, np.sqrt(squares / tests))),
        }

    out = each_series(rows, keys, "ds", run, _key_schema(rows, keys) + HOLDOUT)
    return out.where(F.col("n_train") > 0)


def small_data_eval(feats: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, lam: float = 1.0, max_span: int = 14) -> DataFrame:
    """For series with span < max_span: ridge with the three key
    regressors on the first int(0.8 n) rows, MAE on the rest (>= 2 rows)."""
    keys = list(keys)
    gate = regressor_gate(feats, keys=keys)
    w = Window.partitionBy(*keys).orderBy("ds")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    d = feats.withColumn("rn", F.row_number().over(w)).withColumn("n_rows", n)
    d = d.withColumn("is_test", F.col("rn") > F.floor(F.col("n_rows") * 0.8))
    small_mask = F.array(*[F.lit(t in ("const", "t", *TEMP_SMALL)) for t in TEMP_TERMS])
    g2 = gate.withColumn("use", small_mask)
    des = temp_design(d, g2, keys=keys)
    tr = des.where(~F.col("is_test"))
    m = G.fit(tr, keys, temp_solver(lam, None), TEMP_FIT, carry=["use"], greatest=["y"])
    te = kjoin(des.where(F.col("is_test")), m.select(*keys, "beta"), keys)
    te = te.withColumn("_r", F.col("y") - G.dot(F.col("x"), F.col("beta")))
    ev = te.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_test"), F.avg(F.abs("_r")).alias("mae"))
    out = kjoin(gate.select(*keys, "span_days"), ev, keys, "left")
    return out.withColumn(
        "status",
        F.when(F.col("span_days") >= max_span, "not_needed").when(F.coalesce(F.col("n_test"), F.lit(0)) < 2, "too_few_test_rows").otherwise("ok"),
    ).withColumn("mae", F.when(F.col("status") == "ok", F.col("mae")))
