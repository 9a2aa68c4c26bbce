"""Ordinal and mixed regression models fitted from sums over grouped rows.

Rows are first counted by category cell (for mixed models, groups by pattern); the fits
then go over these sums. A job returns sums whose size depends on the number of
parameters only, so nothing that grows with the rows reaches the driver.
"""

from __future__ import annotations

import functools
import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import stats as S
from corpusloom.operators.lineage import materialize

#: A category column is a dimension: more levels than these are an error, not a design.
MOST_LEVELS = 200

FIT = "n long, params int, log_likelihood double, aic double, iterations int, converged boolean"
TERMS = "term string, estimate double, se double, z double, p double, low double, high double"


@dataclass(frozen=True)
class Design:
    """Treatment-coded columns of categories, their products, and numeric columns.

    ``terms`` are tuples of category columns; ``levels`` the sorted levels of each, the
    first of which is the reference.
    """

    terms: tuple[tuple[str, ...], ...]
    levels: dict[str, list]
    numeric: tuple[str, ...] = ()
    intercept: bool = True

    @property
    def categories(self) -> list[str]:
        return list(self.levels)

    def columns(self) -> list[tuple[str, tuple[tuple[str, int], ...]]]:
        """Name and (column, level number) pairs of every category column of the design."""
        out = [("intercept", ())] if self.intercept else []
        for term in self.terms:
            for combo in itertools.product(*[range(1, len(self.levels[c])) for c in term]):
                pairs = tuple(zip(term, combo))
                out.append((":".join(f"{c}={self.levels[c][k]}" for c, k in pairs), pairs))
        return out

    def names(self) -> list[str]:
        return [n for n, _ in self.columns()] + list(self.numeric)

    def matrix(self, codes: dict[str, np.ndarray], n: int) -> np.ndarray:
        """The category columns for ``n`` cells, given each column's level numbers."""
        out = np.ones((n, len(self.columns())))
        for j, (_, pairs) in enumerate(self.columns()):
            for c, k in pairs:
                out[:, j] *= codes[c] == k
        return out


def design(rows: DataFrame, terms: list[tuple[str, ...]], numeric: list[str] = (), intercept: bool = True) -> Design:
    """The design of ``terms`` with the levels that ``rows`` has; more than MOST_LEVELS of a column are an error."""
    levels = {}
    for c in dict.fromkeys(c for t in terms for c in t):
        found = [r[0] for r in rows.where(F.col(c).isNotNull()).select(c).distinct().limit(MOST_LEVELS + 1).collect()]
        if len(found) > MOST_LEVELS:
            raise ValueError(f"{c} has more than {MOST_LEVELS} levels")
        levels[c] = sorted(found)
    return Design(tuple(tuple(t) for t in terms), levels, tuple(numeric), intercept)


def _coded(rows: DataFrame, d: Design) -> DataFrame:
    """``rows`` with level numbers in place of the category columns' values."""
    for c, values in d.levels.items():
        number = F.lit(None).cast("int")
        for k, v in enumerate(values):
            number = F.when(F.col(c) == F.lit(v), k).otherwise(number)
        rows = rows.withColumn(c, number)
    return rows


def _summed(rows: DataFrame, partial, size: int) -> np.ndarray:
    """Sum over all tasks of ``partial(pandas batch)``: an array of ``size`` doubles."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            total += partial(batch.to_pandas())
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], names=["at", "x"])

    out = np.zeros(size)
    for r in rows.mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r["x"]
    return out


# ---------------------------------------------------------------------------------- ordinal


def _ordinal_terms(theta: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, cuts: int) -> np.ndarray:
    """Log-likelihood, gradient and Hessian of cumulative logits over cells, as one array.

    P(y <= k) is the logistic function of cut k less the row's linear predictor. Each
    cell's probability is a difference of two such values, whose derivatives by the two
    bounds are in closed form.
    """
    eta = x @ theta[cuts:]
    bounds = np.concatenate(([-np.inf], theta[:cuts], [np.inf]))
    upper, lower = bounds[y + 1] - eta, bounds[y] - eta
    fu, fl = (1 / (1 + np.exp(-np.clip(b, -700, 700))) for b in (upper, lower))
    fu, fl = np.where(np.isposinf(upper), 1.0, fu), np.where(np.isneginf(lower), 0.0, fl)
    p = np.maximum(fu - fl, 1e-300)
    du, dl = fu * (1 - fu), fl * (1 - fl)
    # Derivatives of log p by the bounds: first, then second.
    gu, gl = du / p, -dl / p
    huu, hll, hul = du * (1 - 2 * fu) / p - gu * gu, -dl * (1 - 2 * fl) / p - gl * gl, -gu * gl
    k = len(theta)
    ju, jl = np.zeros((len(y), k)), np.zeros((len(y), k))
    ju[:, cuts:] = jl[:, cuts:] = -x
    rows = np.arange(len(y))
    ju[rows[y < cuts], y[y < cuts]] += 1
    jl[rows[y > 0], y[y > 0] - 1] += 1
    grad = (n * gu) @ ju + (n * gl) @ jl
    cross = (ju * (n * hul)[:, None]).T @ jl
    hess = (ju * (n * huu)[:, None]).T @ ju + (jl * (n * hll)[:, None]).T @ jl + cross + cross.T
    return np.concatenate(([float(n @ np.log(p))], grad, hess.ravel()))


def fit_ordinal(rows: DataFrame, outcome: str, terms: list[tuple[str, ...]], numeric: list[str] = (), steps: int = 60, tolerance: float = 1e-9) -> dict | None:
    """Cumulative-logit model of an ordered outcome by distributed Newton steps.

    Cells of equal predictors and outcome are counted first; each step is one job that
    sums likelihood, gradient and Hessian over the cells. Steps are halved until the
    cuts stay ordered and the likelihood grows; the likelihood is concave, so that leads
    to its maximum. Directions on which the data say nothing (cells that no row has) keep
    their zero and are not counted as parameters. Where categories separate the outcomes,
    coefficients grow without end: the fit then stops at the likelihood's limit with
    ``converged`` false. Rows with a null are left out; fewer than two outcomes or no
    predictor that varies give None.
    """
    used = [outcome, *dict.fromkeys(c for t in terms for c in t), *numeric]
    rows = rows.select(*used).dropna()
    d = design(rows, terms, numeric, intercept=False)
    grades = design(rows, [(outcome,)]).levels[outcome]
    if len(grades) < 2 or not any(len(v) > 1 for v in d.levels.values()) and not numeric:
        return None
    coded = _coded(rows, Design((), {**d.levels, outcome: grades}))
    cells = coded.groupBy(*used).agg(F.count("*").cast("double").alias("_n")).persist()
    try:
        cuts, width = len(grades) - 1, len(d.names())
        k = cuts + width

        def at(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            def partial(pdf: pd.DataFrame) -> np.ndarray:
                x = d.matrix({c: pdf[c].to_numpy() for c in d.categories}, len(pdf))
                x = np.hstack([x, pdf[list(numeric)].to_numpy(float)]) if numeric else x
                return _ordinal_terms(theta, x, pdf[outcome].to_numpy(), pdf["_n"].to_numpy(), cuts)

            total = _summed(cells, partial, 1 + k + k * k)
            return total[0], total[1 : 1 + k], total[1 + k :].reshape(k, k)

        shares = {r[outcome]: r["n"] for r in cells.groupBy(outcome).agg(F.sum("_n").alias("n")).collect()}
        n = sum(shares.values())
        below = np.cumsum([shares[g] for g in range(cuts)]) / n
        theta = np.concatenate((np.log(below / (1 - below)), np.zeros(width)))
        ll, grad, hess = at(theta)
        converged, step = False, 0
        for step in range(1, steps + 1):
            move = np.linalg.pinv(-hess, rcond=1e-10, hermitian=True) @ grad
            if float(grad @ move) < tolerance:
                converged = True
                break
            scale = 1.0
            while scale > 1e-8:
                trial = theta + scale * move
                if np.all(np.diff(trial[:cuts]) > 0):
                    found = at(trial)
                    if found[0] >= ll:
                        break
                scale /= 2
            else:
                break
            theta, (ll, grad, hess) = trial, found
        if float(np.abs(theta).max()) > 15:
            converged = False
        values = np.linalg.eigvalsh(-hess)
        rank = int((values > values.max() * 1e-10).sum()) if converged else int(np.linalg.matrix_rank(hess, hermitian=True))
        cov = np.linalg.pinv(-hess, rcond=1e-10, hermitian=True)
        names = [f"cut {a}|{b}" for a, b in zip(grades, grades[1:])] + d.names()
        silent = np.abs(np.diag(hess)) < 1e-12
        return {"names": names, "estimate": theta, "se": np.where(silent, np.nan, np.sqrt(np.maximum(np.diag(cov), 0))), "log_likelihood": float(ll), "n": int(round(n)), "params": rank - cuts, "cuts": cuts, "iterations": step, "converged": converged}
    finally:
        cells.unpersist()


def _table(spark, names, estimate, se, schema: str = TERMS) -> DataFrame:
    rows = []
    for name, b, s in zip(names, (float(x) for x in estimate), (float(x) for x in se)):
        known = math.isfinite(s) and s > 0
        z = b / s if known else None
        rows.append((name, round(b, 6), round(s, 6) if math.isfinite(s) else None, round(z, 4) if known else None, round(2 * S.normal_tail(abs(z)), 6) if known else None, round(b - S.Z95 * s, 6) if known else None, round(b + S.Z95 * s, 6) if known else None))
    return spark.createDataFrame(rows, schema)


def ordered_logit(rows: DataFrame, outcome: str, terms: list[tuple[str, ...]], numeric: list[str] = ()) -> DataFrame:
    """Cuts and coefficients of the cumulative-logit model: TERMS; no rows where nothing can be fitted."""
    fit = fit_ordinal(rows, outcome, terms, numeric)
    spark = rows.sparkSession
    return _table(spark, fit["names"], fit["estimate"], fit["se"]) if fit else spark.createDataFrame([], TERMS)


def ordinal_interaction_test(rows: DataFrame, outcome: str, a: str, b: str) -> DataFrame:
    """Additive against interaction fit: log-likelihoods, parameters, ratio, degrees, probability, in one row.

    Parameters are counted by rank, so cells that no row has take no degree. The
    in-sample ratio takes rows as independent. Where one of the fits can't be made, its columns are null.
    """
    less, full = fit_ordinal(rows, outcome, [(a,), (b,)]), fit_ordinal(rows, outcome, [(a,), (b,), (a, b)])
    ratio = max(0.0, 2 * (full["log_likelihood"] - less["log_likelihood"])) if less and full else None
    df = full["params"] - less["params"] if less and full else None
    row = (
        less and less["n"], less and round(less["log_likelihood"], 5), full and round(full["log_likelihood"], 5), less and less["params"], full and full["params"],
        None if ratio is None else round(ratio, 5), df, round(S.chi2_tail(ratio, df), 6) if df else None, bool(less and full and less["converged"] and full["converged"]),
    )
    return rows.sparkSession.createDataFrame([row], "n long, ll_additive double, ll_interaction double, k_additive int, k_interaction int, lr double, df int, p double, converged boolean")


# ---------------------------------------------------------------------------------- mixed


#: Patterns whose sums a task holds before it hands them on, groups whose products are laid out at once,
#: and sums that the search takes along; where there are more, each of its steps is a job.
HELD_PATTERNS, LAID_OUT, HELD_SUMS = 512, 1024, 1 << 20


def _by_pattern(q: int, size: int, at: int, merged: bool):
    """Rows of one Z'Z summed inside a task: their number and the products of the entries of Z'[X y]."""

    def run(batches):
        held = {}

        def handed_on():
            zz, n, m = zip(*held.values()) if held else ((), (), ())
            lists = pa.list_(pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(zz, lists), pa.array(n, pa.float64()), pa.array(m, lists)], names=["zz", "n", "m"])

        for batch in batches:
            for low in range(0, len(batch), LAID_OUT):
                part = batch.slice(low, LAID_OUT)
                lists = lambda c: part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)  # noqa: B023, E731
                if merged:
                    zz, n, m = lists("zz"), part.column("n").to_numpy(), lists("m")
                else:
                    zx = lists("zx")
                    zz, n, m = zx.reshape(-1, q, size)[:, :, [0, at][:q]].reshape(len(part), -1), np.ones(len(part)), (zx[:, :, None] * zx[:, None, :]).reshape(len(part), -1)
                kinds, kind = np.unique(zz, axis=0, return_inverse=True)
                order = np.argsort(kind, kind="stable")
                starts = np.searchsorted(kind[order], np.arange(len(kinds)))
                for k, a, b in zip(kinds, np.add.reduceat(n[order], starts), np.add.reduceat(m[order], starts, axis=0)):
                    _, n_held, m_held = held.get(k.tobytes(), (k, 0.0, 0.0))
                    held[k.tobytes()] = (k, n_held + a, m_held + b)
                if len(held) > HELD_PATTERNS:
                    yield handed_on()
                    held.clear()
        yield handed_on()

    return run


def _group_products(rows: DataFrame, d: Design, outcome: str, group: str, slope: str | None) -> tuple[DataFrame, np.ndarray, int]:
    """The groups by pattern, and over all groups [X y]'[X y] and the number of rows.

    X has the design's columns, Z the constant and, where asked for, ``slope``. A pattern is
    one value of Z'Z; the criterion needs no more of its groups than their number ``n`` and the sums ``m`` of
    all products of two entries of Z'[X y]. Where groups differ by few times or sizes, there are few patterns.
    """
    numbers = [*d.numeric, outcome]
    pairs = [(i, j) for i in range(len(numbers)) for j in range(i, len(numbers))]
    value = lambda c: F.col(c).cast("double")
    coded = _coded(rows, d)
    cells = coded.groupBy(F.lit(0).alias("_all"), *d.categories).agg(
        F.count("*").cast("double").alias("_n"),
        F.array(*[F.sum(value(c)) for c in numbers]).alias("_s"),
        F.array(*[F.sum(value(numbers[i]) * value(numbers[j])) for i, j in pairs]).alias("_q"),
    )
    width = len(d.columns())
    size, q = width + len(numbers), 2 if slope else 1
    at = width + numbers.index(slope) if slope else 0

    def products(pdf: pd.DataFrame) -> np.ndarray:
        """[X y]'[X y] summed over the cells of ``pdf``."""
        x, n = d.matrix({c: pdf[c].to_numpy() for c in d.categories}, len(pdf)), pdf["_n"].to_numpy()
        s, squares = np.vstack(pdf["_s"].to_numpy()), np.vstack(pdf["_q"].to_numpy()).sum(axis=0)
        out = np.zeros((size, size))
        out[:width, :width] = (x * n[:, None]).T @ x
        out[:width, width:] = x.T @ s
        out[width:, :width] = out[:width, width:].T
        for (i, j), v in zip(pairs, squares):
            out[width + i, width + j] = out[width + j, width + i] = v
        return out

    whole = _summed(cells, lambda pdf: np.append(products(pdf), pdf["_n"].sum()), size * size + 1)
    inside = lambda fixed: F.when(functools.reduce(Column.__and__, [F.col(c) == k for c, k in fixed], F.lit(True)), 1.0).otherwise(0.0)
    x = [*[inside(fixed) for _, fixed in d.columns()], *[value(c) for c in numbers]]
    z = [F.lit(1.0), value(slope)] if slope else [F.lit(1.0)]
    kept = coded.groupBy(group).agg(F.array(*[F.sum(a * b) for a in z for b in x]).alias("zx")).select("zx")
    kind = "zz array<double>, n double, m array<double>"
    kept = kept.mapInArrow(_by_pattern(q, size, at, False), kind).repartition("zz").mapInArrow(_by_pattern(q, size, at, True), kind)
    return kept, whole[:-1].reshape(size, size), int(round(whole[-1]))


def _criteria(groups: DataFrame | pd.DataFrame, points: np.ndarray, whole: np.ndarray, n: int, q: int) -> tuple[np.ndarray, list]:
    """REML criterion of each relative factor in ``points``, and the fit's matrices there.

    With D = LL' the covariance of the random effects over the residual variance, a
    group's inverse covariance is I - Z L (I + L'Z'Z L)^-1 L'Z'.
    """
    size, k = len(whole), len(points)
    factors = np.zeros((k, q, q))
    for f, p in zip(factors, points):
        f[np.tril_indices(q)] = p

    def partial(pdf: pd.DataFrame) -> np.ndarray:
        out = np.zeros((k, size * size + 1))
        if not len(pdf):
            return out.ravel()
        zz, times = np.vstack(pdf["zz"].to_numpy()).reshape(-1, q, q), pdf["n"].to_numpy()
        m = np.vstack(pdf["m"].to_numpy()).reshape(-1, q, size, q, size)
        for i, f in enumerate(factors):
            inner = np.eye(q) + f.T @ zz @ f
            middle = f @ np.linalg.solve(inner, np.broadcast_to(f.T, inner.shape))
            out[i, :-1] = np.tensordot(middle, m.transpose(0, 1, 3, 2, 4), 3).ravel()
            out[i, -1] = times @ np.linalg.slogdet(inner)[1]
        return out.ravel()

    sums = (partial(groups) if isinstance(groups, pd.DataFrame) else _summed(groups, partial, k * (size * size + 1))).reshape(k, -1)
    values, fits = np.full(k, -np.inf), []
    for i in range(k):
        a = whole - sums[i, :-1].reshape(size, size)
        xx, xy, yy = a[:-1, :-1], a[:-1, -1], a[-1, -1]
        inverse = np.linalg.pinv(xx, rcond=1e-10, hermitian=True)
        beta = inverse @ xy
        eigen = np.linalg.eigvalsh(xx)
        eigen = eigen[eigen > eigen.max() * 1e-10]
        rss, free = float(yy - xy @ beta), n - len(eigen)
        fits.append((beta, inverse, rss, free, np.isclose(np.diag(inverse), 0)))
        if free > 0 and rss > 1e-12 * max(1e-300, whole[-1, -1]):
            values[i] = -0.5 * (free * math.log(rss / free) + sums[i, -1] + float(np.log(eigen).sum()))
    return values, fits


def fit_mixed(rows: DataFrame, outcome: str, group: str, terms: list[tuple[str, ...]] = (), numeric: list[str] = (), slope: str | None = None, tolerance: float = 1e-7) -> dict | None:
    """Random-intercept (and, with ``slope``, random-slope) model by restricted likelihood.

    ``slope`` is one of the numeric columns. The criterion is profiled over the random
    effects' factor relative to the residual: a search over one number, or three, that
    tries all neighbours of a point and shrinks. It goes over the sums of the groups' patterns, on the driver
    up to HELD_SUMS numbers and by a job a step beyond. Groups of one row count like others.
    Rows with a null are left out. None where there are fewer than two groups or not
    more rows than coefficients; an outcome that the fixed effects fit exactly has
    standard errors of zero and no random effects.
    """
    used = list(dict.fromkeys([outcome, group, *(c for t in terms for c in t), *numeric]))
    rows = materialize(rows.select(*used).dropna())
    d = design(rows, terms, numeric)
    patterns, whole, n = _group_products(rows, d, outcome, group, slope)
    patterns = patterns.persist()
    try:
        q = 2 if slope else 1
        found = patterns.agg(F.count("*").alias("patterns"), F.sum("n").alias("groups")).first()
        n_groups, few = int(found["groups"] or 0), found["patterns"] * (q * len(whole)) ** 2 <= HELD_SUMS
        at = d.names().index(slope) if slope else 0
        if n_groups < 2 or n <= np.linalg.matrix_rank(whole[:-1, :-1], hermitian=True):
            return None
        groups = patterns.toPandas() if few else patterns
        many = q * (q + 1) // 2
        # The slope's factor is on the scale of one over its spread.
        spread = math.sqrt(max(1e-12, whole[at, at] / n - (whole[0, at] / n) ** 2)) if slope else 1.0
        unit = np.array([1.0, 1 / spread, 1 / spread][:many])
        center, step = np.array([0.5, 0.0, 0.3][:many]), 0.5
        around = np.array(list(itertools.product((-1, 0, 1), repeat=many)) if q > 1 else [[x] for x in range(-8, 9)], float)
        values, fits = _criteria(groups, np.zeros((1, many)), whole, n, q)
        if not np.isfinite(values[0]):
            best, point, fit = values[0], np.zeros(many), fits[0]
        else:
            best = -np.inf
            while step > tolerance:
                points = (center + step * around) * unit
                values, fits = _criteria(groups, points, whole, n, q)
                i = int(np.argmax(values))
                moved = values[i] > best + 1e-13 * abs(best) and not np.allclose(around[i], 0)
                if values[i] >= best:
                    best, point, fit, center = values[i], points[i], fits[i], points[i] / unit
                step = step if moved and q > 1 else step / (3 if q > 1 else 6)
        beta, inverse, rss, free, silent = fit
        scale = max(0.0, rss / free)
        factor = np.zeros((q, q))
        factor[np.tril_indices(q)] = point
        cov = scale * factor @ factor.T
        se = np.where(silent, np.nan, np.sqrt(np.maximum(np.diag(inverse) * scale, 0)))
        return {"names": d.names(), "estimate": beta, "se": se, "n": n, "groups": n_groups, "residual": scale, "random": cov, "criterion": best, "silent": silent}
    finally:
        patterns.unpersist()


def mixed_terms(rows: DataFrame, outcome: str, group: str, terms: list[tuple[str, ...]], numeric: list[str] = ()) -> DataFrame:
    """Fixed effects of a random-intercept model with their intervals: TERMS; no rows where nothing can be fitted."""
    fit = fit_mixed(rows, outcome, group, terms, numeric)
    spark = rows.sparkSession
    return _table(spark, fit["names"], fit["estimate"], fit["se"]) if fit else spark.createDataFrame([], TERMS)


def mixed_interaction(rows: DataFrame, outcome: str, a: str, b: str, group: str) -> DataFrame:
    """How many interaction contrasts of a random-intercept model have an interval without zero, in one row.

    ``singular`` tells that some contrasts have no data of their own, or that no model can be fitted.
    """
    fit = fit_mixed(rows, outcome, group, [(a,), (b,), (a, b)])
    schema = "n long, n_interaction_terms int, n_ci_excludes_0 int, examples array<string>, singular boolean"
    if fit is None:
        return rows.sparkSession.createDataFrame([(0, 0, 0, [], True)], schema)
    inner = [(name, float(b_), float(s)) for name, b_, s in zip(fit["names"], fit["estimate"], fit["se"]) if ":" in name]
    known = [x for x in inner if math.isfinite(x[2])]
    clear = [name for name, b_, s in known if abs(b_) > S.Z95 * s]
    return rows.sparkSession.createDataFrame([(fit["n"], len(inner), len(clear), clear[:6], len(known) < len(inner))], schema)


def mixed_trend(rows: DataFrame, outcome: str, time: str, group: str, random_slope: bool = True) -> DataFrame:
    """Slope on ``time`` with random effects of the groups, in one row: slope, se, p, low, high, n, groups, method.

    With fewer than two groups or three rows, or a time that doesn't vary within a fit, the slope is
    that of ordinary least squares (``ols``); without two times it is null (``none``).
    """
    schema = "slope double, se double, p double, low double, high double, n long, groups long, method string"
    clean = materialize(rows.select(outcome, time, group).dropna())
    x, y = F.col(time).cast("double"), F.col(outcome).cast("double")
    t = clean.agg(F.count("*").alias("n"), F.countDistinct(group).alias("groups"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy")).first()
    slope = se = method = None
    if t["n"] >= 3 and t["groups"] >= 2 and t["sxx"] and t["sxx"] > 0:
        fit = fit_mixed(clean.withColumn(time, x), outcome, group, [], [time], time if random_slope else None)
        if fit:
            slope, se, method = float(fit["estimate"][1]), float(fit["se"][1]), "mixed"
    if method is None and t["n"] >= 2 and t["sxx"] and t["sxx"] > 0:
        slope, method = t["sxy"] / t["sxx"], "ols"
        se = math.sqrt(max(0.0, (t["syy"] - slope * t["sxy"]) / (t["n"] - 2) / t["sxx"])) if t["n"] > 2 else None
    p = None if not se else round(2 * S.normal_tail(abs(slope / se)), 6)
    ends = (None, None) if se is None else (round(slope - S.Z95 * se, 6), round(slope + S.Z95 * se, 6))
    row = (None if slope is None else round(slope, 6), None if se is None else round(se, 6), p, *ends, t["n"], t["groups"], method or "none")
    return rows.sparkSession.createDataFrame([row], schema)
