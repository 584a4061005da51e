"""Linear and logistic network regression with QAP null hypotheses."""

from __future__ import annotations

import dataclasses
import math
import warnings
from collections.abc import Sequence
from fractions import Fraction
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import NAN, t_quantile, t_tail
from ..functions.tables import stored
from ..net import Net, check_option
from .dyads import Frame, frame, permuted_cells, show_p
from .random_graphs import permutations

NULLS = ("qap", "qapspp", "qapy", "qapx", "classical")
#: Distinct design rows up to which a logistic fit runs on the driver.
DRIVER_ROWS = 1_000_000


@dataclasses.dataclass(frozen=True)
class Separation:
    """Whether a plane separates the classes: exactly (``certified``) or but for rounding; its terms and the rows it tells apart."""

    separated: bool = False
    certified: bool = True
    terms: tuple[int, ...] = ()
    units: tuple[int, ...] = ()


@dataclasses.dataclass(frozen=True, eq=False)
class NetRegression:
    kind: str
    spark: SparkSession
    names: tuple[str, ...]
    coefficients: np.ndarray
    covariance: np.ndarray
    tstat: np.ndarray
    pleeq: np.ndarray
    pgreq: np.ndarray
    pgreqabs: np.ndarray
    #: n_sim x k statistics of the relabelled networks; None for classical tests and separated designs
    dist: np.ndarray | None
    loglik: float
    n_obs: int
    df_residual: int
    nullhyp: str
    n_sim: int
    directed: bool
    missing: str
    statistic: str = "t"
    converged: bool = True
    separation: Separation = Separation()
    r_squared: float = NAN
    adj_r_squared: float = NAN
    null_deviance: float = NAN

    # ---- the protocol of fitted models
    def coef(self) -> np.ndarray:
        return self.coefficients

    def coefnames(self) -> list[str]:
        return list(self.names)

    def vcov(self) -> np.ndarray:
        return self.covariance

    def stderror(self) -> np.ndarray:
        return np.sqrt(np.diag(self.covariance))

    def loglikelihood(self) -> float:
        return self.loglik

    @property
    def deviance(self) -> float:
        return -2 * self.loglik

    def nobs(self) -> int:
        return self.n_obs

    def dof(self) -> int:
        return len(self.names) + (self.kind == "lm")

    def dof_residual(self) -> int:
        return self.df_residual

    def aic(self) -> float:
        return 2 * self.dof() - 2 * self.loglik

    def bic(self) -> float:
        return self.dof() * math.log(self.n_obs) - 2 * self.loglik

    @property
    def separated(self) -> list[str]:
        return [self.names[i] for i in self.separation.terms]

    def confint(self, level: float = 0.95) -> np.ndarray:
        if not 0 < level < 1:
            raise ValueError("level must be between 0 and 1")
        if self.separation.separated:
            return np.full((len(self.names), 2), NAN)
        tail = 1 - (1 - level) / 2
        q = t_quantile(self.spark, tail, self.df_residual) if self.kind == "lm" else NormalDist().inv_cdf(tail)
        half = q * self.stderror()
        return np.stack([self.coefficients - half, self.coefficients + half], axis=1)

    def coef_table(self) -> DataFrame:
        rows = [(n, *map(float, x)) for n, *x in zip(self.names, self.coefficients, self.stderror(), self.tstat, self.pleeq, self.pgreq, self.pgreqabs, strict=True)]
        return self.spark.createDataFrame(rows, "term string, coef double, se double, tstat double, pleeq double, pgreq double, pgreqabs double")

    def dist_table(self) -> DataFrame:
        rows = [] if self.dist is None else [(r, n, float(v)) for r, line in enumerate(self.dist) for n, v in zip(self.names, line, strict=True)]
        return self.spark.createDataFrame(rows, "rep long, term string, value double")

    # ---- metadata
    def estimand(self) -> str:
        return "network_regression" if self.kind == "lm" else "network_logit_regression"

    def objective(self) -> str:
        return "least_squares" if self.kind == "lm" else "likelihood"

    def is_exact(self) -> bool:
        return True if self.kind == "lm" else self.converged

    def se_method(self) -> str:
        return "ols" if self.kind == "lm" else "fisher"

    def missing_method(self) -> str:
        return self.missing

    def approximations(self) -> list[str]:
        said = []
        if self.nullhyp == "classical":
            said.append("classical p-values take dyads as independent")
        elif self.dist is not None:
            said.append(f"p-values are shares of {self.n_sim} random relabellings")
        if self.separation.separated:
            said.append("the design is separated: no finite estimate exists and inference is withheld")
        elif np.isnan(self.coefficients).any():
            said.append("some term is a linear combination of the others: no estimate exists and inference is withheld")
        elif self.dist is not None and np.isnan(self.dist).any():
            said.append("p-values of terms with separated relabellings are withheld")
        if self.missing != "none":
            said.append("unobserved dyads count at their stored face values")
        return said

    def fit_metadata(self) -> dict:
        return {k: getattr(self, k)() for k in ("estimand", "objective", "is_exact", "se_method", "missing_method", "approximations")}

    def __str__(self) -> str:
        what = "least squares" if self.kind == "lm" else "logit"
        lines = [f"Network {what} regression, {self.n_obs} dyads, null hypothesis {self.nullhyp}"]
        lines += [f"{n:>12} {c:12.6g} {t:10.4g} {show_p(p, self.n_sim):>10}" for n, c, t, p in zip(self.names, self.coefficients, self.tstat, self.pgreqabs, strict=True)]
        return "\n".join(lines)


def _prepare(y: Net, xs, intercept: bool, nullhyp: str, n_sim: int, mode: str, missing: str, context: str):
    check_option("nullhyp", nullhyp, NULLS)
    xs = [xs] if isinstance(xs, Net) else list(xs)
    if not xs and not intercept:
        raise ValueError(f"{context}: no term is left without predictors and intercept")
    f = frame([y, *xs], mode, missing, context)
    names = (("(intercept)",) if intercept else ()) + tuple(f"x{k + 1}" for k in range(len(xs)))
    null = {"qap": "qapspp"}.get(nullhyp, nullhyp)
    if null == "qapspp" and len(names) == 1:
        null = "qapy"
    if null != "classical" and n_sim <= 0:
        raise ValueError("n_sim must be positive")
    masked = any(net.n_missing_dyads() for net in f.nets)
    return f, names, null, "condition_on_face" if masked else "none"


def _gram(table: DataFrame, columns: list) -> np.ndarray:
    """Sums of products of all pairs of columns, in one aggregation."""
    k = len(columns)
    sums = [F.coalesce(F.sum(columns[a] * columns[b]), F.lit(0.0)).cast("double") for a in range(k) for b in range(a, k)]
    got, out = iter(table.agg(*sums).first()), np.zeros((k, k))
    for a in range(k):
        for b in range(a, k):
            out[a, b] = out[b, a] = next(got)
    return out


def _dependent(gram: np.ndarray) -> bool:
    """Whether some term is a linear combination of the others."""
    scale = np.sqrt(np.diag(gram))
    return bool((scale == 0).any() or np.linalg.matrix_rank(gram / np.outer(scale, scale), tol=1e-10) < len(gram))


def _check_design(gram: np.ndarray, n: int) -> None:
    k = len(gram)
    if n <= k:
        raise ValueError(f"{n} dyads can't tell {k} terms apart")
    if _dependent(gram):
        raise ValueError("some term is a linear combination of the others")


def _t_values(g: np.ndarray, c: np.ndarray, yy: float, n: int) -> np.ndarray:
    inverse = np.linalg.inv(g)
    b = inverse @ c
    rss = max(yy - b @ c, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return b / np.sqrt(np.maximum(np.diag(inverse), 0.0) * rss / (n - len(c)))


def _shares(dist: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tol = 1e-9 * np.maximum(1.0, np.abs(t))
    with np.errstate(invalid="ignore"):
        return (dist <= t + tol).mean(axis=0), (dist >= t - tol).mean(axis=0), (np.abs(dist) >= np.abs(t) - tol).mean(axis=0)


def _classical(spark: SparkSession, t: np.ndarray, df: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tails = np.array([t_tail(spark, float(x), df) for x in t]).reshape(-1, 2)
    both = np.array([2 * t_tail(spark, abs(float(x)), df)[1] for x in t])
    return tails[:, 0], tails[:, 1], both


def _cross_sums(f: Frame, table: DataFrame, jobs: list[tuple[int, int, int]], n_sim: int) -> dict:
    """For each job (key, network, seed) an n_sim x (networks + 1) array: sums, over the dyads, of the relabelled network
    times each network and times 1. Only cells that are not 0 are relabelled and joined."""
    k = len(f.nets)
    parts = None
    for key, which, seed in jobs:
        cells = permuted_cells(f, f.nets[which], n_sim, seed).select(F.lit(key).alias("key"), F.lit(which).alias("which"), "rep", "i", "j", "v")
        parts = cells if parts is None else parts.unionAll(cells)
    sums = parts.join(table, ["i", "j"], "left").groupBy("key", "which", "rep").agg(*[F.sum(F.col("v") * F.coalesce(f"v{m}", F.lit(0.0))).alias(f"s{m}") for m in range(k)], F.sum("v").alias("one"))
    out = {(key, which): np.zeros((n_sim, k + 1)) for key, which, _ in jobs}
    for r in sums.collect():
        out[r["key"], r["which"]][r["rep"]] = [r[f"s{m}"] for m in range(k)] + [r["one"]]
    return out


def netlm(y: Net, xs: Net | Sequence[Net], intercept: bool = True, nullhyp: str = "qapspp", n_sim: int = 1000, mode: str = "auto", seed: int = 0, missing: str = "error", dependent: str = "error") -> NetRegression:
    """Least squares of a network on others over their dyads; t values against relabellings of the response (qapy), of each
    predictor (qapx), of each predictor's residuals on the others (qapspp), or Student's t (classical).

    Everything follows from sums of products: one aggregation for the fit, one join and aggregation for all relabellings.
    Terms that depend on each other (a network without ties among them) have no estimates: an error, or under
    ``dependent="nan"`` NaN for every term and relabelling, as 0/0 gives in SQL.
    """
    check_option("dependent", dependent, ("error", "nan"))
    f, names, null, masked = _prepare(y, xs, intercept, nullhyp, n_sim, mode, missing, "netlm")
    spark, k = y.spark, len(names)
    table = stored(f.tied(), "dyads")
    n, predictors = f.size(), [F.col(f"v{m}") for m in range(1, len(f.nets))]
    columns = ([F.lit(1.0)] if intercept else []) + predictors
    whole = _gram(table, [*columns, F.col("v0")])
    if intercept:  # dyads without any tie add to their number only
        whole[0, 0] = n
    g, c, yy = whole[:k, :k], whole[:k, k], float(whole[k, k])
    if dependent == "nan" and n > k and _dependent(g):
        nan, none = np.full(k, NAN), None if null == "classical" else np.full((n_sim, k), NAN)
        return NetRegression("lm", spark, names, nan, np.full((k, k), NAN), nan, nan, nan, nan, none, NAN, n, n - k, null, 0 if none is None else n_sim, f.directed, masked)
    _check_design(g, n)
    coef = np.linalg.solve(g, c)
    rss = max(yy - coef @ c, 0.0)
    df = n - k
    covariance = np.linalg.inv(g) * rss / df
    with np.errstate(divide="ignore", invalid="ignore"):
        t = coef / np.sqrt(np.diag(covariance))
        loglik = -n / 2 * (math.log(2 * math.pi) + 1 + np.log(rss / n))
    sst = yy - c[0] ** 2 / n if intercept else yy
    r2 = 1 - rss / sst if sst > 0 else 0.0
    adjusted = 1 - (1 - r2) * (n - bool(intercept)) / df
    dist = None
    if null == "classical":
        p = _classical(spark, t, df)
    else:
        dist = _lm_replicates(f, table, g, c, yy, n, intercept, null, n_sim, seed)
        p = _shares(dist, t)
    return NetRegression("lm", spark, names, coef, covariance, t, *p, dist, float(loglik), n, df, null, 0 if dist is None else n_sim, f.directed, masked, r_squared=r2, adj_r_squared=adjusted)


def _lm_replicates(f: Frame, table: DataFrame, g, c, yy, n, intercept: bool, null: str, n_sim: int, seed: int) -> np.ndarray:
    k, lead = len(g), int(intercept)
    dist = np.zeros((n_sim, k))
    if null == "qapy":
        sums = _cross_sums(f, table, [(0, 0, seed)], n_sim)[0, 0]
        cs = np.concatenate([sums[:, -1:], sums[:, 1:-1]], axis=1) if intercept else sums[:, 1:-1]
        for r in range(n_sim):
            dist[r] = _t_values(g, cs[r], yy, n)
        return dist
    jobs = [(i, w, seed + i) for i in range(k) for w in (range(1, len(f.nets)) if null == "qapspp" else [i - lead + 1]) if w > 0]
    sums = _cross_sums(f, table, jobs, n_sim)
    full = np.zeros((k + 1, k + 1))
    full[:k, :k], full[:k, k], full[k, :k], full[k, k] = g, c, c, yy
    for i in range(k):
        others = [j for j in range(k) if j != i]
        # the relabelled column is a combination of relabelled columns: itself, or its residual on the others
        mix = np.zeros(k)
        mix[i] = 1.0
        if null == "qapspp":
            mix[others] = -np.linalg.solve(g[np.ix_(others, others)], g[others, i])
        square = mix @ g @ mix
        for r in range(n_sim):
            cross = np.zeros(k + 1)  # with each column, then the response
            for a in np.flatnonzero(mix):
                if a < lead:
                    cross += mix[a] * np.append(full[0, :k], c[0])
                else:
                    s = sums[i, a - lead + 1][r]
                    with_x = np.concatenate([s[-1:], s[1:-1]]) if intercept else s[1:-1]
                    cross += mix[a] * np.append(with_x, s[0])
            order = others + [i]
            gr = g[np.ix_(order, order)].copy()
            gr[-1, :-1] = gr[:-1, -1] = cross[others]
            gr[-1, -1] = square
            try:
                dist[r, i] = _t_values(gr, np.append(c[others], cross[k]), yy, n)[-1]
            except np.linalg.LinAlgError:
                dist[r, i] = NAN
    return dist


# ---------------------------------------------------------------- logit


def newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, maxiter: int = 100, tol: float = 1e-8):
    """(coefficients, log-likelihood, covariance, converged, last step) of a weighted logistic regression.

    Steps are halved until the likelihood doesn't fall; a singular system takes its least-squares step.
    """
    k = x.shape[1]
    b = np.zeros(k)

    def value(b):
        eta = x @ b
        return float((weight * (y * eta - np.logaddexp(0, eta))).sum())

    now, converged, d = value(b), False, np.zeros(k)
    for _ in range(maxiter):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -700, 700)))
        grad, info = x.T @ (weight * (y - p)), (x * (weight * p * (1 - p))[:, None]).T @ x
        d = np.linalg.lstsq(info, grad, rcond=1e-14)[0]
        t = 1.0
        while (new := value(b + t * d)) < now - 1e-12 * abs(now) and t > 1e-8:
            t /= 2
        b, gain, now = b + t * d, new - now, new
        if np.abs(grad).max(initial=0) <= tol * max(1.0, weight.sum()) and gain <= tol * (abs(now) + tol):
            converged = True
            break
    p = 1 / (1 + np.exp(-np.clip(x @ b, -700, 700)))
    info = (x * (weight * p * (1 - p))[:, None]).T @ x
    try:
        covariance = np.linalg.inv(info)
    except np.linalg.LinAlgError:
        covariance = np.full((k, k), NAN)
    return b, now, covariance, converged, d


def separation(x: np.ndarray, y: np.ndarray) -> Separation:
    """Whether some direction predicts every row at least as well as chance and some rows surely.

    On such data Newton's steps go on along that direction. The direction in which late steps
    agree is rounded to its clear terms and tried exactly on the data.
    """
    sign = 2 * y - 1
    ones = np.ones(len(y))
    # rows of one sign only in every way: steps settle within a few dozen iterations
    b, last = np.zeros(x.shape[1]), None
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -700, 700)))
        info = (x * (ones * p * (1 - p))[:, None]).T @ x
        d = np.linalg.lstsq(info, x.T @ (y - p), rcond=1e-15)[0]
        if np.abs(d).max(initial=0) < 1e-9:
            return Separation()
        b = b + d / max(1.0, np.abs(d).max() / 5)
        last = d
        if np.abs(x @ b).max() > 18:
            break
    size = np.abs(last).max()
    step = np.where(np.abs(last) < 1e-3 * size, 0.0, last / size)
    # a direction with simple proportions is taken as such
    neat = np.array([float(Fraction(v).limit_denominator(1000)) for v in step])
    for d in (neat, step):
        margin = sign * (x @ d)
        if margin.min() >= -1e-9 and margin.max() > 1e-9:
            exact = [sum((Fraction(float(a)) * Fraction(float(v)) for a, v in zip(row, d, strict=True)), Fraction(0)) * int(s) for row, s in zip(x, sign, strict=True)]
            terms = tuple(int(i) for i in np.flatnonzero(d) if not _is_constant(x[:, i]) or np.count_nonzero(d) == 1)
            return Separation(True, min(exact) >= 0, terms or tuple(np.flatnonzero(d).tolist()), tuple(int(i) for i in np.flatnonzero(margin > 1e-9)))
    return Separation()


def _is_constant(column: np.ndarray) -> bool:
    return bool((column == column[0]).all())


def _deviance(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    if not x.shape[1]:
        return 2 * float(w.sum()) * math.log(2), np.zeros(0)
    b, loglik, *_ = newton(x, y, w, 200, 1e-10)
    return -2 * loglik, b


def _root(reduced: float, full: float, b: float) -> float:
    return float(np.sign(b) * math.sqrt(max(reduced - full, 0.0)))


def _spark_newton(rows: DataFrame, k: int, columns: list[str], maxiter: int = 100, tol: float = 1e-8):
    """The same fit with an aggregation of gradient and information a step, for designs beyond the driver."""
    b, now = np.zeros(k), None
    for _ in range(maxiter):
        eta = sum((F.lit(float(v)) * F.col(c) for v, c in zip(b, columns, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-eta))
        c = [F.col(x) for x in columns]
        sums = [F.sum(F.col("c") * (F.col("y") - p) * c[i]) for i in range(k)] + [F.sum(F.col("c") * p * (1 - p) * c[i] * c[j]) for i in range(k) for j in range(i, k)]
        sums.append(F.sum(F.col("c") * (F.col("y") * eta - F.log1p(F.exp(eta)))))
        got = list(rows.agg(*sums).first())
        grad, info = np.array(got[:k]), np.zeros((k, k))
        info[np.triu_indices(k)] = got[k:-1]
        info = info + info.T - np.diag(np.diag(info))
        if now is not None and np.abs(grad).max() <= tol and abs(got[-1] - now) <= tol * (abs(now) + tol):
            return b, got[-1], np.linalg.inv(info), True
        b, now = b + np.linalg.solve(info, grad), got[-1]
    return b, now, np.linalg.inv(info), False


def netlogit(y: Net, xs: Net | Sequence[Net], intercept: bool = True, nullhyp: str = "qapspp", statistic: str = "lr", n_sim: int = 1000, mode: str = "auto", seed: int = 0, missing: str = "error") -> NetRegression:
    """Logistic regression of a binary network on others, with the null hypotheses of ``netlm``.

    The statistic is the signed root of the likelihood ratio (lr), which separated relabellings have too, or Wald's z,
    which they lack: p-values of terms they touch are then withheld. A separated observed design has no
    finite estimate: a warning, no inference, no relabellings. Dyads with equal values are one weighted row of the fits.
    """
    check_option("statistic", statistic, ("lr", "wald"))
    f, names, null, masked = _prepare(y, xs, intercept, nullhyp, n_sim, mode, missing, "netlogit")
    spark, k = y.spark, len(names)
    tied = stored(f.tied(), "tied")
    if not tied.filter("v0 <> 0 and v0 <> 1").isEmpty():
        raise ValueError("netlogit: the response's ties must all have the value 1")
    columns, n = [f"v{m}" for m in range(1, len(f.nets))], f.size()
    rows = tied.groupBy(F.col("v0").alias("y"), *columns).agg(F.count(F.lit(1)).cast("double").alias("c"))
    if (none := n - tied.count()) > 0:  # all dyads without any tie are one row
        rows = rows.unionAll(spark.createDataFrame([(*[0.0] * (len(columns) + 1), float(none))], rows.schema))
    rows = stored(rows, "design")
    terms = (["one"] if intercept else []) + columns
    design = rows.withColumn("one", F.lit(1.0))
    _check_design(_gram(design, [F.col(t) * F.sqrt("c") for t in terms]), n)
    if rows.count() > DRIVER_ROWS:
        if null != "classical":
            raise ValueError("a design of so many distinct dyads takes nullhyp='classical'")
        coef, loglik, covariance, converged = _spark_newton(design, k, terms)
        verdict = Separation()
    else:
        data = np.array([list(r) for r in design.orderBy("y", *columns).select("y", "c", *terms).collect()], float).reshape(-1, k + 2)
        yv, w, x = data[:, 0], data[:, 1], data[:, 2:]
        verdict = separation(x, yv)
        coef, loglik, covariance, converged, _ = newton(x, yv, w, 50 if verdict.separated else 100)
    null_deviance = 2 * n * math.log(2)

    def result(t, p, dist, kind, ok):
        return NetRegression("logit", spark, names, coef, covariance, t, *p, dist, loglik, n, n - k, null, 0 if dist is None else n_sim, f.directed, masked, kind, ok, verdict, null_deviance=null_deviance)

    if verdict.separated:
        warnings.warn(f"netlogit: the design is separated in {', '.join(names[i] for i in verdict.terms)}; inference is withheld", stacklevel=2)
        nan = np.full(k, NAN)
        return result(nan, (nan, nan, nan), None, "wald" if null == "classical" else statistic, False)
    if not converged:
        warnings.warn("netlogit did not converge", stacklevel=2)
    with np.errstate(invalid="ignore"):
        wald = coef / np.sqrt(np.diag(covariance))
    if null == "classical":
        return result(wald, _classical(spark, wald, n - k), None, "wald", converged)
    reduced = [_deviance(np.delete(x, i, axis=1), yv, w)[0] for i in range(k)]
    t = np.array([_root(reduced[i], -2 * loglik, coef[i]) for i in range(k)]) if statistic == "lr" else wald
    dist = _logit_replicates(f, stored(f.dyads(), "dyads"), x, yv, w, columns, intercept, null, statistic, reduced, n_sim, seed)
    p = [np.array(v) for v in _shares(dist, t)]
    held = np.isnan(dist).any(axis=0)
    if held.any():
        warnings.warn(f"netlogit: {int(np.isnan(dist).any(axis=1).sum())} of {n_sim} permutation replicates are separated; p-values of {', '.join(np.array(names)[held])} are withheld", stacklevel=2)
        for v in p:
            v[held] = NAN
    return result(t, p, dist, statistic, converged)


def _logit_replicates(f: Frame, table: DataFrame, x, yv, w, columns, intercept: bool, null: str, statistic: str, reduced, n_sim: int, seed: int) -> np.ndarray:
    """n_sim x k statistics; each relabelling's distinct dyads, counted in Spark, are fitted in a task of their own."""
    k, lead = x.shape[1], int(intercept)
    parts, both = [], not f.directed
    for i in [0] if null == "qapy" else range(k):
        if null == "qapy":
            column = F.col("v0")
        elif null == "qapx" or k == 1:
            column = F.lit(1.0) if i < lead else F.col(columns[i - lead])
        else:
            others = [j for j in range(k) if j != i]
            g = (x * w[:, None]).T @ x
            b = np.linalg.solve(g[np.ix_(others, others)], g[others, i])
            column = F.lit(1.0) if i < lead else F.col(columns[i - lead])
            for j, v in zip(others, b, strict=True):
                column = column - F.lit(float(v)) * (F.lit(1.0) if j < lead else F.col(columns[j - lead]))
        values = table.select("i", "j", F.round(column, 12).alias("m"))
        if both:
            values = values.unionAll(values.select(F.col("j").alias("i"), F.col("i").alias("j"), "m"))
        perm = permutations(f.nets[0].vertices.select("vid"), n_sim, seed + i, f.mode1)
        p, q = perm.select("rep", F.col("vid").alias("i"), F.col("new").alias("a")), perm.select("rep", F.col("vid").alias("j"), F.col("new").alias("b"))
        moved = values.join(p, "i").join(q, ["rep", "j"]).select("rep", F.col("a").alias("i"), F.col("b").alias("j"), "m")
        joined = table.join(moved, ["i", "j"]).groupBy("rep", F.col("v0").alias("y"), *columns, "m").agg(F.count(F.lit(1)).cast("double").alias("c"))
        parts.append(joined.withColumn("term", F.lit(i)))
    all_ = parts[0]
    for more in parts[1:]:
        all_ = all_.unionAll(more)

    def z(xp, yp, wp):
        if separation(xp, yp).separated:
            return np.full(xp.shape[1], NAN)
        b, _, cov, ok, _ = newton(xp, yp, wp)
        if not ok:
            raise ValueError("a replicate failed to converge")
        return b / np.sqrt(np.diag(cov))

    def one(key, found):
        rep, i = key[0].as_py(), key[1].as_py()
        wp, m, yp = (np.asarray(found.column(c), float) for c in ("c", "m", "y"))
        xp = np.stack([np.ones(len(wp))] * lead + [np.asarray(found.column(c), float) for c in columns], axis=1)
        order = np.lexsort((m, yp, *xp.T))
        wp, m, yp, xp = wp[order], m[order], yp[order], xp[order]
        if null == "qapy":
            yp = m
            if statistic == "lr":
                full, b = _deviance(xp, yp, wp)
                got = [_root(_deviance(np.delete(xp, j, axis=1), yp, wp)[0], full, b[j]) for j in range(k)]
            else:
                got = z(xp, yp, wp)
            at = list(range(k))
        else:
            if null == "qapx":
                xp[:, i] = m
                place = i
            else:
                xp = np.concatenate([np.delete(xp, i, axis=1), m[:, None]], axis=1)
                place = k - 1
            if statistic == "lr":
                full, b = _deviance(xp, yp, wp)
                got = [_root(reduced[i], full, b[place])]
            else:
                got = [z(xp, yp, wp)[place]]
            at = [i]
        return pa.table({"rep": pa.array([rep] * len(at), pa.int64()), "term": pa.array(at, pa.int32()), "value": pa.array([float(v) for v in got], pa.float64())})

    out = np.full((n_sim, k), NAN)
    for r in all_.groupBy("rep", "term").applyInArrow(one, "rep long, term int, value double").collect():
        out[r["rep"], r["term"]] = r["value"]
    return out
