"""Cox models of any number of rows per key, as sums per distinct time (CX1, CX2, CX8, CX9, CR4).

A Newton step needs, at each time with an event, the sums of r, r x and r x x' over the rows at risk, r = exp(x b). Rows are
summed to distinct times, sums at risk run backwards over time by windows, ties are taken after Efron, and what is left
is one row of sums per key. Coefficients are a small table that is joined to the rows in each round; keys that have
converged leave. Only the small solve (one row per key) is numpy. A key of more than BLOCK_ROWS rows is cut into
ranges of time: windows run within a range and take the sums of the later ranges from a table of totals, so no task
holds a whole key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cohortspark.functions import cox_kernel as kernel
from cohortspark.functions.stats import chi2_sf, normal_two_sided
from cohortspark.operators.meta import Z
from cohortspark.operators.ranges import ranged, running
from cohortspark.sources.shared import kept

#: Rows of a key from which it is cut into ranges of time.
BLOCK_ROWS = 1_000_000
#: Coefficients of a model at most: sums grow with their square.
MOST_TERMS = 24
ROUNDS, HALVINGS = 20, 10
#: Condition number from which columns count as dependent.
MOST_CONDITION = 1e12


def _cells(p: int) -> list[tuple[int, ...]]:
    """What is summed: nothing, each column, each product of two columns."""
    return [(), *((i,) for i in range(p)), *((i, j) for i in range(p) for j in range(i, p))]


def _name(prefix: str, cell: tuple[int, ...]) -> str:
    return "_".join([prefix, *map(str, cell)])


def _product(cell: tuple[int, ...]) -> Column:
    out = F.lit(1.0)
    for i in cell:
        out = out * F.col(f"x{i}")
    return out


def in_blocks(rows: DataFrame, keys: Sequence[str], block_rows: int | None = None) -> tuple[DataFrame, bool]:
    """The rows with a column block (later times, larger blocks), and whether any key has several."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block_rows or BLOCK_ROWS))).cast("int").alias("_b"))
    return ranged(rows, keys, F.col("time"), "block", sizes)


def _eta(p: int) -> Column:
    out = F.lit(0.0)
    for i in range(p):
        out = out + F.col(f"x{i}") * F.col("_b")[i]
    return F.greatest(F.lit(-500.0), F.least(F.lit(500.0), out))


def risk_sums(rows: DataFrame, state: DataFrame, keys: Sequence[str], p: int, blocks: bool, weighted: bool = False) -> DataFrame:
    """One row per key and time with an event: d, sums of events (e, t) and of the rows at risk (s), for coefficients _b of the state.

    ``weighted``: rows have g (a curve just before their time) and cw (1 / g where they stay at risk after their
    time with weight g there, else 0).
    """
    keys, cells = list(keys), _cells(p)
    scored = rows.join(state.select(*keys, F.col("b").alias("_b")), keys).withColumn("_eta", _eta(p)).withColumn("_r", F.exp("_eta"))
    one = [F.sum("status").cast("double").alias("d"), F.sum(F.col("status") * F.col("_eta")).alias("eta")]
    one += [F.sum(F.col("status") * F.col(f"x{i}")).alias(f"e_{i}") for i in range(p)]
    one += [F.sum(F.col("_r") * _product(c)).alias(_name("s", c)) for c in cells]
    one += [F.sum(F.col("status") * F.col("_r") * _product(c)).alias(_name("t", c)) for c in cells]
    if weighted:
        one += [F.max("g").alias("g")] + [F.sum(F.col("cw") * F.col("_r") * _product(c)).alias(_name("c", c)) for c in cells]
    times = scored.groupBy(*keys, "block", "time").agg(*one)
    out = running(times, keys, [_name("s", c) for c in cells], blocks)
    if weighted:
        out = running(out, keys, [_name("c", c) for c in cells], blocks, later=False, own=False)
        out = out.withColumns({_name("s", c): F.col(_name("s", c)) + F.col("g") * F.col(_name("c", c)) for c in cells})
    return out.where("d > 0")


def tied(times: DataFrame, p: int, cells: list[tuple[int, ...]] | None = None) -> DataFrame:
    """One row for each of the d events of a time: k of d (share f), and sums at risk a less so much of the tied events."""
    cells = cells if cells is not None else _cells(p)
    steps = times.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("d").cast("int") - 1))).withColumn("f", F.col("k") / F.col("d"))
    return steps.withColumns({_name("a", c): F.col(_name("s", c)) - F.col("f") * F.col(_name("t", c)) for c in cells})


def _moments(p: int) -> list[Column]:
    """Score and information of a row of ``tied``, u_i and i_ij."""
    m = [F.col(f"a_{i}") / F.col("a") for i in range(p)]
    return [(F.col(f"e_{i}") / F.col("d") - m[i]).alias(f"u_{i}") for i in range(p)] + [(F.col(_name("a", (i, j))) / F.col("a") - m[i] * m[j]).alias(_name("i", (i, j))) for i in range(p) for j in range(i, p)]


def _evaluated(times: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    """One row per key: log likelihood, score and information (upper half)."""
    part = tied(times, p).select(*keys, (F.col("eta") / F.col("d") - F.log("a")).alias("ll"), *_moments(p))
    names = [c for c in part.columns if c not in keys and c != "ll"]
    out = part.groupBy(*keys).agg(F.sum("ll").alias("ll"), *(F.sum(c).alias(c) for c in names))
    return out.select(*keys, F.col("ll").alias("new_ll"), F.array(*(c for c in names if c[0] == "u")).alias("u"), F.array(*(c for c in names if c[0] == "i")).alias("info"))


STATE = "b array<double>, last array<double>, ll double, step array<double>, on array<boolean>, cov array<double>, round int, halved int, converged boolean, done boolean"


def matrix(upper: Sequence[float], p: int) -> np.ndarray:
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = upper
    return out + np.triu(out, 1).T


def solved(info: np.ndarray, u: np.ndarray, on: np.ndarray) -> np.ndarray | None:
    """Step of the coefficients that are in the model; None where the sums determine none."""
    out, at = np.zeros(len(u)), np.flatnonzero(on)
    sub = info[np.ix_(at, at)]
    if not np.isfinite(sub).all() or np.linalg.cond(sub) > MOST_CONDITION:
        return None
    out[at] = np.linalg.solve(sub, u[at])
    return out if np.isfinite(out).all() else None


def _inverse(info: np.ndarray, on: np.ndarray) -> np.ndarray:
    out, at = np.full(info.shape, np.nan), np.flatnonzero(on)
    try:
        out[np.ix_(at, at)] = np.linalg.inv(info[np.ix_(at, at)])
    except np.linalg.LinAlgError:
        pass
    return out


def _moved(keys: list[str], p: int):
    """A function of batches of keys: takes the evaluation at the tried coefficients, keeps or halves the step, tries the next."""

    def one(r) -> tuple:
        b, last, step, on = (np.array(r[c]) for c in ("b", "last", "step", "on"))
        ll, new, first = r["ll"], r["new_ll"], r["round"] == 0
        if r["u"] is None:  # no event
            return (b, last, ll, step, on, r["cov"], r["round"], r["halved"], False, True)
        if not first and not new >= ll - 1e-12 and r["halved"] < HALVINGS:
            step = step / 2
            return (last + step, last, ll, step, on, r["cov"], r["round"], r["halved"] + 1, False, False)
        info, u = matrix(r["info"], p), np.array(r["u"])
        near = not first and abs(new - ll) <= kernel.TOLERANCE * max(1.0, abs(new))
        cov = _inverse(info, on)
        move = None if near or r["round"] >= ROUNDS else solved(info, u, on)
        if move is None:
            return (b, b, new, np.zeros(p), on, cov.ravel(), r["round"], 0, bool(near), True)
        return (b + move, b, new, move, on, cov.ravel(), r["round"] + 1, 0, False, False)

    names = [c.split()[0] for c in STATE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            with np.errstate(all="ignore"):
                rows = [one(r) for r in batch.to_dict("records")]
            made = pd.DataFrame({n: [list(x[k]) if isinstance(x[k], np.ndarray) else x[k] for x in rows] for k, n in enumerate(names)})
            yield pd.concat([batch[keys].reset_index(drop=True), made], axis=1)[[*keys, *names]]

    return run


def _typed(df: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)


def newton(rows: DataFrame, start: DataFrame, keys: Sequence[str], p: int, blocks: bool, weighted: bool = False) -> DataFrame:
    """Fits of all keys: keys, b, cov (p x p by rows), ll, on, converged.

    rows: keys, block, time, status, x0.. ; start: keys and on, the columns that are in the model of each key. The
    result is a table in the shared folder; those of the rounds are removed.
    """
    keys = list(keys)
    state = start.select(*keys, F.array_repeat(F.lit(0.0), p).alias("b"), F.array_repeat(F.lit(0.0), p).alias("last"), F.lit(0.0).alias("ll"), F.array_repeat(F.lit(0.0), p).alias("step"), "on", F.array_repeat(F.lit(float("nan")), p * p).alias("cov"), F.lit(0).alias("round"), F.lit(0).alias("halved"), F.lit(False).alias("converged"), F.lit(False).alias("done"))
    table = kept(state)
    while True:
        open_ = table.df.where("NOT done")
        got = _evaluated(risk_sums(rows, open_, keys, p, blocks, weighted), keys, p)
        moved = open_.join(got, keys, "left").mapInPandas(_moved(keys, p), _typed(start, keys) + STATE)
        seen = Observation()
        new = kept(table.df.where("done").unionByName(moved).observe(seen, F.sum((~F.col("done")).cast("long")).alias("open")))
        table.remove()
        table = new
        if not seen.get["open"]:
            return table.df.select(*keys, "b", "cov", "ll", "on", "converged")


def residual_test(rows: DataFrame, fits: DataFrame, keys: Sequence[str], p: int, blocks: bool) -> DataFrame:
    """CX9: score test of each coefficient's change with Kaplan-Meier time and of all: keys, j (-1: all), chisq, df, p.

    At the fitted coefficients the score of x g(t) and its variance given x come from weighted risk-set moments; g is one minus
    the survival just before a time, less its mean over the events.
    """
    keys = list(keys)
    times = risk_sums(rows, fits, keys, p, blocks)
    # survival just before a time: deaths and rows at risk
    alive = rows.groupBy(*keys, "block", "time").agg(F.sum("status").cast("double").alias("d"), F.count(F.lit(1)).cast("double").alias("n"))
    alive = running(alive, keys, ["n"], blocks).withColumn("h", F.log(F.greatest(1 - F.col("d") / F.col("n"), F.lit(1e-300))))
    before = running(alive, keys, ["h"], blocks, later=False, own=False).where("d > 0").select(*keys, "block", "time", "d", (1 - F.exp("h")).alias("g"))
    mean = before.groupBy(*keys).agg((F.sum(F.col("g") * F.col("d")) / F.sum("d")).alias("_mean"))
    g = before.join(mean, keys).select(*keys, "block", "time", (F.col("g") - F.col("_mean")).alias("g"))
    part = tied(times.join(g, [*keys, "block", "time"]), p).select(*keys, "g", *_moments(p))
    us = [c for c in part.columns if c.startswith("u_")]
    vs = [c for c in part.columns if c.startswith("i_")]
    sums = part.groupBy(*keys).agg(*(F.sum(F.col("g") * F.col(c)).alias(c) for c in us), *(F.sum(c).alias(c) for c in vs), *(F.sum(F.col("g") * F.col(c)).alias("g" + c) for c in vs), *(F.sum(F.col("g") * F.col("g") * F.col(c)).alias("gg" + c) for c in vs))
    packed = sums.select(*keys, *(F.array(*cols).alias(n) for n, cols in (("u", us), ("v", vs), ("gv", ["g" + c for c in vs]), ("ggv", ["gg" + c for c in vs]))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                at = np.flatnonzero(np.array(r["on"]))
                v, gv, ggv = (matrix(r[c], p)[np.ix_(at, at)] for c in ("v", "gv", "ggv"))
                u, head = np.array(r["u"])[at], [r[k] for k in keys]
                try:
                    inner = ggv - gv @ np.linalg.inv(v) @ gv
                    found = [(int(j), u[k] ** 2 / inner[k, k], 1.0) for k, j in enumerate(at)] + [(-1, u @ np.linalg.solve(inner, u), float(len(at)))]
                except np.linalg.LinAlgError:
                    found = [(int(j), np.nan, 1.0) for j in at] + [(-1, np.nan, float(len(at)))]
                out += [[*head, j, *((float(c), df, chi2_sf(float(c), df)) if np.isfinite(c) else (None, df, None))] for j, c, df in found]
            yield pd.DataFrame(out, columns=[*keys, "j", "chisq", "df", "p"])

    return packed.join(fits.select(*keys, "on"), keys).mapInPandas(run, _typed(fits, keys) + "j int, chisq double, df double, p double")


def censoring(rows: DataFrame, keys: Sequence[str], blocks: bool) -> DataFrame:
    """The Kaplan-Meier curve of censoring just before each time (g); events leave before censorings of the same time.

    Rows: keys, block, time, code (0 censored).
    """
    keys = list(keys)
    at = rows.groupBy(*keys, "block", "time").agg(F.sum((F.col("code") == 0).cast("double")).alias("c"), F.count(F.lit(1)).cast("double").alias("n"))
    at = at.withColumn("gone", F.col("n") - F.col("c"))
    at = running(at, keys, ["n"], blocks)
    left = F.col("n") - F.col("gone")
    at = at.withColumn("h", F.when(left > 0, F.log(F.greatest(1 - F.col("c") / left, F.lit(1e-300)))).otherwise(0.0))
    return running(at, keys, ["h"], blocks, later=False, own=False).select(*keys, "block", "time", F.exp("h").alias("g"))


def sandwich(rows: DataFrame, fits: DataFrame, keys: Sequence[str], p: int, blocks: bool) -> DataFrame:
    """Patient-clustered variance of weighted fits: keys, robust (p x p by rows).

    A patient's score residual is what its own event gives, less its share of the hazard of every event it was at risk for:
    sums of hazards and of hazard times mean over earlier times, and, weighted by g, over later ones for patients
    that stay after a competing event.
    """
    keys = list(keys)
    cells = [(), *((i,) for i in range(p))]
    steps = tied(risk_sums(rows, fits, keys, p, blocks, True), p, cells)
    mean = lambda c: F.lit(1.0) if not c else F.col(_name("a", c)) / F.col("a")
    hazard = steps.groupBy(*keys, "block", "time", "g").agg(
        *(F.sum(mean(c) / F.col("a")).alias(_name("h", c)) for c in cells), *(F.sum((1 - F.col("f")) * mean(c) / F.col("a")).alias(_name("o", c)) for c in cells), *(F.avg(mean(c)).alias(_name("m", c)) for c in cells)
    )
    grid = rows.select(*keys, "block", "time").distinct().join(hazard, [*keys, "block", "time"], "left")
    h, q = [_name("h", c) for c in cells], [_name("q", c) for c in cells]
    grid = grid.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in h}).withColumns({b: F.col(a) * F.coalesce("g", F.lit(0.0)) for a, b in zip(h, q, strict=True)}).drop("g")
    # hazards before a row's time, its own time's, and those after it
    grid = grid.withColumns({"now_" + n: F.col(n) for n in h})
    grid = running(running(grid, keys, h, blocks, later=False, own=False), keys, q, blocks, own=False)
    joined = rows.join(fits.select(*keys, F.col("b").alias("_b")), keys).withColumn("_r", F.exp(_eta(p))).join(grid, [*keys, "block", "time"])
    parts = []
    for i in range(p):
        x = F.col(f"x{i}")
        share = lambda pre, i=i, x=x: x * F.col(pre) - F.col(f"{pre}_{i}")
        now = F.when(F.col("status") == 1, share("o")).otherwise(share("now_h"))
        own = F.when(F.col("status") == 1, x - F.col(f"m_{i}")).otherwise(0.0)
        parts.append((own - F.col("_r") * (share("h") + F.coalesce(now, F.lit(0.0)) + F.col("cw") * share("q"))).alias(f"l{i}"))
    meat = joined.select(*keys, *parts).groupBy(*keys).agg(F.array(*(F.sum(F.col(f"l{i}") * F.col(f"l{j}")) for i in range(p) for j in range(i, p))).alias("meat"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                cov, at = np.array(r["cov"], dtype=float).reshape(p, p), np.flatnonzero(np.array(r["on"]))
                v, robust = cov[np.ix_(at, at)], np.full((p, p), np.nan)
                robust[np.ix_(at, at)] = v @ matrix(r["meat"], p)[np.ix_(at, at)] @ v
                out.append([*(r[k] for k in keys), robust.ravel().tolist()])
            yield pd.DataFrame(out, columns=[*keys, "robust"])

    return meat.join(fits.select(*keys, "cov", "on"), keys).mapInPandas(run, _typed(fits, keys) + "robust array<double>")


class Design:
    """Complete rows of a model as columns: keys, block, time, status, x0.. (numbers standardised within their key, one column for each level
    but the first in order), and per key what the columns are.

    ``extra``: other columns that the rows keep; ``skip_flat``: numbers that do not vary in a key are no columns of it (but for the first).
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], cont: Sequence[str], cate: Sequence[str] = (), extra: Sequence[str] = (), block_rows: int | None = None, skip_flat: bool = False):
        self.keys, self.cont, self.cate = list(keys), list(cont), list(cate)
        keys = self.keys
        ok = F.col("time").isNotNull() & F.col("status").isNotNull()
        for c in self.cont:
            ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        for c in self.cate:
            ok = ok & F.col(c).isNotNull()
        rows = df.where(ok).select(*keys, F.col("time").cast("double").alias("time"), "status", *extra, *(F.col(c).cast("double").alias(c) for c in self.cont), *(F.col(c).cast("string").alias(c) for c in self.cate))
        self._made = kept(rows)
        rows = self._made.df
        widths: list[int] = []
        if self.cate:
            most = rows.groupBy(*keys).agg(*(F.countDistinct(c).alias(f"_{k}") for k, c in enumerate(self.cate))).agg(*(F.max(f"_{k}") for k in range(len(self.cate)))).first()
            widths = [max(0, (x or 1) - 1) for x in most]
        self.p = len(self.cont) + sum(widths)
        if self.p > MOST_TERMS:
            raise ValueError(f"more than {MOST_TERMS} terms in a model")
        about = [F.count(F.lit(1)).alias("n"), F.sum((F.col("status") == 1).cast("long")).alias("events")]
        about += [F.avg(c).alias(f"_m{k}") for k, c in enumerate(self.cont)] + [F.stddev_samp(c).alias(f"_s{k}") for k, c in enumerate(self.cont)]
        about += [F.sort_array(F.collect_set(c)).alias(f"_l{k}") for k, c in enumerate(self.cate)]
        info = rows.groupBy(*keys).agg(*about)
        # a number that does not vary is a column of zeros
        flat = [~F.coalesce(F.col(f"_s{k}") > 1e-12 * F.greatest(F.lit(1.0), F.abs(f"_m{k}")), F.lit(False)) for k in range(len(self.cont))]
        info = info.withColumns({f"_f{k}": x for k, x in enumerate(flat)})
        flat = [F.col(f"_f{k}") for k in range(len(self.cont))]
        info = info.withColumns({f"_s{k}": F.when(flat[k], 1.0).otherwise(F.col(f"_s{k}")) for k in range(len(self.cont))})
        self._kept = kept(info)
        info = self._kept.df
        x, on, names = [], [], []
        for k, c in enumerate(self.cont):
            x.append((F.col(c) - F.col(f"_m{k}")) / F.col(f"_s{k}"))
            on.append(~F.col(f"_f{k}") if skip_flat and k else F.lit(True))
            names.append(F.struct(F.lit(c).alias("variable"), F.lit("").alias("level"), F.col(f"_s{k}").alias("unit")))
        for k, c in enumerate(self.cate):
            for j in range(widths[k]):
                x.append((F.array_position(f"_l{k}", F.col(c)) == j + 2).cast("double"))
                on.append(F.size(f"_l{k}") > j + 1)
                names.append(F.struct(F.lit(c).alias("variable"), F.get(f"_l{k}", F.lit(j + 1)).alias("level"), F.lit(1.0).alias("unit")))
        #: One row per key: n, events, on (whether the key has the column) and terms (variable, level, unit of each column).
        term = "array<struct<variable: string, level: string, unit: double>>"
        self.keyed = info.select(*keys, "n", "events", F.array(*on).cast("array<boolean>").alias("on"), F.array(*names).cast(term).alias("terms"))
        rows = rows.join(info, keys).select(*keys, "time", "status", *extra, *(c.alias(f"x{k}") for k, c in enumerate(x)))
        rows, self.blocks = in_blocks(rows, keys, block_rows)
        self._rows = kept(rows)
        self.rows = self._rows.df
        self._made.remove()

    def fitted(self, on: DataFrame | None = None, weighted: DataFrame | None = None) -> DataFrame:
        """keys, n, events, terms and the fit of each key with two rows and an event at least.

        on: keys and on, instead of all columns; weighted: the rows with g and cw, as risk_sums takes them.
        """
        start = (self.keyed.select(*self.keys, "on") if on is None else on).join(self.keyed.where("n > 1 AND events > 0").select(*self.keys), self.keys)
        start = start.where(F.exists("on", lambda c: c)) if self.p else start.limit(0)
        return self.keyed.drop("on").join(newton(self.rows if weighted is None else weighted, start, self.keys, self.p, self.blocks, weighted is not None), self.keys)

    def products(self) -> DataFrame:
        """Centred sums of products of the columns of each key (upper half, by rows), to tell which columns others determine."""
        pairs = [(i, j) for i in range(self.p) for j in range(i, self.p)]
        n = F.count(F.lit(1))
        sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")) - F.sum(f"x{i}") * F.sum(f"x{j}") / n for i, j in pairs]
        return self.rows.groupBy(*self.keys).agg(F.array(*sums).alias("products"))

    def remove(self) -> None:
        """Delete the tables of the model; nothing that reads them may run after."""
        self._rows.remove()
        self._kept.remove()


TERM = "variable string, level string, n long, events long, b double, se double, hr double, lower double, upper double, p double, reason string, parameters int, epv double"


def _worst(names: list, on: np.ndarray, b: np.ndarray, products: np.ndarray, why: list, converged: bool) -> str:
    """The variable that carries least information: a constant one, then the last that others determine, then the largest or a faulty one."""
    at = np.flatnonzero(on)
    flat = [names[j] for j in at if products[j, j] <= 1e-10]
    if flat:
        return flat[0]
    scale = np.sqrt(np.diag(products)[at])
    sub = products[np.ix_(at, at)] / scale[:, None] / scale[None]
    rank = [np.linalg.matrix_rank(sub[: j + 1, : j + 1], tol=1e-9, hermitian=True) for j in range(len(at))]
    bound = [names[at[j]] for j in range(len(at)) if rank[j] == (rank[j - 1] if j else 0)]
    if bound:
        return bound[-1]
    if not converged:
        size = [abs(x) if np.isfinite(x) else np.inf for x in b]
        return names[at[int(np.argmax([size[j] for j in at]))]]
    return next(names[j] for j, w in zip(at, why, strict=True) if w)


def judged(fits: DataFrame, keys: Sequence[str], p: int, repair: bool = False, robust: bool = False, z: float = Z) -> DataFrame:
    """keys, ok, terms (the rows of TERM of a key) and, for faulty models to repair, the columns that are left (on).

    fits: as Design.fitted gives them, with products if they are to be repaired, with robust (variances) if those count.
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                names, levels, unit = ([t[c] for t in r["terms"]] for c in ("variable", "level", "unit"))
                on, unit = np.array(r["on"], dtype=bool), np.array(unit, dtype=float)
                at = np.flatnonzero(on)
                b = np.array(r["b"], dtype=float) / unit
                cov = np.array(r["robust" if robust else "cov"], dtype=float).reshape(p, p)
                with np.errstate(all="ignore"):
                    se = np.sqrt(np.diag(cov)) / unit
                why = [kernel.verdict(b[j], se[j], bool(r["converged"])) for j in at]
                whole = "not estimable: " + "; ".join(sorted({w for w in why if w})) if any(why) else None
                rows = []
                for j in at:
                    good = [float(b[j]), float(se[j]), float(np.exp(b[j])), float(np.exp(b[j] - z * se[j])), float(np.exp(b[j] + z * se[j])), normal_two_sided(b[j] / se[j])] if whole is None else [None] * 6
                    rows.append((names[j], levels[j], int(r["n"]), int(r["events"]), *good, whole, len(at), r["events"] / len(at)))
                drop, left = None, on.tolist()
                if whole is not None and repair:
                    drop = _worst(names, on, b, matrix(r["products"], p), why, bool(r["converged"]))
                    left = [bool(x and n != drop) for x, n in zip(on, names, strict=True)]
                    if not any(left):
                        drop, left = None, on.tolist()
                out.append([*(r[k] for k in keys), whole is None or drop is None, rows, left, drop, int(r["n"]), int(r["events"])])
            yield pd.DataFrame(out, columns=[*keys, "final", "rows", "on", "dropped", "n", "events"])

    term = ", ".join(c.replace(" ", ": ") for c in TERM.split(", "))
    return fits.mapInPandas(run, _typed(fits, keys) + f"final boolean, rows array<struct<{term}>>, on array<boolean>, dropped string, n long, events long")


def _term_rows(judged_: DataFrame, keys: list[str]) -> DataFrame:
    return judged_.select(*keys, F.explode("rows").alias("_t")).select(*keys, "_t.*")


def without_fit(d: Design) -> DataFrame:
    """Rows of keys without a model: one for each term, or for each variable if there is none."""
    keys = d.keys
    names = F.expr("filter(transform(terms, (t, j) -> struct(t.variable AS variable, t.level AS level, on[j] AS has)), t -> t.has)")
    bare = d.keyed.where(~((F.col("n") > 1) & (F.col("events") > 0) & F.exists("on", lambda c: c)))
    every = F.array(*(F.struct(F.lit(c).alias("variable"), F.lit("").alias("level"), F.lit(True).alias("has")) for c in [*d.cont, *d.cate]))
    out = bare.withColumn("_t", F.explode(F.when(F.size(names) > 0, names).otherwise(every)))
    none = [F.lit(None).cast("double").alias(c) for c in ("b", "se", "hr", "lower", "upper", "p")]
    return out.select(*keys, "_t.variable", "_t.level", "n", "events", *none, F.lit("no estimable term").alias("reason"), F.lit(0).alias("parameters"), F.lit(None).cast("double").alias("epv"))


def fit_models(df: DataFrame, keys: Sequence[str], cont: Sequence[str], cate: Sequence[str] = (), auto_repair: bool = False, block_rows: int | None = None, skip_flat: bool = False) -> DataFrame:
    """One joint model per key: keys and the columns of TERM, one row per number and per level but the first.

    parameters and epv: coefficients of the model and events for each. A faulty model has no estimates, its reasons stand on every row; with
    ``auto_repair`` the variable that carries least information leaves, in as many rounds as that takes, and has a row
    that says so.
    """
    d = Design(df, keys, cont, cate, block_rows=block_rows, skip_flat=skip_flat)
    keys = d.keys
    if not d.p:
        return without_fit(d)
    products = d.products() if auto_repair else None
    parts, on = [without_fit(d)], None
    while True:
        fits = d.fitted(on)
        seen = kept(judged(fits.join(products, keys) if auto_repair else fits, keys, d.p, auto_repair)).df
        parts.append(_term_rows(seen.where("final"), keys))
        left = seen.where("NOT final")
        if not auto_repair or left.isEmpty():
            break
        none = [F.lit(None).cast("double").alias(c) for c in ("b", "se", "hr", "lower", "upper", "p")]
        parts.append(left.select(*keys, F.col("dropped").alias("variable"), F.lit("").alias("level"), "n", "events", *none, F.lit("removed by repair").alias("reason"), F.lit(0).alias("parameters"), F.lit(None).cast("double").alias("epv")))
        on = left.select(*keys, "on")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
