"""Work over all cut-points of a marker, in parts of a key (RC1-RC3, KM9).

A key's rows are cut into parts by ranges of the marker. What the rows of earlier parts amount to at each time (how many
leave there, by status) is a prefix sum over parts, so a part's task starts from those sums and adds its own rows cut by cut:
the sums over marker rank and time that a whole key would need are never in one place. Equal rows are counted before
they move.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.cox_frame import in_blocks
from cohortspark.operators.ranges import quantiles, ranged, running
from cohortspark.sources.shared import kept

#: Cells (cuts by times) of a task, and of the tables it holds at once; rows of a task.
PART_CELLS, CELLS, PART_ROWS = 200_000_000, 1 << 20, 100_000


def placed(df: DataFrame, keys: Sequence[str], horizon: float | None, block_rows: int | None = None) -> tuple[DataFrame, bool]:
    """Counted rows: keys, block, value, e, dead, time, m. e: event times up to the row's time (with a horizon; events after it do not
    count as dead), or distinct times up to it."""
    keys = list(keys)
    rows = df.select(*keys, F.col("time").cast("double").alias("time"), F.col("status").cast("int").alias("status"), F.col("value").cast("double").alias("value"))
    dead = (F.col("status") != 0) & (F.col("time") <= horizon) if horizon is not None else F.col("status") != 0
    counted = rows.withColumn("dead", dead.cast("int")).groupBy(*keys, "time", "dead", "value").agg(F.count(F.lit(1)).alias("m"))
    # sizes, times and the rows themselves read them
    counted, blocks = in_blocks(kept(counted).df, keys, block_rows)
    marks = F.max("dead") if horizon is not None else F.max(F.lit(1))
    times = running(counted.groupBy(*keys, "block", "time").agg(marks.cast("double").alias("e")), keys, ["e"], blocks, later=False)
    return counted.join(times.withColumn("e", F.col("e").cast("int")), [*keys, "block", "time"]), blocks


def survival_to(rows: DataFrame, keys: Sequence[str], blocks: bool) -> DataFrame:
    """Kaplan-Meier survival of all rows at the horizon that ``placed`` was given, their number and the number of event times: keys, s, n, times."""
    keys = list(keys)
    at = rows.groupBy(*keys, "block", "time").agg(F.sum(F.col("m") * F.col("dead")).cast("double").alias("d"), F.sum("m").cast("double").alias("n"), F.max("e").alias("e"), F.sum("m").alias("m"))
    at = running(at, keys, ["n"], blocks)
    log = F.sum(F.when((F.col("d") > 0) & (F.col("d") < F.col("n")), F.log(1 - F.col("d") / F.col("n"))))
    return at.groupBy(*keys).agg(F.when(F.max(((F.col("d") > 0) & (F.col("d") >= F.col("n"))).cast("int")) == 1, 0.0).otherwise(F.exp(F.coalesce(log, F.lit(0.0)))).alias("s"), F.sum("m").alias("n"), F.max("e").alias("times"))


def _carried(rows: DataFrame, keys: list[str], part: str = "part", more: Sequence[str] = ()) -> DataFrame:
    """Counts by e and dead over all earlier parts: keys, part, e, dead, m (and columns that e determines). Parts without earlier ones have no rows."""
    counts = rows.groupBy(*keys, part, "e", "dead", *more).agg(F.sum("m").alias("m"))
    parts = counts.select(*keys, part).distinct()
    grid = counts.select(*keys, "e", "dead", *more).distinct().join(parts, keys).join(counts.select(*keys, part, "e", "dead", "m"), [*keys, part, "e", "dead"], "left")
    w = Window.partitionBy(*keys, "e", "dead").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return grid.withColumn("m", F.sum("m").over(w)).where("m > 0")


def _in_parts(rows: DataFrame, keys: list[str], one: Callable[[pd.DataFrame], list], schema: str, kinds: dict[int, DataFrame]) -> DataFrame:
    """Apply a function to the tagged rows of each key and part."""
    tagged = None
    for kind, part in kinds.items():
        some = part.withColumn("kind", F.lit(kind))
        tagged = some if tagged is None else tagged.unionByName(some, allowMissingColumns=True)
    head = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, "part", *(c.split()[0] for c in schema.split(", "))]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        first = [g[k].iloc[0] for k in [*keys, "part"]]
        return pd.DataFrame([[*first, *r] for r in one(g)], columns=names)

    return tagged.groupBy(*keys, "part").applyInPandas(run, f"{head}, part int, {schema}")


def _by_falling_value(rows: DataFrame, keys: list[str], about: DataFrame, part_cells: int | None) -> DataFrame:
    wanted = about.select(*keys, F.ceil(F.greatest(F.col("n").cast("double") * (F.col("times") + 1) / F.lit(float(part_cells or PART_CELLS)), F.col("n") / F.lit(float(PART_ROWS if part_cells is None else max(1, part_cells // 64))))).cast("int").alias("_b"))
    return ranged(rows, keys, -F.col("value"), "part", wanted)[0]


def _survivals(entry: np.ndarray, e: np.ndarray, dead: np.ndarray, m: np.ndarray, wide: int, cuts: int, risk: np.ndarray, died: np.ndarray) -> np.ndarray:
    """Kaplan-Meier survival at each of so many cuts of the rows that have entered before it (row k before cut entry[k]).

    A row is at risk at its first e event times and dies, if it does, at the e-th. risk, died: counts by e of rows that are there from
    the start. Negative counts take rows away.
    """
    out, step = np.ones(cuts), max(1, CELLS // wide)
    order = np.argsort(entry, kind="stable")
    entry, e, dead, m = entry[order], e[order], dead[order], m[order]
    risk, died = risk.astype(float), died.astype(float)
    for k in range(0, cuts, step):
        n = min(step, cuts - k)
        a, b = np.searchsorted(entry, [k if k else -1, k + n])
        at = np.maximum(entry[a:b] - k, 0) * wide + e[a:b]
        here = risk + np.bincount(at, weights=m[a:b], minlength=n * wide).reshape(n, wide).cumsum(axis=0)
        fell = died + np.bincount(at, weights=m[a:b] * dead[a:b], minlength=n * wide).reshape(n, wide).cumsum(axis=0)
        left = here[:, ::-1].cumsum(axis=1)[:, ::-1]
        out[k : k + n] = np.prod(1 - fell[:, 1:] / np.maximum(left[:, 1:], 1), axis=1)
        risk, died = here[-1], fell[-1]
    return out


def _sums(g: pd.DataFrame, wide: int) -> tuple[np.ndarray, np.ndarray]:
    e, m = g["e"].to_numpy(int), g["m"].to_numpy(float)
    return np.bincount(e, weights=m, minlength=wide), np.bincount(e, weights=m * g["dead"].to_numpy(float), minlength=wide)


def area_km(df: DataFrame, keys: Sequence[str], horizon: float, part_cells: int | None = None, block_rows: int | None = None) -> DataFrame:
    """RC1, RC3: number of cuts (points, with the corners) and area by Kaplan-Meier estimates above each cut.

    A part gives the area between its own points, and its first and last point; the parts' pieces are joined at the end.
    """
    keys = list(keys)
    placed_, blocks = placed(df, keys, horizon, block_rows)
    rows = kept(placed_).df
    about = kept(survival_to(rows, keys, blocks)).df
    parts = kept(_by_falling_value(rows, keys, about, part_cells).groupBy(*keys, "part", "value", "e", "dead").agg(F.sum("m").alias("m"))).df
    carry = _carried(parts, keys)

    def one(g: pd.DataFrame) -> list:
        n, s, wide = float(g["n"].iloc[0]), float(g["s"].iloc[0]), int(g["times"].iloc[0]) + 1
        own, before = g[g["kind"] == 0], g[g["kind"] == 1]
        risk, died = _sums(before, wide)
        cuts, at = np.unique(-own["value"].to_numpy(float), return_inverse=True)
        m = own["m"].to_numpy(float)
        surv = _survivals(at + 1, own["e"].to_numpy(int), own["dead"].to_numpy(float), m, wide, len(cuts), risk, died)
        size = before["m"].sum() + np.concatenate([[0.0], np.cumsum(np.bincount(at, weights=m))[:-1]])
        t, f = (1 - surv) * size / n / (1 - s), surv * size / n / s
        return [[len(cuts), float(((t[1:] + t[:-1]) / 2 * np.diff(f)).sum()), float(f[0]), float(t[0]), float(f[-1]), float(t[-1])]]

    kinds = {k: x.join(about, keys) for k, x in ((0, parts), (1, carry))}
    pieces = _in_parts(df, keys, one, "cuts long, area double, f0 double, t0 double, f1 double, t1 double", kinds)
    w = Window.partitionBy(*keys).orderBy("part")
    link = (F.col("t0") + F.coalesce(F.lag("t1").over(w), F.lit(0.0))) / 2 * (F.col("f0") - F.coalesce(F.lag("f1").over(w), F.lit(0.0)))
    last = F.when(F.lead("part").over(w).isNull(), (1 + F.col("t1")) / 2 * (1 - F.col("f1"))).otherwise(0.0)
    return pieces.withColumn("piece", F.col("area") + link + last).groupBy(*keys).agg((F.sum("cuts") + 2).alias("points"), F.sum("piece").alias("auc"))


def area_nne(df: DataFrame, keys: Sequence[str], horizon: float, span: float | None = None, part_cells: int | None = None, block_rows: int | None = None) -> DataFrame:
    """RC2: the same by nearest neighbours: survival at each marker value is that of the rows within the share ``span`` of ranks on either side.

    The neighbours of rising values are a window that rows enter and leave once. A part has the rows that enter or leave while
    its values pass, and the sums of those that did before.
    """
    keys = list(keys)
    placed_, _ = placed(df, keys, horizon, block_rows)
    rows = kept(placed_.groupBy(*keys, "value", "e", "dead").agg(F.sum("m").alias("m"))).df
    wide = rows.groupBy(*keys).agg(F.sum("m").alias("n"), F.max("e").alias("times"))
    wide = wide.withColumn("span", F.lit(float(span)) if span is not None else 0.25 * F.pow(F.col("n").cast("double"), -0.2))
    wide = wide.withColumn("_b", F.greatest(F.lit(1), F.ceil(F.col("n").cast("double") * (F.col("times") + 1) / F.lit(float(part_cells or PART_CELLS)))).cast("int"))
    about = kept(wide.withColumn("width", F.ceil(F.col("n") / F.col("_b")).cast("long"))).df
    # the place of a value: rows below it
    sizes = about.select(*keys, F.ceil(F.col("n") / F.lit(float(block_rows or 1_000_000))).cast("int").alias("_b"))
    values, several = ranged(rows.groupBy(*keys, "value").agg(F.sum("m").alias("c")), keys, F.col("value"), "vblock", sizes)
    values = values.withColumn("place", F.col("c").cast("double"))
    values = kept(running(values, keys, ["place"], several, later=False, own=False, order="value", block="vblock").withColumn("place", F.round("place").cast("long"))).df
    at = rows.join(values.select(*keys, "value", "place"), [*keys, "value"]).join(about.select(*keys, "n", "times", "span", "width"), keys)
    reach = F.col("span") * F.col("n")
    last = F.floor((F.col("n") - 1) / F.col("width")).cast("int")
    own = values.join(about.select(*keys, "n", "times", "span", "width"), keys).withColumn("part", F.floor(F.col("place") / F.col("width")).cast("int"))
    # the part during which a row enters and leaves the window, with room for ties at its edge
    enter = at.withColumn("part", F.greatest(F.lit(0), F.floor((F.col("place") - reach + 0.5) / F.col("width"))).cast("int")).where(F.col("part") <= last)
    leave = at.withColumn("part", F.floor((F.col("place") + reach + 0.5) / F.col("width")).cast("int")).where(F.col("part") <= last)

    def before(moves: DataFrame) -> DataFrame:
        """Counts of the moves of earlier parts, for every part with values."""
        counts = moves.groupBy(*keys, "part", "e", "dead").agg(F.sum("m").alias("m"))
        every = own.select(*keys, "part").distinct().unionByName(counts.select(*keys, "part")).distinct()
        grid = counts.select(*keys, "e", "dead").distinct().join(every, keys).join(counts, [*keys, "part", "e", "dead"], "left")
        w = Window.partitionBy(*keys, "e", "dead").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        return grid.withColumn("m", F.sum("m").over(w)).where("m > 0").join(about.select(*keys, "n", "times", "span", "width"), keys)

    def one(g: pd.DataFrame) -> list:
        mine = g[g["kind"] == 0].sort_values("place")
        if not len(mine):
            return []
        n, wide, span = float(g["n"].iloc[0]), int(g["times"].iloc[0]) + 1, float(g["span"].iloc[0])
        place = mine["place"].to_numpy(float) / n
        entry, e, dead, m = [], [], [], []
        for kind, sign in ((1, 1.0), (2, -1.0)):
            x = g[g["kind"] == kind]
            there = x["place"].to_numpy(float) / n
            # the first value whose window has the row (or no longer has it)
            k = np.searchsorted(place, there - span if sign > 0 else there + span)
            for _ in range(2):  # the comparison as it is made between two places
                k = np.where((k > 0) & ((there - place[np.maximum(k - 1, 0)] < span) if sign > 0 else (place[np.maximum(k - 1, 0)] - there >= span)), k - 1, k)
                low = np.minimum(k, len(place) - 1)
                k = np.where((k < len(place)) & ~((there - place[low] < span) if sign > 0 else (place[low] - there >= span)), k + 1, k)
            entry.append(k)
            e.append(x["e"].to_numpy(int))
            dead.append(x["dead"].to_numpy(float))
            m.append(sign * x["m"].to_numpy(float))
        in_, out = (_sums(g[g["kind"] == k], wide) for k in (3, 4))
        surv = _survivals(*(np.concatenate(x) for x in (entry, e, dead, m)), wide, len(place), in_[0] - out[0], in_[1] - out[1])
        return list(zip(mine["value"].tolist(), mine["c"].tolist(), surv.tolist(), strict=True))

    smooth = kept(_in_parts(df, keys, one, "value double, c double, s double", {0: own.drop("vblock"), 1: enter, 2: leave, 3: before(enter), 4: before(leave)})).df
    # sums over greater values, then the area under straight lines from cut to cut
    up = smooth.withColumns({"above": F.col("c"), "joint": F.col("c") * F.col("s")})
    sums = running(up, keys, ["above", "joint"], True, own=False, order="value", block="part")
    total = smooth.groupBy(*keys).agg((F.sum(F.col("c") * F.col("s")) / F.sum("c")).alias("total"), F.sum("c").alias("n"))
    t = (F.col("above") - F.col("joint")) / F.col("n") / (1 - F.col("total"))
    half = F.col("c") * (1 - F.col("s")) / F.col("n") / (1 - F.col("total")) / 2
    return sums.join(total, keys).groupBy(*keys).agg((F.count(F.lit(1)) + 2).alias("points"), F.sum((t + half) * F.col("c") * F.col("s") / F.col("n") / F.col("total")).alias("auc"))


def dominance(e: np.ndarray, weight: np.ndarray, m: np.ndarray, base: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """For each row: the weights of earlier rows whose e is no larger, and the counts m of earlier rows whose e is larger.

    Small runs are compared all with all; then sorted runs are joined, twice as long each time (n log n in all).
    """
    n = len(e)
    low, high = np.zeros(n), np.zeros(n)
    for a in range(0, n, base):
        x = e[a : a + base]
        before = np.tri(len(x), k=-1, dtype=bool)
        le = x[None, :] <= x[:, None]
        low[a : a + base] = (before & le) @ weight[a : a + base]
        high[a : a + base] = (before & ~le) @ m[a : a + base]
    width = base
    while width < n:
        for a in range(0, n - width, 2 * width):
            left, right = slice(a, a + width), slice(a + width, min(n, a + 2 * width))
            order = np.argsort(e[left], kind="stable")
            sums, counts = np.concatenate([[0.0], np.cumsum(weight[left][order])]), np.concatenate([[0.0], np.cumsum(m[left][order])])
            k = np.searchsorted(e[left][order], e[right], side="right")
            low[right] += sums[k]
            high[right] += counts[-1] - counts[k]
        width *= 2
    return low, high


def greatest_logrank(df: DataFrame, keys: Sequence[str], low: float = 0.1, high: float = 0.9, part_cells: int | None = None, block_rows: int | None = None) -> DataFrame:
    """KM9: the number of cut-points between two quantiles of the marker, and the largest absolute log-rank statistic over them.

    From cut to cut the group above grows by some rows. Observed less expected events add up over rows; of the variance, w n1 (n - n1) / n2
    summed over times, the square of n1 is a sum over pairs of rows at their lesser time, which grows by sums over earlier rows
    of lesser and of greater time.
    """
    keys = list(keys)
    df = kept(df.select(*keys, "time", "status", "value")).df
    placed_, blocks = placed(df, keys, None, block_rows)
    at = placed_.groupBy(*keys, "block", "time").agg(F.sum(F.col("m") * F.col("dead")).cast("double").alias("d"), F.sum("m").cast("double").alias("n"))
    at = running(at, keys, ["n"], blocks)
    w = F.when(F.col("n") > 1, F.col("d") * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    at = at.select(*keys, "block", "time", (F.col("d") / F.col("n")).alias("hz"), (w / F.col("n")).alias("va"), (w / F.col("n") / F.col("n")).alias("vb"))
    at = running(at, keys, ["hz", "va", "vb"], blocks, later=False)
    more = ["hz", "va", "vb"]
    rows = kept(placed_.join(at, [*keys, "block", "time"]).groupBy(*keys, "value", "e", "dead", *more).agg(F.sum("m").alias("m"))).df
    ends = quantiles(df, keys, "value", [low, high]).select(*keys, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    about = kept(rows.groupBy(*keys).agg(F.sum("m").alias("n"), F.lit(0).alias("times")).join(ends, keys)).df
    parts = kept(_by_falling_value(rows, keys, about, part_cells)).df
    carry = _carried(parts, keys, more=more)

    def one(g: pd.DataFrame) -> list:
        own, before = g[g["kind"] == 0].sort_values(["value", "e", "dead"], ascending=[False, True, True]), g[g["kind"] == 1]
        lo, hi = float(g["lo"].iloc[0]), float(g["hi"].iloc[0])
        gain = lambda x: (x["m"].to_numpy(float) * (x["dead"].to_numpy(float) - x["hz"].to_numpy(float)), x["m"].to_numpy(float) * x["va"].to_numpy(float))
        # what earlier parts amount to: sums by e of weights, and counts of greater e
        past = before.groupby("e").agg({"m": "sum", "vb": "first"}).sort_index()
        pe, pm, pb = past.index.to_numpy(), past["m"].to_numpy(float), past["vb"].to_numpy(float)
        sums, counts = np.concatenate([[0.0], np.cumsum(pm * pb)]), np.concatenate([[0.0], np.cumsum(pm)])
        u0, a0 = (x.sum() for x in gain(before))
        q0 = float((pb * (pm**2 + 2 * pm * (counts[-1] - counts[1:]))).sum())
        e, m, vb = own["e"].to_numpy(int), own["m"].to_numpy(float), own["vb"].to_numpy(float)
        less, more_ = dominance(e, m * vb, m)
        k = np.searchsorted(pe, e, side="right")
        pairs = m * (2 * (less + sums[k] + vb * (more_ + counts[-1] - counts[k])) + m * vb)
        u, a = gain(own)
        value = own["value"].to_numpy(float)
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        cuts = value[first]
        before_cut = lambda x, start: start + np.concatenate([[0.0], np.cumsum(x)])[first]
        u, v = before_cut(u, u0), before_cut(a, a0) - before_cut(pairs, q0)
        tested = (cuts >= lo) & (cuts <= hi)
        with np.errstate(all="ignore"):
            stat = np.where(v > 1e-12, np.abs(u) / np.sqrt(v), 0.0)[tested]
        return [[int(tested.sum()), float(stat.max(initial=0.0))]]

    kinds = {k: x.join(about.select(*keys, "lo", "hi"), keys) for k, x in ((0, parts), (1, carry))}
    pieces = _in_parts(df, keys, one, "cuts long, best double", kinds)
    return pieces.groupBy(*keys).agg(F.sum("cuts").alias("cuts"), F.max("best").alias("max_stat"))
