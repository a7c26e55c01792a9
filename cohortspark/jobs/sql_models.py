"""SQL of Cox-type models with several columns: Newton steps one after another, sums per distinct time, elimination column by column."""

from __future__ import annotations

from collections.abc import Sequence


def cells(p: int) -> list[tuple[int, ...]]:
    return [(), *((i,) for i in range(p)), *((i, j) for i in range(p) for j in range(i, p))]


def named(prefix: str, cell: tuple[int, ...]) -> str:
    return "_".join([prefix, *map(str, cell)])


def product(cell: tuple[int, ...]) -> str:
    return " * ".join([f"x{i}" for i in cell] or ["1.0"])


def eliminate(name: str, src: str, keys: str, p: int, rhs: Sequence[str]) -> str:
    """``name``: the solution of m z = r for each right side r (columns r_0 ..), by elimination without pivoting; m is symmetric (m_i_j, i <= j) in src."""
    full = [f"{named('m', (min(i, j), max(i, j)))} AS g_{i}_{j}" for i in range(p) for j in range(p)]
    out = [f"{name}_0 AS MATERIALIZED (SELECT {keys}, {', '.join(full)}, {', '.join(f'{r}_{i}' for r in rhs for i in range(p))} FROM {src})"]
    for c in range(p):
        cols = []
        for i in range(p):
            for j, col in [*((j, f"g_{i}_{j}") for j in range(p)), *((None, f"{r}_{i}") for r in rhs)]:
                r = col.rsplit("_", 1)[0]
                pivot = f"g_{c}_{j}" if j is not None else f"{r}_{c}"
                cols.append(f"{pivot} / g_{c}_{c} AS {col}" if i == c else f"{col} - g_{i}_{c} * {pivot} / g_{c}_{c} AS {col}")
        out.append(f"{name}_{c + 1} AS MATERIALIZED (SELECT {keys}, {', '.join(cols)} FROM {name}_{c})")
    return ",\n".join([*out, f"{name} AS (SELECT {keys}, {', '.join(f'{r}_{i}' for r in rhs for i in range(p))} FROM {name}_{p})"])


def newton(src: str, keys: str, xs: Sequence[str], steps: int = 9, mask: str | None = None, weighted: bool = False, tag: str = "q") -> str:
    """CTEs (named by ``tag`` and) of a model of columns ``xs`` per key (Efron ties): about (n, events, m0.., s0..), z (standardised rows),
    b{steps}, cov (c0_i.. the inverse information by columns), and h, w, j{steps} (sums at the solution by time and tied event).

    mask: a CTE with on0.. (1: the column is in the model of the key); weighted: src has g and cw (weights of rows that stay at risk).
    """
    p, by = len(xs), f"PARTITION BY {keys}"
    more = ", g, cw, code" if weighted else ""
    on = [f"on{i}" if mask else "1" for i in range(p)]
    join = f" JOIN {mask} USING ({keys})" if mask else ""
    out = [
        f"{tag}about AS MATERIALIZED (SELECT {keys}, count(*) AS n, sum(status)::BIGINT AS events, {', '.join(f'avg({x}) AS m{i}, stddev_samp({x}) AS s{i}' for i, x in enumerate(xs))} FROM {src} GROUP BY {keys})",
        f"{tag}z AS MATERIALIZED (SELECT {keys}, time, status{more}, row_number() OVER () AS who, {', '.join(f'({x} - m{i}) / s{i} * {on[i]} AS x{i}' for i, x in enumerate(xs))} FROM {src} JOIN {tag}about USING ({keys}){join})",
        f"{tag}b0 AS MATERIALIZED (SELECT DISTINCT {keys}, {', '.join(f'0.0::DOUBLE AS b{i}' for i in range(p))} FROM {tag}z)",
    ]
    eta = " + ".join(f"b{i} * x{i}" for i in range(p))
    for k in range(steps + 1):
        sums = [f"sum(status)::BIGINT AS d", *(f"sum(status * x{i}) AS e_{i}" for i in range(p)), *(f"sum(r * {product(c)}) AS {named('r', c)}, sum(status * r * {product(c)}) AS {named('t', c)}" for c in cells(p))]  # noqa: F541
        sums += [f"sum(cw * r * {product(c)}) AS {named('c', c)}" for c in cells(p)] + ["max(g) AS g"] if weighted else []
        out.append(f"{tag}h{k} AS MATERIALIZED (SELECT {keys}, time, {', '.join(sums)} FROM (SELECT {tag}z.*, exp({eta}) AS r FROM {tag}z JOIN {tag}b{k} USING ({keys})) y GROUP BY {keys}, time)")
        stay = lambda c: f" + g * coalesce(sum({named('c', c)}) OVER earlier, 0)" if weighted else ""
        risk = ", ".join(f"{named('t', c)}, sum({named('r', c)}) OVER later{stay(c)} AS {named('s', c)}" for c in cells(p))
        frame = f" , earlier AS ({by} ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)" if weighted else ""
        out.append(f"{tag}w{k} AS MATERIALIZED (SELECT {keys}, time, d, {', '.join(f'e_{i}' for i in range(p))}, {risk} FROM {tag}h{k} WINDOW later AS ({by} ORDER BY time DESC){frame})")
        at = ", ".join(f"{named('s', c)} - l / d::DOUBLE * {named('t', c)} AS {named('a', c)}" for c in cells(p))
        out.append(f"{tag}j{k} AS MATERIALIZED (SELECT {keys}, time, l / d::DOUBLE AS f, {', '.join(f'e_{i} / d AS o_{i}' for i in range(p))}, {at} FROM (SELECT *, unnest(range(d)) AS l FROM {tag}w{k} WHERE d > 0) y)")
        diagonal = lambda i, j: f" + (1 - any_value({on[i]}))" if mask and i == j else ""
        info = ", ".join(f"sum({named('a', (i, j))} / a - {named('a', (i,))} * {named('a', (j,))} / a / a){diagonal(i, j)} AS {named('m', (i, j))}" for i in range(p) for j in range(i, p))
        units = ", ".join(f"{float(i == c)}::DOUBLE AS c{c}_{i}" for c in range(p) for i in range(p))
        out.append(f"{tag}i{k} AS MATERIALIZED (SELECT {keys}, {', '.join(f'sum(o_{i} - a_{i} / a) AS u_{i}' for i in range(p))}, {info}, {units} FROM {tag}j{k}{join} GROUP BY {keys})")
        if k < steps:
            out.append(eliminate(f"{tag}v{k}", f"{tag}i{k}", keys, p, ["u"]))
            out.append(f"{tag}b{k + 1} AS MATERIALIZED (SELECT {keys}, {', '.join(f'b{i} + u_{i} AS b{i}' for i in range(p))} FROM {tag}b{k} JOIN {tag}v{k} USING ({keys}))")
    out.append(eliminate(f"{tag}cov", f"{tag}i{steps}", keys, p, [f"c{c}" for c in range(p)]))
    return ",\n".join(out)


def terms(keys: str, names: Sequence[tuple[str, str]], steps: int = 9, tag: str = "q") -> str:
    """``{tag}fit``: a row for each column (variable, level) with n, events, b and se of a model made by ``newton``."""
    p = len(names)
    lists = {"variable": [f"'{v}'" for v, _ in names], "level": [f"'{lv}'" for _, lv in names], "b": [f"b{i} / s{i}" for i in range(p)], "se": [f"sqrt(c{i}_{i}) / s{i}" for i in range(p)], "j": [str(i) for i in range(p)]}
    return f"{tag}fit AS (SELECT {keys}, n, events, {', '.join(f'unnest([{', '.join(x)}]) AS {n}' for n, x in lists.items())} FROM {tag}b{steps} JOIN {tag}cov USING ({keys}) JOIN {tag}about USING ({keys}))"


def change_test(src: str, keys: str, p: int, steps: int = 9, tag: str = "q") -> str:
    """``ph``: score tests of each column's change with Kaplan-Meier time (j from 0) and of all (j = -1) of a model made by ``newton``."""
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    v = lambda i, j: f"({named('a', (i, j))} / a - a_{i} * a_{j} / a / a)"
    low = lambda pre, i, j: named(pre, (min(i, j), max(i, j)))
    inner = ", ".join(f"{low('vgg', i, j)} - ({' + '.join(f'{low('vg', i, k)} * y{j}_{k}' for k in range(p))}) AS {named('m', (i, j))}" for i, j in pairs)
    return f"""l0 AS (SELECT {keys}, time, sum(status) AS d, count(*) AS m FROM {src} GROUP BY {keys}, time), l1 AS (SELECT *, sum(m) OVER (PARTITION BY {keys} ORDER BY time DESC) AS n FROM l0),
l2 AS (SELECT {keys}, time, d, 1 - exp(coalesce(sum(ln(greatest(1 - d / n::DOUBLE, 1e-300))) OVER (PARTITION BY {keys} ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS s FROM l1),
l3 AS MATERIALIZED (SELECT {keys}, time, s - sum(s * d) OVER (PARTITION BY {keys}) / sum(d) OVER (PARTITION BY {keys}) AS g FROM l2 WHERE d > 0),
l4 AS MATERIALIZED (SELECT {keys}, {', '.join(f'sum(g * (o_{i} - a_{i} / a)) AS u_{i}' for i in range(p))}, {', '.join(f'sum({v(i, j)}) AS {named('m', (i, j))}, sum(g * {v(i, j)}) AS {named('vg', (i, j))}, sum(g * g * {v(i, j)}) AS {named('vgg', (i, j))}' for i, j in pairs)} FROM {tag}j{steps} JOIN l3 USING ({keys}, time) GROUP BY {keys}),
l5 AS (SELECT *, {', '.join(f'{low("vg", i, c)} AS y{c}_{i}' for c in range(p) for i in range(p))} FROM l4), {eliminate('l6', 'l5', keys, p, [f'y{c}' for c in range(p)])},
l7 AS MATERIALIZED (SELECT {keys}, {', '.join(f'u_{i}' for i in range(p))}, {inner} FROM l4 JOIN l6 USING ({keys})), {eliminate('l8', 'l7', keys, p, ['u'])},
ph AS (SELECT {keys}, unnest([{', '.join(f'l7.u_{i} * l7.u_{i} / {named('m', (i, i))}' for i in range(p))}, {' + '.join(f'l7.u_{i} * l8.u_{i}' for i in range(p))}]) AS chisq, unnest([{', '.join(map(str, range(p)))}, -1]) AS j FROM l7 JOIN l8 USING ({keys}))"""


def robust(keys: str, p: int, steps: int = 9, tag: str = "q") -> str:
    """``rob``: k0_i.. the clustered variance by columns, of a weighted model made by ``newton``: every patient against every event."""
    gain = lambda i: f"CASE WHEN z.status = 1 AND z.time = y.time THEN (z.x{i} - a_{i} / a) / d ELSE 0 END"
    share = lambda i: f"wt * exp({' + '.join(f'b{q} * z.x{q}' for q in range(p))}) * (z.x{i} - a_{i} / a) / a * CASE WHEN z.status = 1 AND z.time = y.time THEN 1 - f ELSE 1 END"
    sub = f"SELECT z.*, y.time AS event_at, y.f, y.d, {', '.join(f'y.a_{i}' for i in range(p))}, y.a, y.g AS gt, CASE WHEN z.time >= y.time THEN 1 WHEN z.cw > 0 THEN y.g * z.cw ELSE 0 END AS wt FROM {tag}z z JOIN y USING ({keys})"
    return f"""y AS MATERIALIZED (SELECT j.*, h.d, h.g FROM {tag}j{steps} j JOIN {tag}h{steps} h USING ({keys}, time)),
n0 AS MATERIALIZED (SELECT {keys}, who, {', '.join(f'sum({gain(i).replace("z.", "").replace("y.time", "event_at")} - {share(i).replace("z.", "").replace("y.time", "event_at")}) AS l{i}' for i in range(p))} FROM ({sub}) s JOIN {tag}b{steps} USING ({keys}) GROUP BY {keys}, who),
n1 AS (SELECT {keys}, {', '.join(f'sum(l{i} * l{j}) AS q{i}_{j}' for i in range(p) for j in range(p))} FROM n0 GROUP BY {keys}),
rob AS (SELECT {keys}, {', '.join(f'{" + ".join(f"c{i}_{a} * q{a}_{b} * c{b}_{i}" for a in range(p) for b in range(p))} AS k{i}' for i in range(p))} FROM n1 JOIN {tag}cov USING ({keys}))"""
