"""Oracle side of the regressions: least squares with robust errors written out as SQL."""

from __future__ import annotations


def normal_p(z: str) -> str:
    """Two-sided normal p-value by Simpson's rule on [0, |z|]."""
    a = f"least(abs({z}), 12.0::DOUBLE)"
    f = f"(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * ({a} * i / 2000.0::DOUBLE) ** 2)"
    return f"(1 - 2 * {a} / 6000.0::DOUBLE * list_sum(list_transform(range(2001), lambda i: {f})) / sqrt(2 * pi()))"


def ols_sql(source: str, y: str, terms: list[str], by: list[str], weight: str = "1.0::DOUBLE", cov: str = "HC3",
            min_rows: int = 3) -> str:
    """A query with ``by``, ``term``, ``coef``, ``se``, ``n``; normal equations by Gauss-Jordan steps."""
    xs = ["1.0::DOUBLE", *terms]
    k = len(xs)
    keys = "".join(f"{b}, " for b in by)
    group = f"GROUP BY {', '.join(by)}" if by else ""
    on = " AND ".join(f"r.{b} = g.{b}" for b in by) or "TRUE"
    rows = (f"SELECT {keys}CAST({y} AS DOUBLE) AS fy, CAST({weight} AS DOUBLE) AS fw, "
            + ", ".join(f"CAST({x} AS DOUBLE) AS x{i}" for i, x in enumerate(xs)) + f" FROM {source}")
    ctes = [("fr", rows)]
    first = [f"sum(fw * x{i} * x{j}) AS a_{i}_{j}" for i in range(k) for j in range(k)]
    first += [f"{1 if i == j else 0}.0::DOUBLE AS a_{i}_{k + j}" for i in range(k) for j in range(k)]
    first += [f"sum(fw * x{i} * fy) AS c_{i}" for i in range(k)]
    ctes.append(("s0", f"SELECT {keys}count(*) AS n, {', '.join(first)} FROM fr {group} HAVING count(*) >= {min_rows}"))
    for p in range(k):
        cols = []
        for i in range(k):
            for j in range(2 * k):
                cols.append(f"a_{p}_{j} / a_{p}_{p} AS a_{i}_{j}" if i == p
                            else f"a_{i}_{j} - a_{i}_{p} * a_{p}_{j} / a_{p}_{p} AS a_{i}_{j}")
        ctes.append((f"s{p + 1}", f"SELECT {keys}n, {', '.join(cols)}, {', '.join(f'c_{i}' for i in range(k))} FROM s{p}"))
    sol = [f"{' + '.join(f'a_{i}_{k + j} * c_{j}' for j in range(k))} AS b{i}" for i in range(k)]
    sol += [f"a_{i}_{k + j} AS g_{i}_{j}" for i in range(k) for j in range(k)]
    ctes.append(("sol", f"SELECT {keys}n, {', '.join(sol)} FROM s{k}"))
    fitted = " - ".join(["fy", *[f"b{i} * x{i}" for i in range(k)]])
    lever = " + ".join(f"g_{i}_{j} * x{i} * x{j}" for i in range(k) for j in range(k))
    den = f"/ ((1 - fw * ({lever})) * (1 - fw * ({lever})))" if cov == "HC3" else ""
    gcols = "".join(f"r.{b}, " for b in by)
    ctes.append(("me", f"SELECT {gcols}x0, {''.join(f'x{i}, ' for i in range(1, k))}"
                       f"fw * fw * ({fitted}) * ({fitted}) {den} AS q FROM fr r JOIN sol g ON {on}"))
    ctes.append(("mm", f"SELECT {keys}" + ", ".join(f"sum(q * x{i} * x{j}) AS m_{i}_{j}" for i in range(k) for j in range(k))
                 + f" FROM me {group}"))
    dof = f"* g.n / (g.n - {k})" if cov == "HC1" else ""
    parts = []
    for t in range(k):
        var = " + ".join(f"g.g_{t}_{i} * r.m_{i}_{j} * g.g_{j}_{t}" for i in range(k) for j in range(k))
        parts.append(f"SELECT {''.join(f'g.{b}, ' for b in by)}'{['const', *terms][t]}' AS term, g.b{t} AS coef, "
                     f"sqrt(({var}) {dof}) AS se, g.n FROM sol g JOIN mm r ON {on}")
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({q})" for n, q in ctes) + " " + " UNION ALL ".join(parts)
