"""Least squares as SQL text, for the oracles: covariances, Gaussian
elimination step by step, back substitution.  Independent of the Gram code."""

from __future__ import annotations

from collections.abc import Sequence


def ols_ctes(rel: str, xs: Sequence[str], y: str, by: Sequence[str] = (), alpha: float = 0.0, name: str = "ols") -> str:
    """CTEs ending in ``name`` (by…, c, b0, b1, …): the fit of y on xs over
    the rows of ``rel``, per group; ``alpha``: ridge penalty."""
    p, keys = len(xs), "".join(f"{b}, " for b in by)
    group = f" GROUP BY {', '.join(by)}" if by else ""
    cov = [f"covar_pop({xs[i]}, {xs[j]}) * count(*)" + (f" + {alpha!r}" if i == j and alpha else "") + f" AS m{i}_{j}"
           for i in range(p) for j in range(i, p)]
    rhs = [f"covar_pop({xs[i]}, {y}) * count(*) AS r{i}" for i in range(p)]
    means = [f"avg({x}) AS a{i}" for i, x in enumerate(xs)] + [f"avg({y}) AS ay"]
    steps = [f"{name}_0 AS (SELECT {keys}{', '.join(cov + rhs + means)} FROM {rel}{group})"]
    kept = ", ".join([f"a{i}" for i in range(p)] + ["ay"])
    for k in range(p - 1):
        m = [f"m{i}_{j}" + (f" - m{k}_{i} * m{k}_{j} / m{k}_{k} AS m{i}_{j}" if i > k else "") for i in range(p) for j in range(i, p)]
        r = [f"r{i}" + (f" - m{k}_{i} * r{k} / m{k}_{k} AS r{i}" if i > k else "") for i in range(p)]
        steps.append(f"{name}_{k + 1} AS (SELECT {keys}{', '.join(m + r)}, {kept} FROM {name}_{k})")
    last = f"{name}_{p - 1}"
    for i in range(p - 1, -1, -1):
        above = "".join(f" - m{i}_{j} * b{j}" for j in range(i + 1, p))
        steps.append(f"{name}_b{i} AS (SELECT *, (r{i}{above}) / m{i}_{i} AS b{i} FROM {last})")
        last = f"{name}_b{i}"
    c = "ay" + "".join(f" - a{i} * b{i}" for i in range(p))
    steps.append(f"{name} AS (SELECT {keys}{c} AS c, {', '.join(f'b{i}' for i in range(p))} FROM {last})")
    return ",\n".join(steps)


def fitted(xs: Sequence[str], model: str = "") -> str:
    """The prediction of a row joined to its model."""
    return f"{model}c" + "".join(f" + {model}b{i} * {x}" for i, x in enumerate(xs))
