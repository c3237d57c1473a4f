"""Windows over ordered rows.

Every operator takes ``keys`` (series partition columns, ``()`` = a single
series) and ``order_by`` (default ``Date``).  Lags count *rows*, not
calendar days.  The inputs are daily tables (one row per series per day),
so a window partition holds at most the number of days of one series; the
document-level tables never reach these windows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _win(keys: Sequence[str] = (), order_by: str = "Date"):
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return w.orderBy(F.col(order_by))


def q(name: str) -> Column:
    """Column by a name that may hold brackets, e.g. ``Price(t-1)``."""
    return F.col(f"`{name}`")


def lag_name(c: str, i: int) -> str:
    if i > 0:
        return f"{c}(t-{i})"
    if i == 0:
        return f"{c}(t)"
    return f"{c}(t+{-i})"


def with_row_number(df: DataFrame, keys=(), order_by="Date", name="rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(_win(keys, order_by)))


def complete(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows without a null in ``names``: one condition on one array, as
    hundreds of separate conditions are costly to plan."""
    return df.filter(~F.exists(F.array(*[q(n).isNull() for n in names]), lambda x: x))


# W1 -------------------------------------------------------------------------
def shift(df: DataFrame, cols: Sequence[str], k: int, keys=(), order_by="Date") -> DataFrame:
    """Lag (k>0) or lead (k<0) each column by |k| rows: ``c(t-k)``/``c(t+k)``."""
    w = _win(keys, order_by)
    out = {}
    for c in cols:
        out[lag_name(c, k)] = F.lag(c, k).over(w) if k >= 0 else F.lead(c, -k).over(w)
    return df.withColumns(out)


# W2 -------------------------------------------------------------------------
def supervised(df: DataFrame, cols: Sequence[str], n_in: int = 1, n_out: int = 1,
               drop: bool = True, keys=(), order_by="Date", as_array: bool = False) -> DataFrame:
    """Series → supervised matrix.

    For i = n_in..1 every column lagged i (``c(t-i)``), then ``c(t)``,
    ``c(t+1)`` … ``c(t+n_out-1)``; rows with an incomplete frame dropped.
    ``as_array`` builds one ``features`` array from a single frame
    aggregate instead of (n_in+n_out)·|cols| separate expressions, which
    keeps the plan small for 800+ columns.
    """
    keep = [*keys, order_by]
    w = _win(keys, order_by)
    if as_array:
        frame = w.rowsBetween(-n_in, n_out - 1)
        res = df.select(*keep, F.flatten(F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])).over(frame)).alias("features"),
                        F.count(F.lit(1)).over(frame).alias("_n"))
        if drop:
            res = res.filter((F.col("_n") == n_in + n_out)
                             & F.forall("features", lambda x: x.isNotNull()))
        return res.drop("_n")
    exprs, names = [], []
    for i in range(n_in, 0, -1):
        for c in cols:
            exprs.append(F.lag(c, i).over(w).alias(lag_name(c, i)))
            names.append(lag_name(c, i))
    for i in range(0, n_out):
        for c in cols:
            e = F.col(c) if i == 0 else F.lead(c, i).over(w)
            exprs.append(e.alias(lag_name(c, -i)))
            names.append(lag_name(c, -i))
    res = df.select(*keep, *exprs)
    if drop:
        res = complete(res, names)
    return res


def supervised_names(cols: Sequence[str], n_in: int, n_out: int) -> list[str]:
    names = [lag_name(c, i) for i in range(n_in, 0, -1) for c in cols]
    names += [lag_name(c, -i) for i in range(0, n_out) for c in cols]
    return names


def time_features(date: Column | str = "Date") -> list[Column]:
    """month, day of month, weekday with Monday = 0."""
    d = F.col(date) if isinstance(date, str) else date
    return [F.month(d).alias("month"), F.dayofmonth(d).alias("day"),
            F.weekday(d).alias("day_in_week")]


# W3 -------------------------------------------------------------------------
def build_matrix(features: DataFrame, prices: DataFrame, past: int = 25,
                 label: str | None = None, keys=(), order_by="Date") -> DataFrame:
    """Training matrix: inner-align features and prices, lag ``past`` rows,
    drop every current-day column except the label (the last price
    column), prepend the unshifted calendar columns, drop incomplete rows."""
    on = [*keys, order_by]
    xy = features.join(prices, on=on, how="inner").dropna("any")
    value_cols = [c for c in xy.columns if c not in on]
    label = label or [c for c in prices.columns if c not in on][-1]
    value_cols = [c for c in value_cols if c != label] + [label]
    sup = supervised(xy, value_cols, past, 1, True, keys, order_by)
    names = supervised_names(value_cols, past, 1)
    keep = [n for n in names[:-1] if "(t)" not in n] + [names[-1]]
    return sup.select(*on, *time_features(order_by), *[q(n) for n in keep])


# W4 -------------------------------------------------------------------------
def forecast_matrix(features: DataFrame, prices: DataFrame, past: int = 25,
                    keys=(), order_by="Date") -> DataFrame:
    """Forecast matrix: lag ``past-1`` and keep the current-day columns, so
    today takes the slot of t-1; no label.  Same width as W3's X."""
    on = [*keys, order_by]
    xy = features.join(prices, on=on, how="inner")
    value_cols = [c for c in xy.columns if c not in on]
    sup = supervised(xy, value_cols, past - 1, 1, True, keys, order_by)
    names = supervised_names(value_cols, past - 1, 1)
    return sup.select(*on, *time_features(order_by), *[q(n) for n in names])


# W5 -------------------------------------------------------------------------
def prepare_x(df: DataFrame, col: str, lag: int, keys=(), order_by="Date", base: int = 3) -> DataFrame:
    """``{col}_t-i`` = value ``base+i`` rows earlier, i = 1..lag; the
    original column dropped; incomplete rows dropped."""
    w = _win(keys, order_by)
    names = [f"{col}_t-{i}" for i in range(1, lag + 1)]
    res = df.withColumns({n: F.lag(col, base + i).over(w) for i, n in enumerate(names, 1)})
    return res.drop(col).dropna("any", subset=names)


# W6 -------------------------------------------------------------------------
def prepare_y(df: DataFrame, col: str = "Price", h: int = 3, keys=(), order_by="Date") -> DataFrame:
    """Row dated d holds ``{col}_t`` = value h rows earlier … ``{col}_t+h`` =
    own value."""
    w = _win(keys, order_by)
    out = {}
    for j in range(h, -1, -1):
        n = f"{col}_t+{j}" if j else f"{col}_t"
        out[n] = F.col(col) if j == h else F.lag(col, h - j).over(w)
    return df.withColumns(out).drop(col).dropna("any", subset=list(out))


# W7 -------------------------------------------------------------------------
def lag_by_dict(df: DataFrame, lags: dict[str, int], label: str, keys=(), order_by="Date") -> DataFrame:
    """Each series lagged by its own depth: ``c(t-L)``..``c(t-1)``; the
    current value kept only for the label series (``label(t-0)``)."""
    w = _win(keys, order_by)
    exprs, names = [], []
    for c, depth in lags.items():
        for i in range(depth, 0, -1):
            n = f"{c}(t-{i})"
            exprs.append(F.lag(c, i).over(w).alias(n))
            names.append(n)
        if c == label:
            exprs.append(F.col(c).alias(f"{c}(t-0)"))
            names.append(f"{c}(t-0)")
    return df.select(*keys, order_by, *exprs).dropna("any", subset=names)


# W8 -------------------------------------------------------------------------
def shift_horizons(df: DataFrame, col: str, hs: Sequence[int], keys=(), order_by="Date") -> DataFrame:
    """One lagged copy per horizon: ``{col}_h{h}`` = lag(col, h); works for
    scalar and array columns."""
    w = _win(keys, order_by)
    return df.withColumns({f"{col}_h{h}": (F.lag(col, h).over(w) if h else F.col(col)) for h in hs})


# W9 / W10 -------------------------------------------------------------------
def diff(df: DataFrame, cols: Sequence[str], order: int = 1, lag: int = 1,
         keys=(), order_by="Date", drop: bool = True) -> DataFrame:
    """Difference ``order`` times at distance ``lag``; incomplete rows
    dropped (as ``diff().dropna()``)."""
    w = _win(keys, order_by)
    res = df
    for _ in range(order):
        res = res.withColumns({c: F.col(c) - F.lag(c, lag).over(w) for c in cols})
    return res.dropna("any", subset=list(cols)) if drop else res


# W11 ------------------------------------------------------------------------
def previous(df: DataFrame, col: str, h: int = 1, keys=(), order_by="Date", name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"{col}_prev{h}", F.lag(col, h).over(_win(keys, order_by)))


# W12 ------------------------------------------------------------------------
def linear_decay(df: DataFrame, cols: Sequence[str], window: int = 5, keys=(), order_by="Date") -> DataFrame:
    """``Decay_<c>``: the first ``window`` rows keep the raw value; row i
    after them is Σ_{k<window} x[i-k]·(window-k)/window (not normalised)."""
    w = _win(keys, order_by)
    rn = F.row_number().over(w)
    out = {}
    for c in cols:
        acc = F.col(c) * 1.0
        for k in range(1, window):
            acc = acc + F.lag(c, k).over(w) * ((window - k) / window)
        out[f"Decay_{c}"] = F.when(rn <= window, F.col(c)).otherwise(acc)
    return df.withColumns(out)


# W13 ------------------------------------------------------------------------
def exp_decay(df: DataFrame, cols: Sequence[str], scale: float = 7.0, keys=(), order_by="Date",
              block: int = 700) -> DataFrame:
    """``Cum_<c>``: S_t = Σ_{i≤t} x_i·e^{-(t-i)/scale} over all earlier rows.

    Blocked prefix sum: inside a block of ``block`` rows the weights
    e^{±o/scale} stay finite; each block passes on a carry.  A carry further
    than ``ceil(745·scale/block)`` blocks back is multiplied by a weight
    that is exactly 0.0 in double precision, so the carry window below is
    exact.  The row number is one window over each series; the sums' windows
    are one block or one small table of blocks."""
    on = [*keys]
    rn_df = with_row_number(df, keys, order_by, "_rn").withColumn("_b", F.floor((F.col("_rn") - 1) / block)) \
        .withColumn("_o", ((F.col("_rn") - 1) % block).cast("double"))
    wb = Window.partitionBy(*on, "_b").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    # within-block partial sums
    part = rn_df.withColumns({f"_p_{c}": F.exp(-F.col("_o") / scale)
                              * F.sum(F.col(c) * F.exp(F.col("_o") / scale)).over(wb) for c in cols})
    # block totals measured at the block's last row: Σ x_j e^{-(block-1-o_j)/scale}
    tot = rn_df.groupBy(*on, "_b").agg(*[F.sum(F.col(c) * F.exp(-(block - 1 - F.col("_o")) / scale)).alias(f"_T_{c}")
                                         for c in cols])
    reach = int(math.ceil(745.0 * scale / block)) + 1
    wk = (Window.partitionBy(*on) if on else Window.partitionBy()).orderBy("_b")
    carry = {}
    for c in cols:
        acc = F.lit(0.0)
        for k in range(1, reach + 1):
            acc = acc + F.coalesce(F.lag(f"_T_{c}", k).over(wk), F.lit(0.0)) * math.exp(-(k - 1) * block / scale)
        carry[f"_C_{c}"] = acc
    carry_df = tot.withColumns(carry).drop(*[f"_T_{c}" for c in cols])
    res = part.join(carry_df, on=[*on, "_b"], how="left")
    res = res.withColumns({f"Cum_{c}": F.col(f"_p_{c}") + F.col(f"_C_{c}") * F.exp(-(F.col("_o") + 1) / scale)
                           for c in cols})
    return res.drop("_rn", "_b", "_o", *[f"_p_{c}" for c in cols], *[f"_C_{c}" for c in cols])


# W14 / W15 ------------------------------------------------------------------
def sliding_arrays(df: DataFrame, col: str, past: int, keys=(), order_by="Date", name: str | None = None) -> DataFrame:
    """The previous ``past`` values as an ordered array (train window)."""
    frame = _win(keys, order_by).rowsBetween(-past, -1)
    return df.withColumn(name or f"{col}_past", F.collect_list(col).over(frame))


def sequence_tensor(df: DataFrame, cols: Sequence[str], past: int, keys=(), order_by="Date",
                    name: str = "seq") -> DataFrame:
    """past × columns tensor of (vector) columns over the previous rows;
    rows with fewer than ``past`` predecessors dropped."""
    frame = _win(keys, order_by).rowsBetween(-past, -1)
    res = df.withColumn(name, F.collect_list(F.array(*cols)).over(frame))
    return res.filter(F.size(name) == past)
