"""Relational and time-series core queries (S, K, P, J, A, W, O, U, F).

Every query reads whole driver tables.  Floating outputs whose value
depends on summation order are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import scale as SC
from ..operators import aggregate as A
from ..operators import align as J
from ..operators import lagged as W
from ..sources import tables as S
from .flagship import flagship_frame
from .ols_sql import fitted, ols_ctes
from .registry import register


def r6(c):
    return F.round(W.q(c) if isinstance(c, str) else c, 6)


def rounded(df, cols):
    return df.withColumns({c: r6(c) for c in cols})


# reusable SQL fragments (DuckDB) ---------------------------------------------
ODAILY = """od AS (SELECT CAST(o_orderdate AS DATE) AS "Date", avg(o_totalprice) AS "Price"
                 FROM orders GROUP BY 1)"""
LDAILY = """ld AS (SELECT CAST(l_shipdate AS DATE) AS "Date", sum(l_quantity) AS "Qty"
                 FROM lineitem GROUP BY 1)"""
EWIDE = """ew AS (SELECT CAST(ts AS DATE) AS "Date",
                 avg(value) FILTER (WHERE event_type = 'click') AS click,
                 avg(value) FILTER (WHERE event_type = 'view') AS "view",
                 avg(value) FILTER (WHERE event_type = 'signup') AS signup,
                 avg(value) FILTER (WHERE event_type = 'error') AS error,
                 avg(value) FILTER (WHERE event_type = 'purchase') AS purchase
               FROM events GROUP BY 1)"""


# flagship ---------------------------------------------------------------------
_FX = [f"x{i}" for i in range(5)]
_FLAGSHIP_COLS = ["click", "view", "signup", "error", "purchase"]
FLAGSHIP_SQL = f"""WITH {EWIDE},
dec AS (SELECT "Date", purchase AS y, {', '.join(
    f'CASE WHEN row_number() OVER o <= 5 THEN "{c}" ELSE "{c}" + 0.8 * lag("{c}", 1) OVER o + 0.6 * lag("{c}", 2) OVER o'
    f' + 0.4 * lag("{c}", 3) OVER o + 0.2 * lag("{c}", 4) OVER o END AS d{i}' for i, c in enumerate(_FLAGSHIP_COLS))}
  FROM ew WINDOW o AS (ORDER BY "Date")),
xy AS (SELECT "Date", y, {', '.join(f'lag(d{i}) OVER (ORDER BY "Date") AS x{i}' for i in range(5))} FROM dec),
sp AS (SELECT *, row_number() OVER (ORDER BY "Date") AS rn, count(*) OVER () AS n, lag(y) OVER (ORDER BY "Date") AS f
       FROM xy WHERE {' AND '.join(f'x{i} IS NOT NULL' for i in range(5))}),
tr AS (SELECT * FROM sp WHERE rn <= floor(n * 0.7)), {ols_ctes("tr", _FX, "y")},
b AS (SELECT 'linear' AS model, y, {fitted(_FX)} AS p FROM sp, ols WHERE rn > floor(n * 0.7)
      UNION ALL SELECT 'random_walk', y, f FROM sp WHERE rn > floor(n * 0.7))
SELECT model, count(*) AS n, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) ** 2)), 6) AS rmse,
       round(avg(abs(p - y) / abs(y)), 6) AS mape, round(1 - sum((p - y) ** 2) / (var_pop(y) * count(*)), 6) AS r2
FROM b GROUP BY model"""
register("flagship", FLAGSHIP_SQL)(flagship_frame)


# A1-A3 ------------------------------------------------------------------------
@register("daily_mean", """
SELECT CAST(ts AS DATE) AS "Date", event_type, round(avg(value), 6) AS value, count(*) AS n
FROM events GROUP BY 1, 2""")
def daily_mean(spark, sf):
    e = S.events(spark, sf)
    return e.groupBy("Date", "event_type").agg(r6(F.avg("value")).alias("value"), F.count(F.lit(1)).alias("n"))


@register("daily_sum", """
SELECT CAST(ts AS DATE) AS "Date", event_type, round(sum(value), 6) AS value
FROM events GROUP BY 1, 2""")
def daily_sum(spark, sf):
    return rounded(A.daily(S.events(spark, sf), ["value"], "sum", keys=["event_type"]), ["value"])


@register("daily_max", """
SELECT CAST(ts AS DATE) AS "Date", event_type, max(value) AS value FROM events GROUP BY 1, 2""")
def daily_max(spark, sf):
    return A.daily(S.events(spark, sf), ["value"], "max", keys=["event_type"])


# S6 / A8 / P5 -------------------------------------------------------------------
@register("tagged_points_pivot", f"""
WITH {EWIDE}
SELECT "Date", round(click, 6) AS click, round("view", 6) AS "view", round(signup, 6) AS signup,
       round(error, 6) AS error, round(purchase, 6) AS purchase FROM ew""")
def tagged_points_pivot(spark, sf):
    from ..sources.points import points_wide
    wide = points_wide(S.points(spark, sf), "events", {"type": "observed"}, S.EVENT_TYPES)
    return rounded(wide, S.EVENT_TYPES)


# K4 ---------------------------------------------------------------------------
@register("points_unpivot", f"""
WITH {EWIDE}
SELECT "Date", 'events_daily' AS measurement, field, round(value, 6) AS value
FROM (UNPIVOT ew ON click, "view", signup, error, purchase INTO NAME field VALUE value)""")
def points_unpivot(spark, sf):
    from ..sinks.writers import points_long
    long = points_long(S.events_daily_wide(spark, sf), "events_daily", S.EVENT_TYPES)
    return long.select("Date", "measurement", "field", r6("value").alias("value"))


# S7 / P2 / P3 -----------------------------------------------------------------
@register("junk_and_range_filter", """
SELECT doc_id AS "ID", CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS DATE) AS "Date", source AS section, n_chars
FROM documents
WHERE source IS DISTINCT FROM 'src0'
  AND CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")
def junk_and_range_filter(spark, sf):
    from ..sources.news import select_news
    n = select_news(S.news(spark, sf), exclude=("section", "src0"))
    n = J.between_dates(n, "2024-01-05", "2024-01-20")
    docs = S.table(spark, sf, "documents").select(F.col("doc_id").alias("ID"), "n_chars")
    return n.select("ID", "Date", "section").join(docs, on="ID")


# P4 ---------------------------------------------------------------------------
@register("recent_window", """
SELECT event_id, event_type, value, CAST(ts AS DATE) AS "Date" FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY""")
def recent_window(spark, sf):
    e = S.events(spark, sf)
    as_of = e.select(F.max("ts")).scalar()
    return J.recent(e, 10, as_of).select("event_id", "event_type", "value", "Date")


# S2 / O4, O3 -------------------------------------------------------------------
@register("head_ratio", f"""
WITH {ODAILY}, r AS (SELECT *, row_number() OVER (ORDER BY "Date") AS rn, count(*) OVER () AS n FROM od)
SELECT "Date", round("Price", 6) AS "Price" FROM r WHERE rn <= floor(n * 0.7)""")
def head_ratio(spark, sf):
    return rounded(J.head_ratio(S.orders_daily(spark, sf), 0.7), ["Price"])


@register("last_n", f"""
WITH {ODAILY} SELECT "Date", round("Price", 6) AS "Price" FROM od ORDER BY "Date" DESC LIMIT 20""")
def last_n(spark, sf):
    return rounded(J.last_n(S.orders_daily(spark, sf), 20), ["Price"])


# P6 / J1-J7 -------------------------------------------------------------------
@register("dropna_any", f"""
WITH {ODAILY}, {LDAILY}
SELECT "Date", round("Price", 6) AS "Price", "Qty" FROM od FULL JOIN ld USING ("Date")
WHERE "Price" IS NOT NULL AND "Qty" IS NOT NULL""")
def dropna_any(spark, sf):
    o = J.align_outer(S.orders_daily(spark, sf), S.lineitem_daily(spark, sf))
    return rounded(J.drop_incomplete(o), ["Price"])


@register("align_semi", f"""
WITH {ODAILY}, {LDAILY}
SELECT "Date", round("Price", 6) AS "Price" FROM od WHERE "Date" IN (SELECT "Date" FROM ld)""")
def align_semi(spark, sf):
    return rounded(J.align_semi(S.orders_daily(spark, sf), S.lineitem_daily(spark, sf)), ["Price"])


@register("align_anti", f"""
WITH {ODAILY}, {LDAILY}
SELECT "Date", "Qty" FROM ld WHERE "Date" NOT IN (SELECT "Date" FROM od)""")
def align_anti(spark, sf):
    return J.align_anti(S.lineitem_daily(spark, sf), S.orders_daily(spark, sf))


@register("align_inner", f"""
WITH {ODAILY}, {LDAILY}
SELECT "Date", round("Price", 6) AS "Price", "Qty" FROM od JOIN ld USING ("Date")""")
def align_inner(spark, sf):
    return rounded(J.align_inner(S.orders_daily(spark, sf), S.lineitem_daily(spark, sf)), ["Price"])


@register("align_outer", f"""
WITH {ODAILY}, {LDAILY}
SELECT "Date", round("Price", 6) AS "Price", "Qty" FROM od FULL JOIN ld USING ("Date")""")
def align_outer(spark, sf):
    return rounded(J.align_outer(S.orders_daily(spark, sf), S.lineitem_daily(spark, sf)), ["Price"])


@register("align_nway", f"""
WITH {ODAILY}, {LDAILY},
disc AS (SELECT CAST(l_shipdate AS DATE) AS "Date", avg(l_discount) AS "Disc" FROM lineitem GROUP BY 1),
cnt AS (SELECT CAST(o_orderdate AS DATE) AS "Date", count(*) AS "Orders" FROM orders GROUP BY 1)
SELECT "Date", round("Price", 6) AS "Price", "Qty", round("Disc", 6) AS "Disc", "Orders"
FROM od JOIN ld USING ("Date") JOIN disc USING ("Date") JOIN cnt USING ("Date")""")
def align_nway(spark, sf):
    li = S.table(spark, sf, "lineitem")
    disc = li.groupBy(F.to_date("l_shipdate").alias("Date")).agg(F.avg("l_discount").alias("Disc"))
    cnt = S.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("Date")).agg(F.count(F.lit(1)).alias("Orders"))
    res = J.columns_inner([S.orders_daily(spark, sf), S.lineitem_daily(spark, sf), disc, cnt])
    return rounded(res, ["Price", "Disc"])


@register("common_keys", f"""
WITH {ODAILY}, {LDAILY} SELECT "Date" FROM od INTERSECT SELECT "Date" FROM ld""")
def common_keys(spark, sf):
    return J.common_keys(S.orders_daily(spark, sf), S.lineitem_daily(spark, sf))


# J9 ---------------------------------------------------------------------------
@register("daily_back_to_rows", """
WITH d AS (SELECT CAST(ts AS DATE) AS "Date", event_type, avg(value) AS day_mean FROM events GROUP BY 1, 2)
SELECT e.event_id, e.event_type, round(d.day_mean, 6) AS day_mean, round(e.value - d.day_mean, 6) AS dev
FROM events e JOIN d ON CAST(e.ts AS DATE) = d."Date" AND e.event_type = d.event_type""")
def daily_back_to_rows(spark, sf):
    e = S.events(spark, sf)
    d = e.groupBy("Date", "event_type").agg(F.avg("value").alias("day_mean"))
    j = J.back_to_rows(e, d, on=["Date", "event_type"])
    return j.select("event_id", "event_type", r6("day_mean").alias("day_mean"),
                    r6(F.col("value") - F.col("day_mean")).alias("dev"))


# W1 ---------------------------------------------------------------------------
@register("lag_lead", f"""
WITH {ODAILY}
SELECT "Date", round("Price", 6) AS "Price",
  round(lag("Price", 1) OVER w, 6) AS "Price(t-1)", round(lag("Price", 7) OVER w, 6) AS "Price(t-7)",
  round(lead("Price", 1) OVER w, 6) AS "Price(t+1)"
FROM od WINDOW w AS (ORDER BY "Date")""")
def lag_lead(spark, sf):
    d = S.orders_daily(spark, sf)
    d = W.shift(W.shift(W.shift(d, ["Price"], 1), ["Price"], 7), ["Price"], -1)
    return rounded(d, ["Price", "Price(t-1)", "Price(t-7)", "Price(t+1)"])


def _sup_sql(cols, n_in, n_out, src="ew"):
    parts = []
    for i in range(n_in, 0, -1):
        for c in cols:
            parts.append(f'lag("{c}", {i}) OVER w AS "{c}(t-{i})"')
    for i in range(n_out):
        for c in cols:
            parts.append((f'"{c}"' if i == 0 else f'lead("{c}", {i}) OVER w') + f' AS "{W.lag_name(c, -i)}"')
    return f'SELECT "Date", {", ".join(parts)} FROM {src} WINDOW w AS (ORDER BY "Date")'


def _round_all_sql(names, inner, where=None):
    sel = ", ".join(f'round("{n}", 6) AS "{n}"' for n in names)
    w = f" WHERE {where}" if where else ""
    return f'SELECT "Date", {sel} FROM ({inner}) s{w}'


# W2 ---------------------------------------------------------------------------
_SUP_NAMES = W.supervised_names(S.EVENT_TYPES, 3, 2)


@register("supervised_matrix", f"""
WITH {EWIDE}, s AS ({_sup_sql(S.EVENT_TYPES, 3, 2)})
{_round_all_sql(_SUP_NAMES, 'SELECT * FROM s', ' AND '.join(f'"{n}" IS NOT NULL' for n in _SUP_NAMES))}""")
def supervised_matrix(spark, sf):
    d = W.supervised(S.events_daily_wide(spark, sf), S.EVENT_TYPES, 3, 2)
    return rounded(d, _SUP_NAMES)


@register("supervised_array", f"""
WITH {EWIDE}, s AS ({_sup_sql(S.EVENT_TYPES, 3, 2)})
SELECT "Date", round({' + '.join(f'"{n}"' for n in _SUP_NAMES)}, 6) AS fsum, {len(_SUP_NAMES)} AS width
FROM s WHERE {' AND '.join(f'"{n}" IS NOT NULL' for n in _SUP_NAMES)}""")
def supervised_array(spark, sf):
    d = W.supervised(S.events_daily_wide(spark, sf), S.EVENT_TYPES, 3, 2, as_array=True)
    return d.select("Date", r6(F.aggregate("features", F.lit(0.0), lambda a, x: a + x)).alias("fsum"),
                    F.size("features").cast("int").alias("width"))


# W3 / W4 ----------------------------------------------------------------------
_DRV = ["click", "view", "signup", "error"]
_W3_NAMES = [W.lag_name(c, i) for i in range(5, 0, -1) for c in _DRV + ["purchase"]] + ["purchase(t)"]
_W4_NAMES = W.supervised_names(_DRV + ["purchase"], 4, 1)


@register("supervised_train", f"""
WITH {EWIDE}, s AS ({_sup_sql(_DRV + ['purchase'], 5, 1)})
SELECT "Date", CAST(month("Date") AS INTEGER) AS month, CAST(day("Date") AS INTEGER) AS day,
       CAST(isodow("Date") - 1 AS INTEGER) AS day_in_week,
       {', '.join(f'round("{n}", 6) AS "{n}"' for n in _W3_NAMES)}
FROM s WHERE {' AND '.join(f'"{n}" IS NOT NULL' for n in _W3_NAMES)}""")
def supervised_train(spark, sf):
    wide = S.events_daily_wide(spark, sf)
    m = W.build_matrix(wide.select("Date", *_DRV), wide.select("Date", "purchase"), past=5)
    return rounded(m, _W3_NAMES)


@register("supervised_forecast", f"""
WITH {EWIDE}, s AS ({_sup_sql(_DRV + ['purchase'], 4, 1)})
SELECT "Date", CAST(month("Date") AS INTEGER) AS month, CAST(day("Date") AS INTEGER) AS day,
       CAST(isodow("Date") - 1 AS INTEGER) AS day_in_week,
       {', '.join(f'round("{n}", 6) AS "{n}"' for n in _W4_NAMES)}
FROM s WHERE {' AND '.join(f'"{n}" IS NOT NULL' for n in _W4_NAMES)}""")
def supervised_forecast(spark, sf):
    wide = S.events_daily_wide(spark, sf)
    m = W.forecast_matrix(wide.select("Date", *_DRV), wide.select("Date", "purchase"), past=5)
    return rounded(m, _W4_NAMES)


# W5 / W6 / W7 / W8 ------------------------------------------------------------
@register("prepare_x", f"""
WITH {ODAILY}, s AS (SELECT "Date", lag("Price", 4) OVER w AS "Price_t-1", lag("Price", 5) OVER w AS "Price_t-2",
                        lag("Price", 6) OVER w AS "Price_t-3" FROM od WINDOW w AS (ORDER BY "Date"))
SELECT "Date", round("Price_t-1", 6) AS "Price_t-1", round("Price_t-2", 6) AS "Price_t-2", round("Price_t-3", 6) AS "Price_t-3"
FROM s WHERE "Price_t-3" IS NOT NULL""")
def prepare_x(spark, sf):
    return rounded(W.prepare_x(S.orders_daily(spark, sf), "Price", 3), ["Price_t-1", "Price_t-2", "Price_t-3"])


@register("prepare_y", f"""
WITH {ODAILY}, s AS (SELECT "Date", lag("Price", 3) OVER w AS "Price_t", lag("Price", 2) OVER w AS "Price_t+1",
                        lag("Price", 1) OVER w AS "Price_t+2", "Price" AS "Price_t+3" FROM od WINDOW w AS (ORDER BY "Date"))
SELECT "Date", round("Price_t", 6) AS "Price_t", round("Price_t+1", 6) AS "Price_t+1", round("Price_t+2", 6) AS "Price_t+2",
       round("Price_t+3", 6) AS "Price_t+3" FROM s WHERE "Price_t" IS NOT NULL""")
def prepare_y(spark, sf):
    return rounded(W.prepare_y(S.orders_daily(spark, sf), "Price", 3), ["Price_t", "Price_t+1", "Price_t+2", "Price_t+3"])


_LAGS = {"click": 2, "view": 1, "purchase": 3}
_LAG_NAMES = ["click(t-2)", "click(t-1)", "view(t-1)", "purchase(t-3)", "purchase(t-2)", "purchase(t-1)", "purchase(t-0)"]


@register("lag_dict", f"""
WITH {EWIDE}, s AS (SELECT "Date", lag(click, 2) OVER w AS "click(t-2)", lag(click, 1) OVER w AS "click(t-1)",
   lag("view", 1) OVER w AS "view(t-1)", lag(purchase, 3) OVER w AS "purchase(t-3)",
   lag(purchase, 2) OVER w AS "purchase(t-2)", lag(purchase, 1) OVER w AS "purchase(t-1)", purchase AS "purchase(t-0)"
   FROM ew WINDOW w AS (ORDER BY "Date"))
{_round_all_sql(_LAG_NAMES, 'SELECT * FROM s', ' AND '.join(f'"{n}" IS NOT NULL' for n in _LAG_NAMES))}""")
def lag_dict(spark, sf):
    return rounded(W.lag_by_dict(S.events_daily_wide(spark, sf), _LAGS, "purchase"), _LAG_NAMES)


@register("horizon_shift", f"""
WITH {ODAILY}
SELECT "Date", {', '.join(f'round(lag("Price", {h}) OVER w, 6) AS "Price_h{h}"' if h else 'round("Price", 6) AS "Price_h0"' for h in range(6))}
FROM od WINDOW w AS (ORDER BY "Date")""")
def horizon_shift(spark, sf):
    d = W.shift_horizons(S.orders_daily(spark, sf), "Price", range(6)).drop("Price")
    return rounded(d, [f"Price_h{h}" for h in range(6)])


# W9 / W10 / W11 / F14 ---------------------------------------------------------
@register("diff1", f"""
WITH {ODAILY}, s AS (SELECT "Date", "Price" - lag("Price") OVER (ORDER BY "Date") AS "Price" FROM od)
SELECT "Date", round("Price", 6) AS "Price" FROM s WHERE "Price" IS NOT NULL""")
def diff1(spark, sf):
    return rounded(W.diff(S.orders_daily(spark, sf), ["Price"], 1), ["Price"])


@register("diff2", f"""
WITH {ODAILY}, d1 AS (SELECT "Date", "Price" - lag("Price") OVER (ORDER BY "Date") AS "Price" FROM od),
s AS (SELECT "Date", "Price" - lag("Price") OVER (ORDER BY "Date") AS "Price" FROM d1)
SELECT "Date", round("Price", 6) AS "Price" FROM s WHERE "Price" IS NOT NULL""")
def diff2(spark, sf):
    return rounded(W.diff(S.orders_daily(spark, sf), ["Price"], 2), ["Price"])


@register("seasonal_diff", f"""
WITH {ODAILY}, s AS (SELECT "Date", "Price" - lag("Price", 12) OVER (ORDER BY "Date") AS "Price" FROM od)
SELECT "Date", round("Price", 6) AS "Price" FROM s WHERE "Price" IS NOT NULL""")
def seasonal_diff(spark, sf):
    return rounded(W.diff(S.orders_daily(spark, sf), ["Price"], 1, lag=12), ["Price"])


@register("undo_diff", f"""
WITH {ODAILY}, s AS (SELECT "Date", "Price", lag("Price") OVER (ORDER BY "Date") AS prev FROM od)
SELECT "Date", round("Price" - prev, 6) AS d, round(prev, 6) AS prev, round("Price", 6) AS restored
FROM s WHERE prev IS NOT NULL""")
def undo_diff(spark, sf):
    d = W.previous(S.orders_daily(spark, sf), "Price", 1, name="prev")
    d = d.withColumn("d", F.col("Price") - F.col("prev")).dropna(subset=["d"])
    res = d.select("Date", "d", "prev", SC.undo_diff("d", "prev").alias("restored"))
    return rounded(res, ["d", "prev", "restored"])


# W12 --------------------------------------------------------------------------
@register("linear_decay", """
WITH d AS (SELECT event_type, CAST(ts AS DATE) AS "Date", avg(value) AS value FROM events GROUP BY 1, 2),
s AS (SELECT *, row_number() OVER w AS rn,
        value + 0.8 * lag(value, 1) OVER w + 0.6 * lag(value, 2) OVER w + 0.4 * lag(value, 3) OVER w
              + 0.2 * lag(value, 4) OVER w AS acc
      FROM d WINDOW w AS (PARTITION BY event_type ORDER BY "Date"))
SELECT event_type, "Date", round(value, 6) AS value, round(CASE WHEN rn <= 5 THEN value ELSE acc END, 6) AS "Decay_value" FROM s""")
def linear_decay(spark, sf):
    d = S.events_daily_long(spark, sf)
    return rounded(W.linear_decay(d, ["value"], keys=["event_type"]), ["value", "Decay_value"])


# W13 --------------------------------------------------------------------------
@register("exp_decay", f"""
WITH {ODAILY}, r AS (SELECT "Date", "Price", row_number() OVER (ORDER BY "Date") AS rn FROM od)
SELECT a."Date", round(sum(b."Price" * exp(-(a.rn - b.rn) / 7.0)), 3) AS "Cum_Price"
FROM r a JOIN r b ON b.rn <= a.rn GROUP BY a."Date" """)
def exp_decay(spark, sf):
    d = W.exp_decay(S.orders_daily(spark, sf), ["Price"])
    # values near 1e6: 3 decimals keep 10 significant digits
    return d.select("Date", F.round("Cum_Price", 3).alias("Cum_Price"))


# F2 / F4-F8 / F10 ---------------------------------------------------------------
@register("time_features", """
SELECT DISTINCT CAST(o_orderdate AS DATE) AS "Date", CAST(month(o_orderdate) AS INTEGER) AS month,
  CAST(day(o_orderdate) AS INTEGER) AS day, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_in_week,
  strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day_text,
  CAST(CAST(o_orderdate AS DATE) + 1 AS DATE) AS next_day
FROM orders""")
def time_features(spark, sf):
    d = S.table(spark, sf, "orders").select(C.to_day("o_orderdate").alias("Date")).distinct()
    return d.select("Date", *C.time_features("Date"), C.format_day("Date").alias("day_text"),
                    C.next_day("Date").alias("next_day"))


@register("weekend_roll", """
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS "Date" FROM orders)
SELECT "Date", CASE WHEN isodow("Date") >= 6 THEN CAST("Date" + CAST(8 - isodow("Date") AS INTEGER) AS DATE) ELSE "Date" END AS rolled,
  CASE WHEN isodow("Date") IN (5, 6) THEN NULL WHEN isodow("Date") = 7 THEN CAST("Date" - 2 AS DATE) ELSE "Date" END AS trading
FROM d""")
def weekend_roll(spark, sf):
    d = S.table(spark, sf, "orders").select(C.to_day("o_orderdate").alias("Date")).distinct()
    return d.select("Date", C.roll_weekend("Date").alias("rolled"), C.trading_date("Date").alias("trading"))


@register("eastern_to_utc", """
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS "Date" FROM orders)
SELECT "Date", strftime(CAST("Date" AS TIMESTAMP) + INTERVAL 22 HOUR, '%Y-%m-%d %H:%M:%S') AS stamped,
  strftime(CAST(timezone('UTC', timezone('US/Eastern', CAST("Date" AS TIMESTAMP) + INTERVAL 17 HOUR)) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS close_utc
FROM d""")
def eastern_to_utc(spark, sf):
    d = S.table(spark, sf, "orders").select(C.to_day("o_orderdate").alias("Date")).distinct()
    fmt = "yyyy-MM-dd HH:mm:ss"
    return d.select("Date", F.date_format(C.at_time("Date", 22), fmt).alias("stamped"),
                    F.date_format(C.eastern_to_utc(C.at_time("Date", 17)), fmt).alias("close_utc"))


@register("date_spine", """
WITH b AS (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders)
SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP) + INTERVAL 3 DAY, INTERVAL 1 DAY)) AS DATE) AS "Date" FROM b""")
def date_spine(spark, sf):
    o = S.table(spark, sf, "orders").select(C.to_day("o_orderdate").alias("d"))
    b = o.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return b.select(C.date_spine(F.col("lo"), F.date_add("hi", 3)).alias("Date"))


# F9 ---------------------------------------------------------------------------
@register("relative_time", """
WITH t AS (
  SELECT event_id, ts,
    CASE event_id % 4
      WHEN 0 THEN ' - ' || CAST(CAST(json_extract(props, '$.k') AS INTEGER) % 48 AS VARCHAR) || ' hours ago'
      WHEN 1 THEN ' - ' || CAST(CAST(json_extract(props, '$.k') AS INTEGER) AS VARCHAR) || ' minutes ago'
      WHEN 2 THEN ' - ' || strftime(ts, '%b %d, %Y')
      ELSE ' - ' || CAST(CAST(json_extract(props, '$.k') AS INTEGER) AS VARCHAR) || ' days ago' END AS s
  FROM events),
a AS (SELECT max(ts) AS as_of FROM events)
SELECT event_id, s,
  CASE WHEN regexp_matches(s, '^ - [0-9]+ hours? ago$') THEN CAST(as_of - to_seconds(CAST(regexp_extract(s, '([0-9]+)', 1) AS BIGINT) * 3600) AS DATE)
       WHEN regexp_matches(s, '^ - [0-9]+ minutes? ago$') THEN CAST(as_of - to_seconds(CAST(regexp_extract(s, '([0-9]+)', 1) AS BIGINT) * 60) AS DATE)
       WHEN regexp_matches(s, '^ - [0-9]+ seconds? ago$') THEN CAST(as_of - to_seconds(CAST(regexp_extract(s, '([0-9]+)', 1) AS BIGINT)) AS DATE)
       WHEN regexp_matches(s, '^ - [0-9]+ [a-z]+ ago$') THEN NULL
       ELSE coalesce(CAST(try_strptime(substr(s, 4), '%b %d, %Y') AS DATE), CAST(as_of AS DATE)) END AS "Date"
FROM t, a""")
def relative_time(spark, sf):
    e = S.events(spark, sf)
    k = F.get_json_object("props", "$.k").cast("int")
    s = (F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(" - "), (k % 48).cast("string"), F.lit(" hours ago")))
          .when(F.col("event_id") % 4 == 1, F.concat(F.lit(" - "), k.cast("string"), F.lit(" minutes ago")))
          .when(F.col("event_id") % 4 == 2, F.concat(F.lit(" - "), F.date_format("ts", "MMM dd, yyyy")))
          .otherwise(F.concat(F.lit(" - "), k.cast("string"), F.lit(" days ago"))))
    t = e.select("event_id", s.alias("s"))
    as_of = e.select(F.max("ts")).scalar()
    return t.select("event_id", "s", C.relative_date("s", as_of).alias("Date"))


# F11 / A11 / F12 --------------------------------------------------------------
@register("minmax_fit_train", f"""
WITH {ODAILY}, r AS (SELECT *, row_number() OVER (ORDER BY "Date") AS rn, count(*) OVER () AS n FROM od),
p AS (SELECT min("Price") AS lo, max("Price") AS hi FROM r WHERE rn <= floor(n * 0.7))
SELECT "Date", round(("Price" - lo) / CASE WHEN hi - lo = 0 THEN 1 ELSE hi - lo END * 99 + 1, 6) AS "Price"
FROM r, p""")
def minmax_fit_train(spark, sf):
    d = S.orders_daily(spark, sf)
    params = SC.minmax_fit(J.head_ratio(d, 0.7), ["Price"])
    return rounded(SC.minmax_apply(d, params, ["Price"], 1.0, 100.0), ["Price"])


@register("minmax_inverse", f"""
WITH {ODAILY}, r AS (SELECT *, row_number() OVER (ORDER BY "Date") AS rn, count(*) OVER () AS n FROM od),
p AS (SELECT min("Price") AS lo, max("Price") AS hi FROM r WHERE rn <= floor(n * 0.7))
SELECT "Date", round("Price", 6) AS "Price", round((("Price" - lo) / (hi - lo)) * 0.9 + 0.1, 6) AS scaled FROM r, p""")
def minmax_inverse(spark, sf):
    d = S.orders_daily(spark, sf)
    params = SC.minmax_fit(J.head_ratio(d, 0.7), ["Price"])
    s = SC.minmax_apply(d, params, ["Price"], 0.1, 1.0, suffix="_s")
    back = SC.minmax_invert(s.select("Date", F.col("Price_s").alias("Price"), F.col("Price_s").alias("scaled")),
                            params, ["Price"], 0.1, 1.0)
    return rounded(back, ["Price", "scaled"])


@register("column_stats", """
SELECT min(l_quantity) AS "l_quantity__min", max(l_quantity) AS "l_quantity__max", round(avg(l_quantity), 6) AS "l_quantity__mean",
       min(l_discount) AS "l_discount__min", max(l_discount) AS "l_discount__max", round(avg(l_discount), 6) AS "l_discount__mean",
       min(l_tax) AS "l_tax__min", max(l_tax) AS "l_tax__max", round(avg(l_tax), 6) AS "l_tax__mean"
FROM lineitem""")
def column_stats(spark, sf):
    s = A.column_stats(S.table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return rounded(s, [c for c in s.columns if c.endswith("__mean")])


@register("mean_impute", f"""
WITH {ODAILY}, {LDAILY}, j AS (SELECT "Date", "Price", "Qty" FROM od FULL JOIN ld USING ("Date"))
SELECT "Date", round(coalesce("Price", (SELECT avg("Price") FROM j)), 6) AS "Price",
       round(coalesce("Qty", (SELECT avg("Qty") FROM j)), 6) AS "Qty" FROM j""")
def mean_impute(spark, sf):
    j = J.align_outer(S.orders_daily(spark, sf), S.lineitem_daily(spark, sf))
    return rounded(SC.mean_impute(j, ["Price", "Qty"]), ["Price", "Qty"])


# F13 / F15 / F19 ----------------------------------------------------------------
@register("row_sum_shares", f"""
WITH {EWIDE}
SELECT "Date", round(click + "view" + signup + error + purchase, 6) AS total,
       round(click / (click + "view" + signup + error + purchase), 6) AS click_share,
       round(purchase / (click + "view" + signup + error + purchase), 6) AS purchase_share FROM ew""")
def row_sum_shares(spark, sf):
    w = SC.cast_all(S.events_daily_wide(spark, sf), S.EVENT_TYPES, "double")
    sh = SC.shares(F.array(*S.EVENT_TYPES))
    return w.select("Date", r6(SC.row_sum(S.EVENT_TYPES)).alias("total"),
                    r6(sh[0]).alias("click_share"), r6(sh[4]).alias("purchase_share"))


# K5 / K6 ----------------------------------------------------------------------
@register("publish_keep_first", f"""
WITH {EWIDE},
fc AS (SELECT "Date", purchase FROM ew ORDER BY "Date" DESC LIMIT 20),
rolled AS (SELECT CASE WHEN isodow("Date") >= 6 THEN CAST("Date" + CAST(8 - isodow("Date") AS INTEGER) AS DATE) ELSE "Date" END AS "Date",
                  "Date" AS orig, purchase FROM fc),
dedup AS (SELECT "Date", arg_max(purchase, orig) AS purchase FROM rolled GROUP BY 1),
published AS (SELECT "Date" FROM ew WHERE "Date" <= (SELECT max("Date") FROM ew) - INTERVAL 7 DAY)
SELECT strftime(CAST(d."Date" AS TIMESTAMP) + INTERVAL 22 HOUR, '%Y-%m-%d %H:%M:%S') AS "time", 'forecast' AS "type", '1' AS h,
       'CLC1' AS field, round(d.purchase, 6) AS value
FROM dedup d WHERE d."Date" NOT IN (SELECT "Date" FROM published)""")
def publish_keep_first(spark, sf):
    from ..sinks.writers import publish_frame
    w = S.events_daily_wide(spark, sf)
    fc = w.select("Date", "purchase")
    max_d = w.select(F.max("Date")).scalar()
    published = w.filter(F.col("Date") <= F.date_sub(max_d, 7)).select("Date")
    res = publish_frame(fc, published, value_col="purchase", last_n=20)
    return res.select(F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), "type", "h", "field",
                      r6("value").alias("value"))


# U1 / O2 ----------------------------------------------------------------------
@register("union_sources", """
SELECT doc_id, source, n_chars FROM documents WHERE source IS NOT NULL""")
def union_sources(spark, sf):
    """Every source's rows stacked, by name.  The sources of one table
    are one scan; the other language collections are stacked to the first."""
    d = S.table(spark, sf, "documents").select("doc_id", "source", "n_chars", "lang").filter("source IS NOT NULL")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    return J.stack(d.filter(english), d.filter(~english)).drop("lang")


# P1 / P7 / P8 / P9 ------------------------------------------------------------
@register("project_select", f"""
WITH {EWIDE}, s AS ({_sup_sql(['click', 'purchase'], 1, 1)})
SELECT "Date", round("purchase(t-1)", 6) AS purchase_lag, round("purchase(t)", 6) AS label FROM s
WHERE "click(t-1)" IS NOT NULL""")
def project_select(spark, sf):
    """P9 numeric columns → W2 → P7 drop current-day columns but the label →
    P8 keep the masked columns → P1 rename."""
    wide = J.numeric_only(S.events_daily_wide(spark, sf).withColumn("note", F.lit("x")))
    sup = W.supervised(wide.select("Date", "click", "purchase"), ["click", "purchase"], 1, 1)
    cur = J.drop_current(sup, label="purchase(t)")
    kept = J.keep_selected(cur, ["click(t-1)", "purchase(t-1)", "purchase(t)"], [False, True, True])
    out = J.project(kept, {"Date": "Date", "purchase(t-1)": "purchase_lag", "purchase(t)": "label"})
    return rounded(out, ["purchase_lag", "label"])


@register("join_by_id", """
SELECT d.doc_id, d.n_chars, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.source <> 'src0'""")
def join_by_id(spark, sf):
    """Documents beside their labels by id; P2: without one source."""
    docs = J.exclude_value(S.table(spark, sf, "documents").select("doc_id", "n_chars", "source"), "source", "src0")
    return J.join_by_id(docs.drop("source"), S.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


# J5 / J11 / U3 ------------------------------------------------------------------
@register("columns_outer", f"""
WITH {ODAILY}, {LDAILY}, cnt AS (SELECT CAST(o_orderdate AS DATE) AS "Date", count(*) AS "Orders" FROM orders GROUP BY 1)
SELECT "Date", round("Price", 6) AS "Price", "Qty", "Orders" FROM od FULL JOIN ld USING ("Date") FULL JOIN cnt USING ("Date")""")
def columns_outer(spark, sf):
    cnt = S.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("Date")).agg(F.count(F.lit(1)).alias("Orders"))
    res = J.columns_outer([S.orders_daily(spark, sf), S.lineitem_daily(spark, sf), cnt])
    return rounded(res, ["Price"])


@register("align_predictions", f"""
WITH {ODAILY}, r AS (SELECT "Date", "Price", row_number() OVER (ORDER BY "Date") AS rn FROM od),
p AS (SELECT rn - 30 AS j, "Price" AS pred FROM r WHERE rn > 30)
SELECT r.rn, r."Date", round(r."Price", 6) AS "Price", round(p.pred, 6) AS pred
FROM r FULL JOIN p ON r.rn = p.j + 30""")
def align_predictions(spark, sf):
    """Prediction j belongs to row offset + j (here: a shifted copy)."""
    from ..operators.split import number_rows
    d = number_rows(S.orders_daily(spark, sf)).drop("n")
    preds = d.filter(F.col("rn") > 30).select((F.col("rn") - 30).alias("j"), F.col("Price").alias("pred"))
    res = J.align_predictions(d, preds, 30)
    return res.select("rn", "Date", r6("Price").alias("Price"), r6("pred").alias("pred"))


@register("stack_forecast", f"""
WITH {ODAILY}, last AS (SELECT max("Date") AS d FROM od)
SELECT "Date", round("Price", 6) AS "Price", NULL::DOUBLE AS forecast FROM od
UNION ALL
SELECT CAST(d + CAST(i AS INTEGER) AS DATE), NULL::DOUBLE, round((SELECT "Price" FROM od ORDER BY "Date" DESC LIMIT 1), 6)
FROM last, range(1, 4) t(i)""")
def stack_forecast(spark, sf):
    """U3 + F21: history rows stacked with the next 1..3 calendar days'
    forecasts (random walk), missing columns null."""
    d = S.orders_daily(spark, sf)
    last = J.last_n(d, 1)
    fut = last.select(F.explode(F.sequence(F.date_add("Date", 1), F.date_add("Date", 3))).alias("Date"),
                      F.col("Price").alias("forecast"))
    return rounded(J.stack(d, fut), ["Price", "forecast"])


@register("top_days", f"""WITH {ODAILY} SELECT "Date", round("Price", 6) AS "Price" FROM od ORDER BY "Price" DESC, "Date" LIMIT 10""")
def top_days(spark, sf):
    """Top-10 days by price (a report-sized limit)."""
    return rounded(J.top_by(S.orders_daily(spark, sf), "Price", 10, ascending=False, tie=["Date"]), ["Price"])
