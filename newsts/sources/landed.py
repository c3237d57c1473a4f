"""Landed web data (S8-S12): JSON listings and HTML pages parsed with
built-in JSON / regex functions, one row at a time (no fetching: the
pages are data already landed in a table)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed value: schema of a listing page (data.children[].data.{score,title})
LISTING_SCHEMA = "data struct<children: array<struct<data: struct<score: int, title: string>>>>"


def listing_rows(df: DataFrame, props: str = "props", title: str = "title", stamp: Column | None = None) -> DataFrame:
    """S8 per row: parse a JSON object's score (``k``) and keep the title;
    Date stamped (default: the row's own Date)."""
    parsed = F.from_json(F.col(props), "k int")
    out = df.select("event_id", (stamp if stamp is not None else F.col("Date")).alias("Date"),
                    parsed["k"].alias("score"), F.col(title).alias("title"))
    return out


def _by_score(children: str) -> Column:
    """The children of a page by falling score, those without one last."""
    def compare(a, b):
        x, y = (F.coalesce(c["data"]["score"].cast("double"), F.lit(float("-inf"))) for c in (a, b))
        return F.when(x > y, -1).when(x < y, 1).otherwise(0)
    return F.array_sort(F.col(children), compare)


def listing_json(json_df: DataFrame, col: str = "json", stamp: Column | None = None) -> DataFrame:
    """A landed listing page → rows (score, title), highest score
    first within its page; the score dropped afterwards by the caller if not
    needed."""
    p = json_df.select(F.from_json(F.col(col), LISTING_SCHEMA).alias("p"), *( [stamp.alias("Date")] if stamp is not None else []))
    rows = p.select(*(["Date"] if stamp is not None else []), F.explode(_by_score("p.data.children")).alias("c"))
    return rows.select(*(["Date"] if stamp is not None else []), F.col("c.data.score").alias("score"),
                       F.col("c.data.title").alias("title"))


def listing_days(json_df: DataFrame, as_of: Column, day_col: str = "t", col: str = "json") -> DataFrame:
    """One landed page per back-day t; Date = as_of − t; union of all."""
    return listing_json(json_df, col, F.date_sub(F.to_date(as_of), F.col(day_col).cast("int")))


def series_json(json_df: DataFrame, name_col: str = "name", col: str = "json") -> DataFrame:
    """``{"series":[{"data":[[yyyymmdd, value], …]}]}`` per contract →
    long rows (name, Date, value); pivot + dropna give the wide table."""
    s = json_df.select(name_col, F.from_json(F.col(col), "series array<struct<data: array<array<string>>>>").alias("s"))
    pts = s.select(name_col, F.explode(F.col("s")["series"][0]["data"]).alias("p"))
    return pts.select(name_col, F.to_date(F.col("p")[0], "yyyyMMdd").alias("Date"), F.col("p")[1].cast("double").alias("value"))


def page_items(pages: DataFrame, fields: dict[str, str], groups: dict[str, int] | None = None,
               id_col: str = "page_id", html: str = "html") -> DataFrame:
    """Several aligned lists pulled from a page, zipped into rows
    (``pos`` = index in the page)."""
    groups = groups or {}
    arrays = [F.regexp_extract_all(F.col(html), F.lit(p), groups.get(n, 1)).alias(n) for n, p in fields.items()]
    z = pages.select(id_col, F.arrays_zip(*arrays).alias("z"))
    e = z.select(id_col, F.posexplode("z").alias("pos", "r"))
    return e.select(id_col, *[F.col("r")[n].alias(n) for n in fields], F.col("pos").cast("bigint").alias("pos"))


def page_values(pages: DataFrame, fields: dict[str, str], id_col: str = "page_id", html: str = "html") -> DataFrame:
    """Value of each labelled element as its own column (the pivot of
    label/value pairs, with the labels known in advance)."""
    return pages.select(id_col, *[F.regexp_extract(F.col(html), p, 1).alias(n) for n, p in fields.items()])
