"""Document query — every row except one known junk value; in forecast
mode only the last ``since_days`` days; projected to the news columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_news(df: DataFrame, exclude: tuple[str, str] | None = None, since_days: int | None = None,
                as_of: Column | None = None, cols=("Date", "ID", "News", "section")) -> DataFrame:
    if exclude is not None:
        col, value = exclude
        # missing values are kept (a store's not-equal keeps absent fields)
        df = df.filter(~F.col(col).eqNullSafe(F.lit(value)))
    if since_days is not None:
        ref = F.current_date() if as_of is None else F.to_date(as_of)
        df = df.filter(F.col("Date") >= F.date_sub(ref, since_days))
    return df.select(*cols)
