"""Daily and hourly sales profiles."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visitloom.functions.columns import black_friday, week_of_month


def _around_black_friday(date, first_year: int, last_year: int, days):
    """Literal date ranges, one per year, that a scan can use: the day falls on 23 to 29 November."""
    ranges = [date.between(F.lit(dt.date(y, 11, 23) + dt.timedelta(days[0])), F.lit(dt.date(y, 11, 29) + dt.timedelta(days[1])))
              for y in range(first_year, last_year + 1)]
    return reduce(lambda a, b: a | b, ranges)


def hourly_event_share(sales: DataFrame, as_of_year: int, years: int = 4, days=(-1, 5)) -> DataFrame:
    """Normalised hourly sales share around Black Friday, over the preceding ``years``.

    ``sales``: ``sale_date, sale_hour, gtv_after, gtv_before`` (decimals). After the first
    aggregation at most years x days x 24 rows remain, so the windows below see a fixed size.
    """
    year = F.year("sale_date")
    d = F.datediff("sale_date", black_friday(year))
    grouped = (sales.filter(_around_black_friday(F.col("sale_date"), as_of_year - years, as_of_year - 1, days))
               .filter(year.between(as_of_year - years, as_of_year - 1) & d.between(*days))
               .groupBy(year.alias("y"), d.alias("d"), F.col("sale_hour").alias("h"))
               .agg(F.round(F.sum("gtv_after"), 2).alias("after"), F.round(F.sum("gtv_before"), 2).alias("before"),
                    F.sum((F.col("gtv_before") != 0).cast("int")).alias("p")))
    per_year = W.partitionBy("y")
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.sum(c).over(per_year).cast("double"))
    norm = grouped.select("d", "h", share("after").alias("after"), share("before").alias("before"),
                          share("p").alias("p"))
    past = norm.groupBy("d", "h").agg(
        *[F.sum(c).alias(f"x_{c}") for c in ("after", "before", "p")],
        *[F.stddev_samp(c).alias(f"s_{c}") for c in ("after", "before", "p")])
    whole = W.partitionBy()
    out = lambda c: F.try_divide(F.col(f"x_{c}"), F.sum(f"x_{c}").over(whole))
    start = black_friday(F.lit(as_of_year)).cast("timestamp")
    return past.select(
        (start + F.make_dt_interval(hours=24 * F.col("d") + F.col("h"))).alias("dtt"),
        out("after").alias("norm_gtv_after"), F.col("s_after").alias("std_gtv_after"),
        out("before").alias("norm_gtv_before"), F.col("s_before").alias("std_gtv_before"),
        out("p").alias("norm_purchases"), F.col("s_p").alias("std_purchases"))


def hourly_share_by_year(sales: DataFrame, first_year: int, days=(-1, 5), last_year: int | None = None) -> DataFrame:
    """Each year's own hourly share, for checking the pooled profile.

    The scan gets one date range per year up to ``last_year`` (by default the current one); all later dates pass it.
    """
    last_year = max(first_year, last_year or dt.date.today().year)
    near = _around_black_friday(F.col("sale_date"), first_year, last_year, days) | (F.col("sale_date") >= F.lit(dt.date(last_year + 1, 1, 1)))
    year = F.year("sale_date")
    d = F.datediff("sale_date", black_friday(year))
    g = (sales.filter(near).filter(d.between(*days) & (year >= first_year))
         .groupBy(year.alias("y"), d.alias("d"), F.col("sale_hour").alias("h"))
         .agg(F.round(F.sum("gtv_after"), 2).alias("gtv"), F.sum((F.col("gtv_after") != 0).cast("int")).alias("p")))
    total = F.sum("gtv").over(W.partitionBy("y")).cast("double")
    return g.withColumns({"n_gtv": F.try_divide(F.col("gtv").cast("double"), total),
                          "x": F.col("d") + F.col("h") / 24})


def daily_sku_sales(sales: DataFrame, products: DataFrame, since: str) -> DataFrame:
    """Units and average price per day and SKU with calendar features."""
    d = F.col("sale_date")
    per = (sales.filter((F.col("qty") != 0) & (d > F.to_date(F.lit(since))))
           .join(products, "product_id", "left").groupBy("sale_date", "sku_config")
           .agg(F.count(F.lit(1)).alias("sales"), F.avg("price").alias("avg_price"),
                F.max("category").alias("category"), F.max("business_unit").alias("business_unit"),
                F.max("division").alias("division")))
    return per.withColumns({
        "weekofyear": F.weekofyear(d), "dayofweek": F.dayofweek(d) - 1, "weekofmonth": week_of_month(d),
        "year": F.year(d)})
