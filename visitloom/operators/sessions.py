"""Visits to touches, and touches to conversion timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.functions.columns import count_where, digest, keyed, strip_separators
from visitloom.functions.ordered import Track, lay_track, scan

# Fixed value: the utm hash given to direct visits.
DIRECT_HASH = "42b4c899c39ac03cc595b36e8a618951"
# Fixed value: a visit that starts within this many seconds of the previous one's end continues it.
GAP_SECONDS = 4 * 60 * 60


def touches(sessions: DataFrame, brand_kw: str, conv_action: str | None = "6",
            home_country: str = "brazil") -> DataFrame:
    """One flat touch per nested visit. ``conv_action=None`` means revenue decides conversion."""
    s, ts = F.col("datasource"), F.col("trafficSource")
    revenue = F.col("totals.totalTransactionRevenue")
    if conv_action is None:
        converted = F.coalesce(revenue, F.lit(0)) > 0
    else:
        converted = F.exists("hits", lambda h: h["eCommerceAction"]["action_type"] == conv_action)
    is_conv = F.when(converted, 1).otherwise(0)
    landing = F.get("hits", F.lit(0))["page"]["pagePath"]
    acts = lambda a: count_where("hits", lambda h: h["eCommerceAction"]["action_type"] == a)
    kw = strip_separators(ts["keyword"])
    return sessions.select(
        "visit_id", "datasource",
        F.col("fullVisitorId").alias("fvid"),
        F.col("visitStartTime").alias("sess"),
        (F.col("visitStartTime") + F.coalesce("totals.timeOnSite", F.lit(0))).alias("sess_end"),
        keyed("customDimensions", 8).alias("cd8"),
        F.when(s == "app", keyed("customDimensions", 23)).alias("device_id"),
        F.when(F.lower("geoNetwork.country") == home_country, F.lower("geoNetwork.region"))
        .otherwise("foreign_country").alias("state"),
        digest(ts["campaign"], ts["source"], ts["medium"], ts["keyword"], ts["adContent"]).alias("utm_hash"),
        F.lower(strip_separators(ts["source"])).alias("src"),
        F.lower(strip_separators(ts["medium"])).alias("medium"),
        F.when(kw.contains(brand_kw), 1).otherwise(0).alias("is_some_kw"),
        F.when(kw == brand_kw, 1).otherwise(0).alias("is_kw"),
        is_conv.alias("is_conversion"),
        F.when(ts["isTrueDirect"], 1).otherwise(0).alias("is_true_direct"),
        F.when(s == "site", F.when(landing == "/", 1).otherwise(0)).alias("is_page_direct"),
        F.col("device.deviceCategory").alias("device"),
        acts("1").alias("n_clicks"), acts("2").alias("n_views"),
        F.when(acts("3") > 0, 1).otherwise(0).alias("is_to_cart"),
        F.when(acts("4") > 0, 1).otherwise(0).alias("is_rm_cart"),
        F.when(is_conv == 1, (F.coalesce(revenue, F.lit(0)) / F.lit(1000000)).cast("decimal(18,2)"))
        .alias("value"),
    )


def direct_override(t: DataFrame, rule: str = "truedirect") -> DataFrame:
    """Rewrite source, medium, keyword flag and hash of visits that came in directly."""
    off_brand = F.col("is_some_kw") != 1
    page = F.col("is_page_direct") == 1
    if rule == "truedirect":
        direct = page & (F.col("is_true_direct") == 1) & off_brand
    elif rule == "source":
        direct = page & ~F.col("src").isin("organic", "cpc", "(direct)") & off_brand
    elif rule == "flag":
        direct = F.col("is_true_direct") == 1
    else:
        raise ValueError(f"unknown rule {rule}")
    put = lambda c, v: F.when(direct, v).otherwise(F.col(c))
    return t.withColumns({"utm_hash": put("utm_hash", DIRECT_HASH), "src": put("src", "(direct)"),
                          "medium": put("medium", "(none)"), "is_some_kw": put("is_some_kw", 1)})


def trinomial(t: DataFrame) -> DataFrame:
    """``src_medium_flag``; a missing part is written as ``_`` so parallel lists keep their length."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    return t.withColumn("trin", F.concat_ws("_", part("src"), part("medium"), part("is_some_kw")))


def conversion_groups(t: DataFrame, key: str, order, is_conv: str = "is_conversion",
                      min_rows=None) -> DataFrame:
    """Number of conversions strictly before each visit; a converting visit closes its group."""
    laid, track = lay_track(t, [key], order, min_rows=min_rows)
    return scan(laid, track, conv_group=("prior_sum", is_conv)).drop("_block")


def collapse_sequential(t: DataFrame, key: str, order, start="sess", end="sess_end",
                        gap: int = GAP_SECONDS, is_conv="is_conversion",
                        min_rows=None) -> tuple[DataFrame, Track]:
    """Keep the head of every run of visits closer than ``gap`` to the previous raw visit.

    Adds ``conv_group`` and ``cv_marker`` (1 when the visit's group ends in a conversion, which is
    the case exactly when some visit from here on converts). All three come from one pass.
    """
    laid, track = lay_track(t, [key], order, min_rows=min_rows)
    marked = scan(laid, track,
                  conv_group=("prior_sum", is_conv),
                  _prev_end=("lag", end),
                  _converts=("next_known", F.when(F.col(is_conv) == 1, 1)))
    kept = (marked.filter(F.col("_prev_end").isNull() | (F.col(start) - F.col("_prev_end") > gap))
            .withColumn("cv_marker", F.coalesce("_converts", F.lit(0)))
            .drop("_prev_end", "_converts"))
    return kept, track


def transitions(kept: DataFrame, track: Track, state: str = "trin", cv: str = "cv_marker",
                per_group: bool = False) -> DataFrame:
    """First-order edge counts with START, END and CONVERSION.

    By default the next touch is looked up over the whole customer, so only a customer's last
    touch can reach CONVERSION; ``per_group=True`` closes every conversion group.
    """
    here = F.struct(F.col(state).alias("s"), F.col("conv_group").alias("g"))
    seen = scan(kept, track, _next=("lead", here), _prev=("lag", here))
    nxt, prev = F.col("_next"), F.col("_prev")
    exit_to = F.when(F.col(cv) == 0, "END").otherwise("CONVERSION")
    if per_group:
        ends = nxt.isNull() | (nxt["g"] != F.col("conv_group"))
        starts = prev.isNull() | (prev["g"] != F.col("conv_group"))
    else:
        ends, starts = nxt.isNull(), prev.isNull()
    edge = lambda a, b: F.struct(a.alias("from_state"), b.alias("to_state"))
    out = edge(F.col(state), F.when(ends, exit_to).otherwise(nxt["s"]))
    first = F.when(starts, F.array(edge(F.lit("START"), F.col(state)), out)).otherwise(F.array(out))
    return (seen.select(F.inline(first)).groupBy("from_state", "to_state")
            .agg(F.count(F.lit(1)).alias("cnt")))
