"""Who is behind a visit: identity stitching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.functions.columns import extract_valid
from visitloom.functions.ordered import lay_track, scan, spread

# What a valid device id, customer hash and customer number look like.
DEVICE_RE = r"^[0-9a-fA-F\-]{36}$"
HASH_RE = r"^[0-9a-fA-F]{32}$"
NUMBER_RE = r"^[0-9]+$"


def stitch_fill(t: DataFrame, visitor: str, id_col: str, order, min_rows=None) -> DataFrame:
    """Next known id of the visitor, else the previous one, else ``v`` + visitor."""
    laid, track = lay_track(t, [visitor], order, min_rows=min_rows)
    seen = scan(laid, track, _next=("next_known", id_col), _last=("last_known", id_col))
    return (seen.withColumn("client_id", F.coalesce("_next", "_last", F.concat(F.lit("v"), F.col(visitor))))
            .drop("_next", "_last", "_block"))


def _join_key(c: str):
    """A join key whose nulls are scattered over values that match nothing."""
    scatter = F.concat(F.lit("\x00"), F.xxhash64("fvid", "sess").cast("string"))
    return F.coalesce(F.col(c), scatter)


def stitch_global(t: DataFrame, dim: DataFrame, min_rows=None) -> DataFrame:
    """One global id per visit from customer number, hash, a sibling visit, device or visitor."""
    visitor = F.concat_ws(":", "datasource", "fvid")
    device = extract_valid("device_id", DEVICE_RE)
    ids = t.withColumns({"hash_id": extract_valid("cd8", HASH_RE), "sfc": extract_valid("cd8", NUMBER_RE),
                         "device_id": device, "_device": F.coalesce(device, visitor)})
    profile = lambda: F.struct("gender", "birthday", "cust_created_year")
    # one row per key, so that a duplicated dimension row cannot multiply visits
    by_number = (dim.groupBy(F.col("src_fk_customer").cast("string").alias("_number"))
                 .agg(F.min("id_hash").alias("_hash1"), F.min(profile()).alias("_c1")))
    by_hash = (dim.filter(F.col("id_hash").isNotNull()).groupBy(F.col("id_hash").alias("_hash"))
               .agg(F.min(F.col("src_fk_customer")).cast("string").alias("_number2"),
                    F.min(profile()).alias("_c2")))
    known = (ids.join(by_number, _join_key("sfc") == F.col("_number"), "left")
             .join(by_hash, _join_key("hash_id") == F.col("_hash"), "left")
             .withColumns({
                 "hash_id": F.coalesce("hash_id", "_hash1"), "sfc": F.coalesce("sfc", "_number2"),
                 "gender": F.coalesce("_c1.gender", "_c2.gender", F.lit("not_set")),
                 "birthday": F.coalesce("_c1.birthday", "_c2.birthday", F.lit(-1)),
                 "cust_created_year": F.coalesce("_c1.cust_created_year", "_c2.cust_created_year", F.lit(-1))})
             .drop("_number", "_hash1", "_c1", "_hash", "_number2", "_c2"))
    known = spread(known, ["_device"], min_rows, sized_by=ids,
                   other_session_id=F.min(F.coalesce(F.col("sfc"), F.col("hash_id"))))
    return known.withColumn("gid", F.coalesce(F.col("sfc"), F.col("hash_id"), F.col("other_session_id"),
                                              F.col("device_id"), visitor)).drop("_device")
