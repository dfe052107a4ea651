"""Conversion paths: long form, nested form, text layouts and their parser."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.functions.columns import decay_days
from visitloom.functions.ordered import Track, lay_track, lift_off, scan, spread

# A nested row never holds more touches than this; a longer path continues in the next ``part``.
PART_TOUCHES = 100_000


def path_touches(kept: DataFrame, track: Track) -> DataFrame:
    """Long form of the paths: one row per touch with its place in the (key, conv_group) path.

    Adds ``key_pos`` (place in the customer timeline), ``path_no`` (the client's paths from 0), ``pos``,
    ``n_touches`` and ``path_end`` (start time of the path's last touch). This form has no limit on
    path length.
    """
    g, rn = F.col("conv_group"), F.col("key_pos")
    seen = scan(kept, track, key_pos=("row_number", None), _pg=("lag", "conv_group"),
                _ng=("lead", "conv_group"))
    head = F.col("_pg").isNull() | (F.col("_pg") != g)
    tail = F.col("_ng").isNull() | (F.col("_ng") != g)
    ends = F.when(tail, F.struct(rn.alias("rn"), F.col(track.order[0]).alias("at")))
    seen = scan(seen, track, _start=("last_known", F.when(head, rn)), _end=("next_known", ends),
                path_no=("running_sum", F.when(head, 1).otherwise(0)))
    return lift_off(seen.withColumns({
        "path_no": F.col("path_no") - 1,
        "pos": rn - F.col("_start") + 1,
        "n_touches": F.col("_end.rn") - F.col("_start") + 1,
        "path_end": F.col("_end.at"),
    }).drop("_pg", "_ng", "_start", "_end"))


def paths(touches: DataFrame, key: str = "gid", part_touches: int = PART_TOUCHES) -> DataFrame:
    """Nested paths, one row per (key, conv_group, part), ordered lists inside."""
    placed = touches.withColumn("part", F.floor((F.col("pos") - 1) / part_touches))
    placed = spread(placed, [key], country_region=F.min("state"))
    rows = placed.groupBy(key, "conv_group", "part", "n_touches").agg(
        F.max("cv_marker").alias("cv_marker"),
        F.coalesce(F.sum("is_conversion"), F.lit(-1)).alias("conversions"),
        F.coalesce(F.min("country_region"), F.lit("not_set")).alias("country_region"),
        F.array_sort(F.collect_list(F.struct("pos", "utm_hash", "sess", "trin"))).alias("touches"))
    return rows.select(
        key, "conv_group", "part", "n_touches", "cv_marker", "conversions", "country_region",
        F.col("touches.utm_hash").alias("utm_hash"), F.col("touches.sess").alias("sess"),
        F.col("touches.trin").alias("trinomials"))


def _joined(c: str):
    return F.array_join(F.transform("v", lambda x: x[c].cast("string")), ",")


def serialise_paths(touches: DataFrame, key: str, layout: str,
                    part_touches: int = PART_TOUCHES) -> DataFrame:
    """Text form of every client's paths: ``key, part, agg_sessions, groups``.

    ``groups`` says of each group in the text which path it is (``path_no``), at which touch of the path it
    starts (``start``, from 1), and the length and end of the whole path, so that a client cut into parts
    parses to the same values. Values summed per group belong to the piece: those of a path's pieces add up.
    Layouts: ``a`` media:value; ``b`` eleven fields; ``c`` one group per client
    utm:trinomials:times:value; ``d`` utm:times:trinomials:marker. Lists are comma separated and
    groups are joined by ``;`` (layout ``b``: ``;order,``).
    """
    fields = {
        "a": ["medium"],
        "b": ["src", "medium", "is_some_kw", "is_kw", "sess", "device", "n_clicks", "n_views",
              "is_to_cart", "is_rm_cart"],
        "c": ["utm_hash", "trin", "sess"],
        "d": ["utm_hash", "sess", "trin"],
    }[layout]
    glue = ";order," if layout == "b" else ";"
    group = F.lit(0) if layout == "c" else F.col("conv_group")
    placed = touches.withColumns({
        "part": F.floor((F.col("key_pos") - 1) / part_touches), "_group": group})
    safe = [F.coalesce(F.col(c).cast("string"), F.lit("_")).alias(c) for c in fields]
    extra = [F.max("cv_marker").alias("_value")] if layout == "d" else [F.sum("value").alias("_value")]
    groups = placed.groupBy(key, "part", "_group").agg(
        F.array_sort(F.collect_list(F.struct("key_pos", *safe))).alias("v"), *extra,
        F.min(F.struct("path_no", F.col("pos").alias("start"), "n_touches", "path_end")).alias("_whole"))
    value = F.coalesce(F.col("_value").cast("string"), F.lit("-1"))
    text = F.concat_ws(":", *[_joined(c) for c in fields], value)
    return (groups.withColumn("_text", text).groupBy(key, "part")
            .agg(F.array_sort(F.collect_list(F.struct("_group", "_text", "_whole"))).alias("g"))
            .select(key, "part", F.array_join(F.col("g._text"), glue).alias("agg_sessions"), F.col("g._whole").alias("groups")))


def parse_paths(lines: DataFrame, key: str = "gid", max_seq_len: int | None = 15,
                flag_names=("kw", "nokw")) -> DataFrame:
    """Layout ``d`` text back to arrays; paths longer than ``max_seq_len`` are left out, as the
    model input has that many positions (``crop_report`` says how many).

    With the ``groups`` of ``serialise_paths`` a path in several parts keeps its number, length and
    decay; ``start`` is the place of a row's first touch. Without them a text is taken as whole.
    """
    with_flag, without_flag = flag_names
    name = lambda t: F.regexp_replace(F.regexp_replace(t, "_1$", f"_{with_flag}"), "_0$", f"_{without_flag}")
    split = F.split(F.col("_line"), ":")
    texts = F.split("agg_sessions", ";")
    has_groups = "groups" in lines.columns
    each = F.arrays_zip(texts.alias("line"), F.col("groups")) if has_groups else F.transform(texts, lambda x: F.struct(x.alias("line")))
    out = lines.select(key, F.posexplode(each).alias("_at", "_g")).withColumn("_line", F.col("_g.line"))
    times = F.transform(F.split(split[1], ","), lambda x: x.cast("long"))
    out = out.select(
        key, (F.col("_g.groups.path_no") if has_groups else F.col("_at")).alias("path_no"),
        F.split(split[0], ",").alias("utm_hash"), times.alias("_times"),
        F.transform(F.split(F.replace(split[2], F.lit(" "), F.lit("")), ","), name).alias("trinomials"),
        split[3].cast("double").alias("is_conversion"),
        *([F.col("_g.groups.start").alias("start"), F.col("_g.groups.n_touches").alias("n_touches"), F.col("_g.groups.path_end").alias("_newest")]
          if has_groups else [F.lit(1).alias("start"), F.size(times).alias("n_touches"), F.array_max(times).alias("_newest")]))
    out = out.select(key, "path_no", "utm_hash", "trinomials", decay_days("_times", "_newest").alias("decay_days"),
                     "is_conversion", F.when(F.col("is_conversion") > 0, 1).otherwise(0).alias("label"), "start", "n_touches")
    return out if max_seq_len is None else out.filter(F.col("n_touches") <= max_seq_len)


def crop_report(parsed: DataFrame, max_seq_len: int = 15) -> DataFrame:
    """How many paths the length limit leaves out, of the unlimited parse."""
    whole = F.col("start") == 1                # a path counts at its first piece
    paths, cropped = F.count_if(whole), F.count_if(whole & (F.col("n_touches") > max_seq_len))
    return parsed.agg(paths.alias("paths"), cropped.alias("cropped"), F.try_divide(cropped * 100, paths).alias("pct_cropped"))


def path_length_cutoff(lengths: DataFrame, share: float = 0.98, length: str = "n_touches") -> DataFrame:
    """Largest length whose cumulative share of paths, shortest first, stays within ``share``."""
    counts = lengths.groupBy(length).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    laid, track = lay_track(counts, [], [length])
    cum = scan(laid, track, upto=("running_sum", "n"))
    within = (F.col("upto") / total.scalar()) <= share
    return lift_off(cum).agg(F.max(F.when(within, F.col(length))).alias("max_len"),
                             F.sum("n").alias("paths"))
