"""Queries over transition counts and paths: Markov and rule-based attribution, costs, lift."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitloom.functions.ordered import spread
from visitloom.operators import attribution as A
from visitloom.operators import costs as C
from visitloom.operators import markov as M
from visitloom.operators import paths as P
from visitloom.plans import inputs as N
from visitloom.plans.journeys import LONG, MEDIUM_EDGES, MEDIUM_KEPT, medium_edges, medium_kept, path_rows
from visitloom.plans.registry import as_int, as_text, query, rounded
from visitloom.session import store, store_once

# ------------------------------------------------------------------ D13-D22
PRUNED = f"""{MEDIUM_EDGES}, outn AS (SELECT from_state AS s, sum(cnt) AS n FROM edges WHERE from_state NOT IN ('END','CONVERSION') GROUP BY 1),
minor AS (SELECT s FROM outn WHERE n < (SELECT sum(n) FROM outn) * {{pct}} / 100.0),
live AS (SELECT * FROM edges WHERE from_state NOT IN (SELECT s FROM minor) AND to_state NOT IN (SELECT s FROM minor)),
pe AS (SELECT * FROM live UNION ALL SELECT to_state, 'END', sum(cnt) FROM live WHERE to_state IN ('END','CONVERSION') GROUP BY to_state),
pp AS (SELECT from_state, to_state, cnt / sum(cnt) OVER (PARTITION BY from_state) AS p FROM pe),
ch AS (SELECT DISTINCT from_state AS channel FROM pe WHERE from_state NOT IN ('START','END','CONVERSION')),
base AS (SELECT sum(CASE WHEN to_state = 'CONVERSION' THEN cnt END) * 1.0 / sum(CASE WHEN to_state IN ('CONVERSION','END') THEN cnt END) AS rate
  FROM pe WHERE from_state NOT IN ('END','CONVERSION'))"""
P1 = PRUNED.format(pct=1)


def pruned(t, pct=1.0):
    return M.prune_channels(medium_edges(t), pct)


@query("d13_prune_channels", f"WITH {PRUNED.format(pct=20)} SELECT from_state, to_state, CAST(cnt AS BIGINT) AS cnt FROM pe")
def d13(t):
    return as_int(pruned(t, 20.0), "cnt")


@query("d14_conversion_rate", f"""WITH {P1} SELECT CAST(coalesce(sum(CASE WHEN to_state = 'CONVERSION' AND from_state NOT IN ('START','END','CONVERSION') THEN cnt END), 0) AS BIGINT) AS total_cv,
  round(coalesce(sum(CASE WHEN to_state = 'CONVERSION' AND from_state NOT IN ('START','END','CONVERSION') THEN cnt END), 0) * 1.0 / (SELECT count(*) FROM ch), 6) AS average_cv,
  round((SELECT rate FROM base), 6) AS cv_rate FROM pe""")
def d14(t):
    return rounded(M.conversion_rate(pruned(t)), "average_cv", "cv_rate")


@query("d14_channel_rates", f"""WITH {P1}, c AS (SELECT from_state AS channel, coalesce(sum(CASE WHEN to_state = 'CONVERSION' THEN cnt END), 0) AS cv,
  coalesce(sum(CASE WHEN to_state = 'END' THEN cnt END), 0) AS ex FROM pe WHERE from_state NOT IN ('END','CONVERSION') GROUP BY 1)
SELECT channel, round(cv * 1.0 / sum(cv + ex) OVER (), 6) AS cv_rate, round(ex * 1.0 / sum(cv + ex) OVER (), 6) AS exit_rate,
  round(cv * 1.0 / nullif(ex, 0), 6) AS cv_exit_rate FROM c""")
def d14_channels(t):
    return rounded(M.channel_rates(pruned(t)), "cv_rate", "exit_rate", "cv_exit_rate")


@query("d15_last_touch_matrix", f"""WITH {P1}, c AS (SELECT channel, coalesce(sum(CASE WHEN to_state = 'CONVERSION' THEN cnt END), 0) AS n FROM ch JOIN pe ON from_state = channel GROUP BY 1)
SELECT channel, round(n * 1.0 / sum(n) OVER (), 6) AS weight FROM c""")
def d15(t):
    return rounded(M.last_touch_matrix(pruned(t)), "weight")


@query("d16_first_touch_matrix", f"""WITH {P1}, s AS (SELECT to_state AS channel, cnt / sum(cnt) OVER () AS st FROM pe WHERE from_state = 'START'),
c AS (SELECT from_state AS channel, cnt / sum(cnt) OVER () AS cv FROM pe WHERE to_state = 'CONVERSION' AND from_state NOT IN ('END','CONVERSION')),
v AS (SELECT channel, coalesce(st * cv, 0) AS v FROM ch LEFT JOIN s USING (channel) LEFT JOIN c USING (channel))
SELECT channel, round(v / sum(v) OVER (), 6) AS weight FROM v""")
def d16(t):
    return rounded(M.first_touch_matrix(pruned(t)), "weight")


@query("d17_removal_drop", f"""WITH {P1}, r AS (SELECT DISTINCT from_state AS channel FROM pe WHERE from_state NOT IN ('END','CONVERSION')),
k AS (SELECT channel, to_state, p FROM r, pp WHERE from_state <> channel AND to_state <> channel AND from_state NOT IN ('END','CONVERSION'))
SELECT channel, round(coalesce(sum(CASE WHEN to_state = 'CONVERSION' THEN p END), 0) / sum(CASE WHEN to_state IN ('CONVERSION','END') THEN p END)
  / (SELECT rate FROM base) - 1, 6) AS weight FROM k GROUP BY channel""")
def d17(t):
    return M.removal_effect(pruned(t), "drop", digits=6)


def _steps_sql(n: int, mode: str, kept: str = "") -> str:
    """n further multiplications by the removal matrix, written out."""
    skip = "('END','CONVERSION')" if mode == "drop" else "('START','END','CONVERSION')"
    rewritten = ("SELECT channel, from_state, to_state, p FROM r, pp WHERE from_state <> channel AND to_state <> channel"
                 if mode == "drop" else
                 "SELECT channel, from_state, to_state, p FROM r, pp WHERE from_state <> channel UNION ALL SELECT channel, channel, 'END', 1.0 FROM r")
    sql = f"""r AS (SELECT DISTINCT from_state AS channel FROM pe WHERE from_state NOT IN {skip}), k AS ({rewritten}),
s0 AS (SELECT channel, to_state AS target, from_state AS state, p AS v FROM k WHERE to_state IN ('END','CONVERSION'))"""
    for i in range(n):
        sql += f""", s{i + 1} AS {kept} (SELECT s.channel, target, k.from_state AS state, sum(v * p) AS v FROM s{i} s JOIN k ON k.channel = s.channel AND k.to_state = s.state GROUP BY 1, 2, 3)"""
    live = "WHERE state NOT IN ('END','CONVERSION')" if mode == "drop" else ""
    return sql + f""", rt AS (SELECT channel, coalesce(sum(CASE WHEN target = 'CONVERSION' THEN v END), 0) / sum(v) AS rate FROM s{n} {live} GROUP BY channel)"""


SWEEP = 15


@query("d17_removal_sweep", f"WITH {P1}, " + _steps_sql(SWEEP - 1, "drop", "MATERIALIZED") + " " + " UNION ALL ".join(
    f"""SELECT channel, {i + 1} AS step, round(coalesce(sum(CASE WHEN target = 'CONVERSION' THEN v END), 0) / sum(v) / (SELECT rate FROM base) - 1, 6) AS weight
FROM s{i} WHERE state NOT IN ('END','CONVERSION') GROUP BY 1""" for i in range(SWEEP)))
def d17_sweep(t):
    return M.removal_sweep(pruned(t), steps=SWEEP, digits=6)


@query("d18_removal_redirect", f"WITH {P1}, " + _steps_sql(0, "redirect") + """
SELECT channel, round((1 - rate / (SELECT rate FROM base)) / sum(1 - rate / (SELECT rate FROM base)) OVER (), 6) AS weight FROM rt""")
def d18(t):
    return M.removal_effect(pruned(t), "redirect", digits=6)


def _hit_sql(removed: bool, steps: int = 4000) -> str:
    """Reference values by plain value iteration."""
    if removed:
        chain = "SELECT r.channel AS rm, from_state AS f, to_state AS g, p FROM pp, ch r WHERE from_state <> r.channel AND to_state <> r.channel AND from_state NOT IN ('END','CONVERSION') AND to_state <> 'END'"
    else:
        chain = "SELECT '' AS rm, from_state AS f, to_state AS g, p FROM pp WHERE from_state NOT IN ('END','CONVERSION') AND to_state <> 'END'"
    sql = f"e AS ({chain}), a0 AS (SELECT * FROM e UNION ALL SELECT DISTINCT rm, 'CONVERSION', 'CONVERSION', 1.0 FROM e)"
    for i in range(13):
        sql += f", a{i + 1} AS MATERIALIZED (SELECT x.rm, x.f, y.g, sum(x.p * y.p) AS p FROM a{i} x JOIN a{i} y ON x.rm = y.rm AND x.g = y.f GROUP BY 1, 2, 3)"
    return sql + ", hit AS (SELECT rm, f AS channel, p AS reach FROM a13 WHERE g = 'CONVERSION' AND f <> 'CONVERSION')"


@query("d19_removal_absorbing", f"WITH {P1}, {_hit_sql(True)}, m AS (SELECT rm AS channel, sum(reach) AS mass FROM hit GROUP BY 1) SELECT channel, round(mass / sum(mass) OVER (), 6) AS weight FROM m")
def d19(t):
    return rounded(M.removal_effect(pruned(t), "absorbing"), "weight")


_ppr = "r0 AS (SELECT 'CONVERSION' AS state, 1.0 AS r)"
for _i in range(10):
    _ppr += f""", r{_i + 1} AS (SELECT state, sum(r) AS r FROM (SELECT from_state AS state, 0.95 * p * r AS r FROM pp JOIN r{_i} ON to_state = state
  UNION ALL SELECT 'CONVERSION', 0.05) GROUP BY 1)"""


@query("d20_ppr_contribution", f"WITH {P1}, {_ppr}, v AS (SELECT channel, coalesce(r, 0) AS r FROM ch LEFT JOIN r10 ON state = channel) SELECT channel, round(r / sum(r) OVER (), 6) AS weight FROM v")
def d20(t):
    return M.ppr_contribution(pruned(t), digits=6)


_EV = f"WITH {P1}, {_hit_sql(False)}, ev AS (SELECT channel, round_even(reach / sum(reach) OVER (), 3) AS w FROM hit WHERE channel <> 'START')"


@query("d21_eventual_conversion", f"{_EV} SELECT channel, w AS weight FROM ev")
def d21(t):
    return M.eventual_conversion(pruned(t))


@query("d22_visit_pass", f"""{_EV}, vs AS (SELECT to_state AS channel, round_even(p, 3) AS visit FROM pp WHERE from_state = 'START'),
b AS (SELECT channel, coalesce(visit, 0) AS visit, coalesce(visit, 0) * w AS v FROM ev LEFT JOIN vs USING (channel))
SELECT channel, visit, round_even(v / sum(v) OVER (), 3) AS pass_through FROM b""")
def d22(t):
    return M.visit_pass(pruned(t))


# ------------------------------------------------------------------ D23-D34
def _share_sql(w: str, name: str, medium: str = "utm_hash") -> str:
    return f"""WITH {LONG}, s AS (SELECT {medium} AS medium, coalesce(sum(CASE WHEN cv_marker > 0 THEN {w} END), 0) AS v FROM long GROUP BY 1)
SELECT medium, round(v / sum(v) OVER (), 6) AS {name} FROM s"""


def _pos(first: float, last: float) -> str:
    return f"""CASE WHEN n_touches = 1 THEN 1.0 WHEN n_touches = 2 THEN 0.5 WHEN pos = 1 THEN {first} WHEN pos = n_touches THEN {last}
  ELSE CAST({1 - first - last} AS DOUBLE) / (n_touches - 2) END"""


@query("d23_first_touch", _share_sql("CASE WHEN pos = 1 THEN 1.0 ELSE 0.0 END", "first_touch"))
def d23(t):
    return rounded(A.first_touch(path_rows(t)), "first_touch")


@query("d24_last_touch", _share_sql("CASE WHEN pos = n_touches THEN 1.0 ELSE 0.0 END", "last_touch"))
def d24(t):
    return rounded(A.last_touch(path_rows(t)), "last_touch")


@query("d25_position_based", _share_sql(_pos(0.6, 0.2), "position_based"))
def d25(t):
    return rounded(A.position_based(path_rows(t)), "position_based")


@query("d26_linear_variant", _share_sql(_pos(0.4, 0.4), "linear"))
def d26(t):
    return rounded(A.linear_variant(path_rows(t)), "linear")


LAMBDA = 0.3
WEIGHTS = f"""{LONG}, tw AS (SELECT gid, conv_group, pos, n_touches, utm_hash AS medium, exp(-{LAMBDA} * (path_end - sess) / 86400.0) AS w FROM long),
nw AS (SELECT *, w / sum(w) OVER (PARTITION BY gid, conv_group) AS nw FROM tw)"""


def weights(t):
    return A.time_decay_weights(path_rows(t), LAMBDA)


@query("d27_weighted_attribution", f"WITH {WEIGHTS}, s AS (SELECT medium, sum(nw) AS v FROM nw GROUP BY 1) SELECT medium, round(v / sum(v) OVER (), 6) AS norm_att FROM s")
def d27(t):
    return rounded(A.weighted_attribution(weights(t)), "norm_att")


@query("d28_time_decay_weights", f"WITH {WEIGHTS} SELECT gid, conv_group, pos, medium, round(w, 6) AS w FROM tw")
def d28(t):
    return as_int(rounded(weights(t).drop("n_touches"), "w"), "conv_group")


@query("d29_position_profile", f"""WITH {WEIGHTS}, s AS (SELECT medium, pos, sum(nw) AS v FROM nw GROUP BY 1, 2)
SELECT medium, pos, round(v / sum(v) OVER (PARTITION BY medium), 6) AS share, round(sum(v) OVER (PARTITION BY medium), 6) AS medium_weight FROM s""")
def d29(t):
    return rounded(A.position_profile(weights(t)), "share", "medium_weight")


@query("d29_touchpoint_curve", f"""WITH {WEIGHTS}, c AS (SELECT n_touches, pos, sum(nw) AS w FROM nw GROUP BY 1, 2)
SELECT n_touches, pos, round(w, 6) AS weight, round(w / sum(w) OVER (PARTITION BY n_touches), 6) AS share, round(w / max(w) OVER (PARTITION BY n_touches), 6) AS relative FROM c""")
def d29_curve(t):
    return rounded(A.touchpoint_curve(weights(t)), "weight", "share", "relative")


UTM_MAP = "um AS (SELECT utm_hash, trin AS trinomial, count(*) AS cnt FROM long GROUP BY 1, 2)"


@query("d30_utm_map", f"WITH {LONG}, {UTM_MAP} SELECT *, min(trinomial) OVER (PARTITION BY utm_hash) AS first_trinomial FROM um")
def d30(t):
    return A.utm_map(path_rows(t))


@query("d30_rollup", f"""WITH {WEIGHTS}, {UTM_MAP}, s AS (SELECT medium, sum(nw) AS v FROM nw GROUP BY 1), sc AS (SELECT medium, v / sum(v) OVER () AS a FROM s)
SELECT trinomial, round(sum(a), 6) AS norm_att FROM um JOIN sc ON medium = utm_hash GROUP BY 1""")
def d30_rollup(t):
    rows = store(path_rows(t))
    scores = A.weighted_attribution(A.time_decay_weights(rows, LAMBDA))
    return rounded(A.rollup(scores, A.utm_map(rows), "norm_att"), "norm_att")


COVER = """cv AS (SELECT utm_hash AS medium, count(*) AS n FROM long GROUP BY 1),
cr AS (SELECT medium, n, row_number() OVER (ORDER BY n DESC, medium) AS rank, n / sum(n) OVER () AS ratio,
  sum(n) OVER (ORDER BY n DESC, medium) / sum(n) OVER () AS cum_ratio FROM cv)"""


@query("d33_vocab_coverage", f"WITH {LONG}, {COVER} SELECT medium, n, rank, round(ratio, 6) AS ratio, round(cum_ratio, 6) AS cum_ratio FROM cr")
def d33(t):
    return rounded(A.vocab_coverage(path_rows(t)), "ratio", "cum_ratio")


@query("d33_lost_paths", f"""WITH {LONG}, {COVER}, pp AS (SELECT gid, conv_group, max(CASE WHEN rank <= 20 THEN 1 ELSE 0 END) AS seen FROM long JOIN cr ON cr.medium = utm_hash GROUP BY 1, 2)
SELECT count(*) AS paths, CAST(sum(1 - seen) AS BIGINT) AS lost, round(sum(1 - seen) / count(*), 6) AS lost_share FROM pp""")
def d33_lost(t):
    rows = store(path_rows(t))
    return rounded(A.lost_paths(rows, A.vocab_coverage(rows), 20), "lost_share")


@query("d34_compare_runs", f"""WITH {LONG}, a AS (SELECT medium, v / sum(v) OVER () AS v FROM (SELECT trin AS medium, sum(CASE WHEN cv_marker > 0 AND pos = 1 THEN 1.0 ELSE 0 END) AS v FROM long GROUP BY 1)),
b AS (SELECT medium, v / sum(v) OVER () AS v FROM (SELECT trin AS medium, sum(CASE WHEN cv_marker > 0 AND pos = n_touches THEN 1.0 ELSE 0 END) AS v FROM long GROUP BY 1)),
j AS (SELECT medium, coalesce(a.v, 0) AS ft, coalesce(b.v, 0) AS lt FROM a FULL JOIN b USING (medium)), x AS (SELECT regexp_replace(medium, '_[01]$', '') AS medium, ft + lt AS total FROM j)
SELECT medium, round(avg(total), 6) AS total FROM x GROUP BY 1""")
def d34(t):
    rows = store(path_rows(t))
    runs = {"ft": A.first_touch(rows, "trin").withColumnRenamed("first_touch", "v"),
            "lt": A.last_touch(rows, "trin").withColumnRenamed("last_touch", "v")}
    return rounded(A.average_without_suffix(A.compare_runs(runs, "v"), "_[01]", "total"), "total")


def _run_sql(name: str, cond: str) -> str:
    """Position shares and scores of the touches of one source, as one run."""
    return f"""{name}w AS (SELECT trin AS medium, pos, nw FROM (SELECT gid, conv_group, pos, trin, sess, datasource, w / sum(w) OVER (PARTITION BY gid, conv_group) AS nw
  FROM (SELECT *, exp(-{LAMBDA} * (path_end - sess) / 86400.0) AS w FROM long WHERE {cond}))),
{name} AS (SELECT medium, pos, sum(nw) / sum(sum(nw)) OVER (PARTITION BY medium) AS share FROM {name}w GROUP BY 1, 2),
{name}s AS (SELECT medium, sum(nw) / sum(sum(nw)) OVER () AS score FROM {name}w GROUP BY 1)"""


_PCOLS = [f"p{i}_{n}" for n in ("short", "long") for i in (1, 2, 3)]


@query("d34_compare_positions", f"""WITH {LONG}, {_run_sql('rs', 'n_touches <= 3')}, {_run_sql('rl', 'n_touches > 3')},
u AS (SELECT medium, 'p' || pos || '_short' AS c, share AS v FROM rs UNION ALL SELECT medium, 'p' || pos || '_long', share FROM rl
  UNION ALL SELECT medium, 'weight_sum', score FROM rss UNION ALL SELECT medium, 'weight_sum', score FROM rls),
x AS (SELECT medium, {', '.join(f"coalesce(sum(CASE WHEN c = '{c}' THEN v END), 0) AS {c}" for c in [*_PCOLS, 'weight_sum'])} FROM u GROUP BY 1)
SELECT regexp_replace(medium, '_[01]$', '') AS medium, {', '.join(f"round(avg({c}), 6) AS {c}" for c in [*_PCOLS, 'weight_sum'])} FROM x GROUP BY 1""")
def d34_positions(t):
    rows, runs = store(path_rows(t)), {}
    for name, cond in (("short", "n_touches <= 3"), ("long", "n_touches > 3")):
        w = A.time_decay_weights(rows.filter(cond), LAMBDA, "trin")
        runs[name] = (A.position_profile(w), A.weighted_attribution(w))
    out = A.compare_positions(runs, "norm_att")
    return rounded(A.average_without_suffix(out, "_[01]", *_PCOLS, "weight_sum"), *_PCOLS, "weight_sum")


def _effect_sql(group: str = "") -> str:
    """Removal effects ``ef`` on mean conversion rates, by medium (and source of the path), and first trinomials ``ft``."""
    g = f", {group}" if group else ""
    return f"""{LONG}, {UTM_MAP}, ft AS (SELECT utm_hash, min(trinomial) AS trinomial FROM um GROUP BY 1),
tok AS (SELECT utm_hash, count(*) AS occ, sum(CASE WHEN cv_marker > 0 THEN 1 ELSE 0 END) / count(*) AS rate FROM long GROUP BY 1),
al AS (SELECT sum(CASE WHEN cv_marker > 0 THEN 1 ELSE 0 END) / count(*) AS base FROM long),
dl AS (SELECT gid, conv_group, utm_hash, cv_marker, min(datasource) OVER (PARTITION BY gid, conv_group) AS path_source FROM long),
pm AS (SELECT gid, conv_group, path_source, utm_hash, max(cv_marker) AS cv, count(*) AS k FROM dl GROUP BY 1, 2, 3, 4),
ps AS (SELECT *, sum(k) OVER (PARTITION BY gid, conv_group) AS n, sum(k * rate) OVER (PARTITION BY gid, conv_group) AS s FROM pm JOIN tok USING (utm_hash)),
sc AS (SELECT *, s / n AS orig, CASE WHEN n > k THEN (s - k * rate) / (n - k) ELSE base END AS masked FROM ps, al WHERE occ > 5),
em AS (SELECT utm_hash{g}, count(*) AS n_occ, quantile_cont(orig, 0.5) FILTER (WHERE cv > 0) AS mo, quantile_cont(masked, 0.5) FILTER (WHERE cv > 0) AS mm FROM sc GROUP BY ALL),
ef AS (SELECT utm_hash{g}, n_occ, (mm - mo) / nullif(mo, 0) AS rm_eff, n_occ * (mm - mo) / nullif(mo, 0) AS scaled_rm_eff FROM em),
ro AS (SELECT trinomial{g}, CAST(sum(n_occ) AS BIGINT) AS n_occ_sum, count(*) AS n_occ_count, sum(rm_eff) AS rm_eff, sum(scaled_rm_eff) AS scaled_rm_eff
  FROM ef JOIN ft USING (utm_hash) WHERE rm_eff IS NOT NULL AND n_occ > 5 GROUP BY ALL)"""


@query("d31_rate_removal_effect", f"WITH {_effect_sql()} SELECT utm_hash AS medium, n_occ, round(rm_eff, 6) AS rm_eff, round(scaled_rm_eff, 4) AS scaled_rm_eff FROM ef")
def d31_rate(t):
    out = A.rate_removal_effect(store(path_rows(t)), min_occ=5)
    return rounded(rounded(out, "rm_eff"), "scaled_rm_eff", digits=4)


@query("d31_removal_rollup", f"""WITH {_effect_sql()} SELECT trinomial, n_occ_sum, n_occ_count, round(rm_eff, 6) AS rm_eff, round(scaled_rm_eff, 4) AS scaled_rm_eff,
  round(rm_eff / n_occ_count, 6) AS m_rm_eff FROM ro""")
def d31_rollup(t):
    rows = store(path_rows(t))
    out = A.removal_rollup(A.rate_removal_effect(rows, min_occ=5), A.utm_map(rows), min_occ=5)
    return rounded(rounded(out, "rm_eff", "m_rm_eff"), "scaled_rm_eff", digits=4)


@query("d38_match_on_value", """SELECT a.o_custkey AS utm_hash, a.o_orderkey AS left_key, b.o_orderkey AS right_key FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey
  AND CAST(a.o_totalprice AS DECIMAL(18,2)) = CAST(b.o_totalprice AS DECIMAL(18,2))""")
def d38_match(t):
    side = lambda key, value: t.orders.select(F.col("o_custkey").alias("utm_hash"), F.col("o_orderkey").alias(key), F.col("o_totalprice").alias(value))
    return C.match_on_value(side("left_key", "cost_a"), side("right_key", "cost_b"), "cost_a", "cost_b").select(
        "utm_hash", "left_key", "right_key")


@query("d32_group_difference", f"""WITH {_effect_sql('path_source')}, j AS (SELECT a.trinomial, a.rm_eff AS ra, b.rm_eff * a.n_occ_sum / b.n_occ_sum AS rb, a.scaled_rm_eff AS sa, b.scaled_rm_eff * a.n_occ_sum / b.n_occ_sum AS sb
  FROM ro a JOIN ro b ON a.trinomial = b.trinomial AND a.path_source = 'app' AND b.path_source = 'site')
SELECT trinomial, round((ra - rb) / nullif(ra + rb, 0), 4) AS dif_rm_eff, round((sa - sb) / nullif(sa + sb, 0), 4) AS dif_scaled_rm_eff FROM j""")
def d32_difference(t):
    """Paths that touched the app against those of the site alone."""
    rows = store(path_rows(t))
    split = spread(rows, A.PATH, path_source=F.min("datasource"))
    effect = A.removal_rollup(A.rate_removal_effect(split, 5, ["path_source"]), A.utm_map(rows), 5, ["path_source"])
    out = A.group_difference(effect, "path_source", "app", "site", ["rm_eff", "scaled_rm_eff"], n="n_occ_sum")
    return rounded(out, "dif_rm_eff", "dif_scaled_rm_eff", digits=4)


@query("d62_class_token_share", f"""WITH {MEDIUM_KEPT}, s AS (SELECT medium, sum(CASE WHEN cv_marker = 1 THEN 1 ELSE 0 END) AS y, sum(CASE WHEN cv_marker = 0 THEN 1 ELSE 0 END) AS n FROM kept GROUP BY 1)
SELECT medium, round(y / nullif(sum(y) OVER (), 0), 6) AS share_converted, round(n / nullif(sum(n) OVER (), 0), 6) AS share_other FROM s""")
def d62(t):
    return rounded(A.class_token_share(medium_kept(t)[0]), "share_converted", "share_other")


# ------------------------------------------------------------------ D35-D38
FX = """fx AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS fx_date, c.id AS fx_currency, k.id AS fx_company,
  1 + (c.id % 7) / 10.0 + k.id / 100.0 AS rate FROM orders, (SELECT unnest([173, 265, 357, 449]) AS id) c, (SELECT unnest([1, 2, 3]) AS id) k
  WHERE o_orderkey % 3 = 0)"""


def fx_rates(t):
    days = t.orders.filter(F.col("o_orderkey") % 3 == 0).select(F.to_date("o_orderdate").alias("fx_date")).distinct()
    ids = lambda *v: F.explode(F.array(*[F.lit(x) for x in v]))
    return (days.select("fx_date", ids(173, 265, 357, 449).alias("fx_currency"))
            .select("*", ids(1, 2, 3).alias("fx_company"))
            .withColumn("rate", 1 + (F.col("fx_currency") % 7) / 10.0 + F.col("fx_company") / 100.0))


def _case(c: str, m: dict) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {k} THEN {v}" for k, v in m.items()) + " ELSE 0 END"


ALLOC = f"""cost AS (SELECT * REPLACE (CASE WHEN category_name LIKE 'Canais%' THEN 'PERFORMANCE' WHEN category_name LIKE 'Strategic Marketing%' THEN 'STRATEGIC MARKETING'
    WHEN category_name LIKE 'Creative Marketing%' THEN 'CREATIVE MARKETING' WHEN category_name LIKE 'Trade Marketing%' THEN 'TRADE MARKETING'
    WHEN category_name = 'B2B Services' THEN 'B2B' ELSE category_name END AS category_name),
  {_case('store_id', C.COMPANY_IDS).replace('ELSE 0', 'ELSE 1')} AS id_company, CASE WHEN country_id = 9 THEN 0 ELSE coalesce(country_id, 0) END AS id_country,
  CASE WHEN gl_account_id = 6 THEN 1 ELSE 0 END AS is_tool, {_case('store_id', C.STORE_IDS)} AS id_store, {_case('device_id', C.DEVICE_IDS)} AS id_device_platform,
  {_case('currency_id', C.CURRENCY_IDS)} AS id_currency FROM ({N.COSTS})), {FX},
alloc AS (SELECT id_cost, CAST(unnest(CASE WHEN cost_allocation = 1 THEN [CAST(cost_date AS TIMESTAMP)] ELSE generate_series(CAST(date_trunc('month', cost_date) AS TIMESTAMP), CAST(last_day(cost_date) AS TIMESTAMP), INTERVAL 1 DAY) END) AS DATE) AS id_date,
  id_country, id_company, id_store, cost.id_currency, legal_entity_name, category_name, is_tool, supplier_name, channel_name,
  md5(concat(coalesce(supplier_name,'_'), coalesce(account_name,'_'), coalesce(short_description,'_'), coalesce(channel_name,'_'), coalesce(CAST(id_device_platform AS VARCHAR),'_'))) AS utm_hash,
  CASE WHEN cost_allocation = 1 THEN 'DAILY' ELSE 'MONTHLY' END AS cost_allocation,
  CAST(value AS DOUBLE) / CASE WHEN cost_allocation = 1 THEN 1 ELSE day(last_day(cost_date)) END AS original_value,
  CAST(value AS DOUBLE) / CASE WHEN cost_allocation = 1 THEN 1 ELSE day(last_day(cost_date)) END * coalesce(rate, 1.0) AS exchanged_value
  FROM cost LEFT JOIN fx ON fx_currency = id_currency AND fx_date = cost_date AND fx_company = id_company)"""


def exact(c):
    """Total of amounts fixed to six decimals, so that it does not depend on the order of addition."""
    return F.sum(F.col(c).cast("decimal(18,6)")).cast("double").alias(c)


def allocated(t):
    """Rows per cost and day; the ledger is written once for all queries of an application over one folder."""
    ledger = store_once(t.spark, f"costs {t.folder}", lambda: N.costs_in(t), codec="zstd")
    return C.allocate_costs(ledger, store(fx_rates(t)))


@query("d35_allocate_costs", f"""WITH {ALLOC} SELECT CAST(id_date AS VARCHAR) AS id_date, id_company, id_store, id_currency, cost_allocation, count(*) AS n,
  CAST(sum(CAST(original_value AS DECIMAL(18,6))) AS DOUBLE) AS original_value, CAST(sum(CAST(exchanged_value AS DECIMAL(18,6))) AS DOUBLE) AS exchanged_value FROM alloc GROUP BY 1, 2, 3, 4, 5""")
def d35(t):
    out = allocated(t).groupBy("id_date", "id_company", "id_store", "id_currency", "cost_allocation").agg(
        F.count(F.lit(1)).alias("n"),
        exact("original_value"), exact("exchanged_value"))
    return as_text(out, "id_date")


@query("d35_allocated_by_cost", f"""WITH {ALLOC} SELECT id_cost, CAST(min(id_date) AS VARCHAR) AS first_day, CAST(max(id_date) AS VARCHAR) AS last_day, count(*) AS days,
  min(utm_hash) AS utm_hash, min(id_country) AS id_country, min(id_company) AS id_company, min(legal_entity_name) AS legal_entity_name, min(category_name) AS category_name, min(is_tool) AS is_tool, CAST(sum(CAST(original_value AS DECIMAL(18,6))) AS DOUBLE) AS original_value, CAST(sum(CAST(exchanged_value AS DECIMAL(18,6))) AS DOUBLE) AS exchanged_value FROM alloc GROUP BY 1""")
def d35_cost(t):
    out = allocated(t).groupBy("id_cost").agg(
        F.min("id_date").alias("first_day"), F.max("id_date").alias("last_day"), F.count(F.lit(1)).alias("days"),
        F.min("utm_hash").alias("utm_hash"), *[F.min(c).alias(c) for c in ("id_country", "id_company", "legal_entity_name", "category_name", "is_tool")], exact("original_value"), exact("exchanged_value"))
    return as_text(out, "first_day", "last_day")


AUD = f"aud AS ({N.AUDIENCE})"
MEASURES = ["gtv", "items", "orders"]


def _lift_sql(source: str, by: str = "") -> str:
    f = "(count(*) FILTER (is_control = 0)) / nullif(count(*) FILTER (is_control = 1), 0)"
    cols = []
    for m in MEASURES:
        a, b = f"CAST(sum({m}) FILTER (is_control = 0) AS DOUBLE)", f"CAST(sum({m}) FILTER (is_control = 1) AS DOUBLE) * {f}"
        cols.append(f"round(({a} - {b}) / nullif({a} + {b}, 0), 6) AS dif_{m}")
    return (f"SELECT {by + ', ' if by else ''}count(*) FILTER (is_control = 0) AS n_treated, count(*) FILTER (is_control = 1) AS n_control, "
            f"{', '.join(cols)} FROM {source} {'GROUP BY ' + by if by else ''}")


@query("d36_lift", f"WITH {AUD} {_lift_sql('aud')}")
def d36(t):
    return rounded(C.lift(N.audience_in(t), MEASURES), *[f"dif_{m}" for m in MEASURES])


@query("d36_lift_by_os", f"WITH {AUD} {_lift_sql('aud', 'os')}")
def d36_os(t):
    return rounded(C.lift(N.audience_in(t), MEASURES, by=["os"]), *[f"dif_{m}" for m in MEASURES])


@query("d36_eligible", f"""WITH {AUD} SELECT external_user_id, os, is_control FROM aud WHERE first_interaction > DATE '1995-03-01' AND first_interaction <= DATE '1996-01-01'
  AND (first_uninstall IS NULL OR first_uninstall >= DATE '1996-01-01')""")
def d36_eligible(t):
    return C.eligible(N.audience_in(t), "1995-03-01", "1996-01-01").select("external_user_id", "os", "is_control")


@query("d36_in_both_arms", "SELECT o_custkey, count(DISTINCT o_orderkey % 2) AS arms FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 2) > 1")
def d36_both(t):
    return C.in_both_arms(t.orders.withColumn("arm", F.col("o_orderkey") % 2), "o_custkey", "arm")


@query("d37_study_lift", """WITH s AS (SELECT o_custkey % 7 AS study_id, o_custkey % 2 AS cell_id, CASE WHEN o_orderkey % 4 = 0 THEN '#NULL!' ELSE CAST(o_orderkey AS VARCHAR) END AS buyers,
  CASE WHEN o_orderkey % 2 = 0 THEN '#NULL!' ELSE '0' END AS empty FROM orders),
g AS (SELECT study_id, cell_id, sum(CAST(replace(buyers, '#NULL!', '0') AS DOUBLE)) AS buyers, sum(CAST(replace(empty, '#NULL!', '0') AS DOUBLE)) AS empty FROM s GROUP BY 1, 2),
l AS (SELECT study_id, cell_id, 'buyers' AS measure, buyers AS total FROM g UNION ALL SELECT study_id, cell_id, 'empty', empty FROM g)
SELECT * FROM l WHERE measure IN (SELECT measure FROM l GROUP BY 1 HAVING sum(abs(total)) <> 0)""")
def d37(t):
    k, o = F.col("o_orderkey"), t.orders
    rows = o.select((F.col("o_custkey") % 7).alias("study_id"), (F.col("o_custkey") % 2).alias("cell_id"),
                    F.when(k % 4 == 0, "#NULL!").otherwise(k.cast("string")).alias("buyers"),
                    F.when(k % 2 == 0, "#NULL!").otherwise("0").alias("empty"))
    return C.study_lift(rows, ["buyers", "empty"])


UTMS = """utms AS (SELECT utm_hash, min(supplier_name) AS source, min(channel_name) AS channel FROM alloc WHERE id_store > 0 GROUP BY 1)"""


@query("d38_cost_by_utm", f"""WITH {ALLOC}, {UTMS}, c AS (SELECT utm_hash, count(*) AS cnt, sum(CAST(exchanged_value AS DECIMAL(18,6))) AS a, sum(CAST(original_value AS DECIMAL(18,6))) AS o FROM alloc GROUP BY 1)
SELECT utm_hash, cnt, CAST(a AS DOUBLE) AS avg_cost_times_cnt, CAST(o AS DOUBLE) AS avg_original_cost_times_cnt, source, channel FROM c JOIN utms USING (utm_hash)""")
def d38(t):
    rows = allocated(t)
    # a minimum of texts sorts its rows, and a cost has one per day; unless stored, the optimizer drops the distinct
    names = store(rows.filter(F.col("id_store") > 0).select("utm_hash", "supplier_name", "channel_name").distinct())
    utms = names.groupBy("utm_hash").agg(
        F.min("supplier_name").alias("source"), F.min("channel_name").alias("channel"))
    fixed = rows.withColumns({c: F.col(c).cast("decimal(18,6)") for c in ("exchanged_value", "original_value")})
    out = C.cost_by_utm(fixed, utms)
    # an average can fall on a rounding edge, its total has six decimals
    back = lambda c: F.round(F.col(c).cast("double") * F.col("cnt"), 6).alias(f"{c}_times_cnt")
    return out.select("utm_hash", "cnt", back("avg_cost"), back("avg_original_cost"), "source", "channel")


@query("d38_top_costs", f"""WITH c AS ({N.COSTS}), s AS (SELECT s_name AS supplier_name, s_acctbal, s_nationkey FROM supplier)
SELECT id_cost, supplier_name, s_nationkey, CAST(value AS DOUBLE) AS value FROM c JOIN s USING (supplier_name) ORDER BY c.value DESC, id_cost LIMIT 10""")
def d38_top(t):
    partners = t.supplier.select(F.col("s_name").alias("supplier_name"), "s_nationkey")
    return (C.top_costs(N.costs_in(t), partners, "supplier_name", "value").select(
        "id_cost", "supplier_name", "s_nationkey", F.col("value").cast("double").alias("value")))
