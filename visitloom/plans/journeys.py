"""Queries over visits: touches, identity, timelines, paths, transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitloom.operators import identity as I
from visitloom.operators import markov as M
from visitloom.operators import paths as P
from visitloom.operators import sessions as S
from visitloom.plans.inputs import BRAND, CUSTOMERS, SESSIONS_FLAT, TOUCHES, Tables, customers_in, sessions_in, touches_in
from visitloom.plans.registry import as_int, query, rounded
from visitloom.session import store_once

VISIT_ORDER = ["sess", "visit_id"]
EVENT_ORDER = ["sess", "event_id"]


def touches(t: Tables):
    return S.touches(sessions_in(t), BRAND)


def stitched(t: Tables):
    return I.stitch_global(S.trinomial(S.direct_override(touches(t))), customers_in(t))


def stored_stitch(t: Tables):
    """The stitched touches are written once for all queries of an application over one folder."""
    return store_once(t.spark, f"stitched {t.folder}", lambda: stitched(t))


def kept(t: Tables):
    return S.collapse_sequential(stored_stitch(t), "gid", VISIT_ORDER)


def path_rows(t: Tables):
    return P.path_touches(*kept(t))


def medium_kept(t: Tables):
    """The flat event touches, whose states are the five media."""
    return S.collapse_sequential(touches_in(t), "fvid", EVENT_ORDER)


def medium_edges(t: Tables):
    return S.transitions(*medium_kept(t), state="medium")


# ------------------------------------------------------------------ oracle building blocks
FLAT = f"flat AS ({SESSIONS_FLAT})"


def _override(cond: str, name: str = "ov") -> str:
    return f"""{name} AS (SELECT * REPLACE (
  CASE WHEN {cond} THEN '{S.DIRECT_HASH}' ELSE utm_hash END AS utm_hash,
  CASE WHEN {cond} THEN '(direct)' ELSE src END AS src,
  CASE WHEN {cond} THEN '(none)' ELSE medium END AS medium,
  CASE WHEN {cond} THEN 1 ELSE is_some_kw END AS is_some_kw) FROM flat)"""


TRUEDIRECT = "is_page_direct = 1 AND is_true_direct = 1 AND is_some_kw <> 1"
STITCH = f"""{FLAT}, {_override(TRUEDIRECT)}, dim AS ({CUSTOMERS}),
ids AS (SELECT * REPLACE (CASE WHEN regexp_matches(device_id, '^[0-9a-fA-F\\-]{{36}}$') THEN device_id END AS device_id),
   CASE WHEN regexp_matches(cd8, '^[0-9a-fA-F]{{32}}$') THEN cd8 END AS h0,
   CASE WHEN regexp_matches(cd8, '^[0-9]+$') THEN cd8 END AS s0,
   concat_ws('_', coalesce(src, '_'), coalesce(medium, '_'), CAST(is_some_kw AS VARCHAR)) AS trin FROM ov),
known AS (SELECT i.*, coalesce(i.h0, d1.id_hash) AS hash_id, coalesce(i.s0, CAST(d2.src_fk_customer AS VARCHAR)) AS sfc,
   coalesce(d1.gender, d2.gender, 'not_set') AS gender, coalesce(d1.birthday, d2.birthday, -1) AS birthday,
   coalesce(d1.cust_created_year, d2.cust_created_year, -1) AS cust_created_year
   FROM ids i LEFT JOIN dim d1 ON i.s0 = CAST(d1.src_fk_customer AS VARCHAR) LEFT JOIN dim d2 ON i.h0 = d2.id_hash),
other AS (SELECT *, min(coalesce(sfc, hash_id)) OVER (PARTITION BY coalesce(device_id, datasource || ':' || fvid)) AS other_session_id FROM known),
st AS (SELECT *, coalesce(sfc, hash_id, other_session_id, device_id, datasource || ':' || fvid) AS gid FROM other)"""


def _timeline(source: str, key: str, tie: str, out: str = "kept") -> str:
    w = f"PARTITION BY {key} ORDER BY sess, {tie}"
    return f"""g_{out} AS (SELECT *, CAST(coalesce(sum(is_conversion) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS conv_group,
   lag(sess_end) OVER ({w}) AS prev_end FROM {source}),
m_{out} AS (SELECT *, max(is_conversion) OVER (PARTITION BY {key}, conv_group) AS cv_marker FROM g_{out}),
{out} AS (SELECT * EXCLUDE (prev_end) FROM m_{out} WHERE prev_end IS NULL OR sess - prev_end > 14400)"""


KEPT = f"{STITCH}, {_timeline('st', 'gid', 'visit_id')}"
LONG = f"""{KEPT}, long AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY sess, visit_id) AS key_pos,
   row_number() OVER (PARTITION BY gid, conv_group ORDER BY sess, visit_id) AS pos,
   count(*) OVER (PARTITION BY gid, conv_group) AS n_touches, max(sess) OVER (PARTITION BY gid, conv_group) AS path_end FROM kept)"""
MEDIUM_KEPT = f"tt AS ({TOUCHES}), {_timeline('tt', 'fvid', 'event_id')}"


def _edges(kept_name: str, key: str, tie: str, state: str, out: str = "edges", per_group: bool = False) -> str:
    w = f"PARTITION BY {key}{', conv_group' if per_group else ''} ORDER BY sess, {tie}"
    return f"""{out} AS (SELECT from_state, to_state, count(*) AS cnt FROM (
   SELECT {state} AS from_state, coalesce(lead({state}) OVER ({w}), CASE WHEN cv_marker = 0 THEN 'END' ELSE 'CONVERSION' END) AS to_state FROM {kept_name}
   UNION ALL SELECT 'START', {state} FROM (SELECT {state}, row_number() OVER ({w}) AS rn FROM {kept_name}) WHERE rn = 1) GROUP BY 1, 2)"""


MEDIUM_EDGES = f"{MEDIUM_KEPT}, {_edges('kept', 'fvid', 'event_id', 'medium')}"

# ------------------------------------------------------------------ D01-D04
TOUCH_COLS = ["visit_id", "datasource", "fvid", "sess", "sess_end", "cd8", "device_id", "state", "utm_hash", "src",
              "medium", "is_some_kw", "is_conversion", "is_true_direct", "is_page_direct"]


@query("d01_touches", f"WITH {FLAT} SELECT {', '.join(TOUCH_COLS)}, CAST(value AS DOUBLE) AS value FROM flat")
def d01(t):
    return touches(t).select(*TOUCH_COLS, F.col("value").cast("double").alias("value"))


@query("d01_touches_revenue", f"WITH {FLAT} SELECT visit_id, CASE WHEN coalesce(value, 0) > 0 THEN 1 ELSE 0 END AS is_conversion FROM flat")
def d01_revenue(t):
    return S.touches(sessions_in(t), BRAND, conv_action=None).select("visit_id", "is_conversion")


DIRECT_COLS = "visit_id, utm_hash, src, medium, is_some_kw"
for _rule, _cond in {"truedirect": TRUEDIRECT,
                     "source": "is_page_direct = 1 AND src NOT IN ('organic','cpc','(direct)') AND is_some_kw <> 1",
                     "flag": "is_true_direct = 1"}.items():
    @query(f"d02_direct_override_{_rule}", f"WITH {FLAT}, {_override(_cond)} SELECT {DIRECT_COLS} FROM ov")
    def d02(t, rule=_rule):
        return S.direct_override(touches(t), rule).select(*DIRECT_COLS.split(", "))


@query("d03_stitch_fill", f"""WITH tt AS ({TOUCHES}) SELECT event_id, fvid, coalesce(
  first_value(hash_id IGNORE NULLS) OVER (PARTITION BY fvid ORDER BY sess, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
  last_value(hash_id IGNORE NULLS) OVER (PARTITION BY fvid ORDER BY sess, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  'v' || fvid) AS client_id FROM tt""")
def d03(t):
    return I.stitch_fill(touches_in(t), "fvid", "hash_id", EVENT_ORDER).select("event_id", "fvid", "client_id")


GID_COLS = "visit_id, gid, gender, birthday, cust_created_year, other_session_id"


@query("d04_stitch_global", f"WITH {STITCH} SELECT {GID_COLS} FROM st")
def d04(t):
    return stitched(t).select(*GID_COLS.split(", "))


# ------------------------------------------------------------------ D05-D10
@query("d05_conversion_groups", f"WITH {STITCH}, {_timeline('st', 'gid', 'visit_id')} SELECT visit_id, gid, conv_group FROM g_kept")
def d05(t):
    return as_int(S.conversion_groups(stored_stitch(t), "gid", VISIT_ORDER).select("visit_id", "gid", "conv_group"), "conv_group")


@query("d06_collapse_sequential", f"WITH {KEPT} SELECT visit_id, gid, conv_group, cv_marker FROM kept")
def d06(t):
    return as_int(kept(t)[0].select("visit_id", "gid", "conv_group", "cv_marker"), "conv_group", "cv_marker")


@query("d07_path_touches", f"WITH {LONG} SELECT visit_id, gid, conv_group, key_pos, pos, n_touches, path_end FROM long")
def d07_long(t):
    return as_int(path_rows(t).select("visit_id", "gid", "conv_group", "key_pos", "pos", "n_touches", "path_end"), "conv_group")


@query("d07_paths", f"""WITH {LONG}, reg AS (SELECT gid, coalesce(min(state), 'not_set') AS country_region FROM long GROUP BY gid)
SELECT l.gid, l.conv_group, 0 AS part, any_value(n_touches) AS n_touches, max(cv_marker) AS cv_marker, CAST(sum(is_conversion) AS BIGINT) AS conversions,
  any_value(country_region) AS country_region, string_agg(utm_hash, ',' ORDER BY pos) AS utm_hash,
  string_agg(CAST(sess AS VARCHAR), ',' ORDER BY pos) AS sess, string_agg(trin, ',' ORDER BY pos) AS trinomials
FROM long l JOIN reg r ON r.gid = l.gid GROUP BY l.gid, l.conv_group""")
def d07(t):
    p = P.paths(path_rows(t)).withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",")
                                           for c in ("utm_hash", "sess", "trinomials")})
    return as_int(p, "conv_group", "part", "cv_marker")


def _groups_sql(group: str, fields: list[str], value: str, glue: str) -> str:
    lists = " || ':' || ".join(f"string_agg(coalesce(CAST({f} AS VARCHAR), '_'), ',' ORDER BY key_pos)" for f in fields)
    return f"""SELECT gid, 0 AS part, string_agg(txt, '{glue}' ORDER BY grp) AS agg_sessions FROM (
  SELECT gid, {group} AS grp, {lists} || ':' || coalesce(CAST({value} AS VARCHAR), '-1') AS txt FROM long GROUP BY gid, grp) GROUP BY gid"""


_B_EXTRA = """(SELECT *, 0 AS is_kw, CASE WHEN visit_id % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS device,
  CASE WHEN rawk = 'click' THEN 1 ELSE 0 END AS n_clicks, CASE WHEN rawk = 'view' THEN 1 ELSE 0 END AS n_views,
  CASE WHEN rawk = 'signup' THEN 1 ELSE 0 END AS is_to_cart, CASE WHEN rawk = 'error' THEN 1 ELSE 0 END AS is_rm_cart
  FROM long0 JOIN (SELECT event_id, event_type AS rawk FROM events) ON event_id = visit_id)"""


@query("d08_serialise_a", f"WITH {LONG} {_groups_sql('conv_group', ['medium'], 'sum(value)', ';')}")
def d08a(t):
    return P.serialise_paths(path_rows(t), "gid", "a").drop("groups")


@query("d08_serialise_b", f"WITH {LONG.replace('long AS', 'long0 AS')}, long AS {_B_EXTRA} " + _groups_sql(
    "conv_group", ["src", "medium", "is_some_kw", "is_kw", "sess", "device", "n_clicks", "n_views", "is_to_cart", "is_rm_cart"],
    "sum(value)", ";order,"))
def d08b(t):
    return P.serialise_paths(path_rows(t), "gid", "b").drop("groups")


@query("d08_serialise_c", f"WITH {LONG} {_groups_sql('visit_id * 0', ['utm_hash', 'trin', 'sess'], 'sum(value)', ';')}")
def d08c(t):
    return P.serialise_paths(path_rows(t), "gid", "c").drop("groups")


@query("d08_serialise_d", f"WITH {LONG} {_groups_sql('conv_group', ['utm_hash', 'sess', 'trin'], 'max(cv_marker)', ';')}")
def d08d(t):
    return P.serialise_paths(path_rows(t), "gid", "d").drop("groups")


@query("d09_parse_paths", f"""WITH {LONG}, renamed AS (SELECT *, CASE WHEN trin LIKE '%\\_1' ESCAPE '\\' THEN left(trin, length(trin) - 2) || '_kw'
  WHEN trin LIKE '%\\_0' ESCAPE '\\' THEN left(trin, length(trin) - 2) || '_nokw' ELSE trin END AS tri FROM (SELECT *, dense_rank() OVER (PARTITION BY gid ORDER BY conv_group) - 1 AS path_no FROM long) WHERE n_touches <= 15)
SELECT gid, path_no, max(cv_marker) AS label, string_agg(utm_hash, ',' ORDER BY pos) AS utm_hash, string_agg(tri, ',' ORDER BY pos) AS trinomials,
  CAST(sum(path_end - sess) AS BIGINT) AS decay_seconds FROM renamed GROUP BY gid, path_no""")
def d09(t):
    p = P.parse_paths(P.serialise_paths(path_rows(t), "gid", "d"))
    return p.select("gid", F.col("path_no").cast("bigint").alias("path_no"),
                    F.col("label").cast("bigint").alias("label"),
                    F.array_join("utm_hash", ",").alias("utm_hash"), F.array_join("trinomials", ",").alias("trinomials"),
                    F.round(F.aggregate("decay_days", F.lit(0.0), lambda a, x: a + x) * 86400).cast("bigint")
                    .alias("decay_seconds"))


@query("d09_crop_report", f"""WITH {LONG} SELECT count(*) AS paths, CAST(sum(CASE WHEN n > 15 THEN 1 ELSE 0 END) AS BIGINT) AS cropped,
  round(sum(CASE WHEN n > 15 THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS pct_cropped
  FROM (SELECT gid, conv_group, count(*) AS n FROM long GROUP BY 1, 2)""")
def d09_crop(t):
    return rounded(P.crop_report(P.parse_paths(P.serialise_paths(path_rows(t), "gid", "d"), max_seq_len=None)), "pct_cropped")


@query("d10_path_length_cutoff", f"""WITH {LONG}, ln AS (SELECT n_touches, count(*) AS n FROM long WHERE pos = 1 GROUP BY 1),
c AS (SELECT n_touches, n, sum(n) OVER (ORDER BY n_touches) / sum(n) OVER () AS share FROM ln)
SELECT max(CASE WHEN share <= 0.98 THEN n_touches END) AS max_len, CAST(sum(n) AS BIGINT) AS paths FROM c""")
def d10(t):
    return P.path_length_cutoff(path_rows(t).filter(F.col("pos") == 1))


# ------------------------------------------------------------------ D11-D12
@query("d11_transitions", f"WITH {KEPT}, {_edges('kept', 'gid', 'visit_id', 'trin')} SELECT * FROM edges")
def d11(t):
    return S.transitions(*kept(t))


@query("d11_transitions_per_group", f"WITH {KEPT}, {_edges('kept', 'gid', 'visit_id', 'trin', per_group=True)} SELECT * FROM edges")
def d11_group(t):
    return S.transitions(*kept(t), per_group=True)


@query("d12_transition_probs", f"""WITH {KEPT}, {_edges('kept', 'gid', 'visit_id', 'trin')}
SELECT from_state, to_state, cnt, round(cnt / sum(cnt) OVER (PARTITION BY from_state), 6) AS p FROM edges""")
def d12(t):
    return rounded(M.transition_probs(S.transitions(*kept(t))), "p")


STATES = ["START", "click", "error", "purchase", "signup", "view"]


@query("d12_heat_map", f"""WITH {MEDIUM_EDGES}, p AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY from_state) AS p FROM edges)
SELECT to_state, {', '.join(f"round(coalesce(sum(CASE WHEN from_state = '{s}' THEN p END), 0), 6) AS {s}" for s in STATES)}
FROM p GROUP BY to_state""")
def d12_heat(t):
    return rounded(M.heat_map(medium_edges(t), STATES), *STATES)
