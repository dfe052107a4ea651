from pyspark.sql import functions as F

from visitloom.operators import identity as I
from visitloom.operators import paths as P
from visitloom.operators import sessions as S

DDL = "gid string, sess long, sess_end long, visit_id long, trin string, is_conversion int"


def timeline(spark, rows, **kw):
    return S.collapse_sequential(spark.createDataFrame(rows, DDL), "gid", ["sess", "visit_id"], **kw)


def test_gap_is_strict_and_measured_from_the_previous_raw_visit(spark):
    rows = [("a", 0, 10, 1, "x", 0), ("a", 10 + 14400, 14500, 2, "y", 0), ("a", 14500 + 14401, 30000, 3, "z", 0),
            ("a", 30001, 30002, 4, "w", 0), ("a", 29950, 29960, 5, "v", 0)]
    kept, _ = timeline(spark, rows)
    # 2 starts exactly at the gap, 4 and 5 follow closely; only heads of runs survive
    assert sorted(r["visit_id"] for r in kept.collect()) == [1, 3]


def test_groups_and_markers(spark):
    far = 100_000
    rows = [("a", 0, 0, 1, "x", 0), ("a", far, far, 2, "y", 1), ("a", 2 * far, 2 * far, 3, "z", 1),
            ("a", 3 * far, 3 * far, 4, "w", 0), ("b", 0, 0, 5, "x", 0)]
    kept, track = timeline(spark, rows)
    got = {r["visit_id"]: (r["conv_group"], r["cv_marker"]) for r in kept.collect()}
    assert got == {1: (0, 1), 2: (0, 1), 3: (1, 1), 4: (2, 0), 5: (0, 0)}
    edges = {(r["from_state"], r["to_state"]): r["cnt"] for r in S.transitions(kept, track).collect()}
    assert edges == {("START", "x"): 2, ("x", "y"): 1, ("y", "z"): 1, ("z", "w"): 1, ("w", "END"): 1, ("x", "END"): 1}
    per = {(r["from_state"], r["to_state"]): r["cnt"] for r in S.transitions(kept, track, per_group=True).collect()}
    assert per[("y", "CONVERSION")] == 1 and per[("z", "CONVERSION")] == 1 and per[("START", "z")] == 1


def test_marker_is_set_before_rows_are_dropped(spark):
    rows = [("a", 0, 0, 1, "x", 0), ("a", 60, 60, 2, "y", 1)]
    kept, _ = timeline(spark, rows)
    assert [(r["visit_id"], r["cv_marker"]) for r in kept.collect()] == [(1, 1)]


def test_ties_are_broken_by_the_visit_id(spark):
    rows = [("a", 5, 5, 2, "y", 1), ("a", 5, 5, 1, "x", 0), ("a", 5, 5, 3, "z", 0)]
    out = S.conversion_groups(spark.createDataFrame(rows, DDL), "gid", ["sess", "visit_id"])
    assert {r["visit_id"]: r["conv_group"] for r in out.collect()} == {1: 0, 2: 0, 3: 1}


def test_null_parts_keep_their_place(spark):
    df = spark.createDataFrame([("s", None, 1)], "src string, medium string, is_some_kw int")
    assert S.trinomial(df).first()["trin"] == "s___1"


def test_stitch_fill(spark):
    df = spark.createDataFrame([("v", 1, None), ("v", 2, "h1"), ("v", 3, None), ("v", 4, "h2"), ("v", 5, None), ("w", 1, None)],
                               "fvid string, ts int, h string")
    got = {(r["fvid"], r["ts"]): r["client_id"] for r in I.stitch_fill(df, "fvid", "h", ["ts"]).collect()}
    assert got == {("v", 1): "h1", ("v", 2): "h1", ("v", 3): "h2", ("v", 4): "h2", ("v", 5): "h2", ("w", 1): "vw"}


def test_stitch_global(spark):
    h = "a" * 32
    dev = "12345678-1234-1234-1234-123456789012"
    t = spark.createDataFrame([
        ("app", "1", 0, "77", dev), ("app", "2", 0, None, dev), ("site", "3", 0, h, None), ("site", "4", 0, "guest", "bad-device"),
        ("site", "3", 9, None, None)], "datasource string, fvid string, sess long, cd8 string, device_id string")
    # the dimension repeats a hash: visits must not multiply
    dim = spark.createDataFrame([(77, "b" * 32, "f", 1980, 2015), (88, h, "m", 1990, 2016), (89, h, "m", 1990, 2016)],
                                "src_fk_customer long, id_hash string, gender string, birthday int, cust_created_year int")
    want = {("1", 0): "77", ("2", 0): "77", ("3", 0): "88", ("4", 0): "site:4", ("3", 9): "88"}
    for min_rows in (None, 1):
        rows = I.stitch_global(t, dim, min_rows).collect()
        assert {(r["fvid"], r["sess"]): r["gid"] for r in rows} == want and len(rows) == 5


def long_paths(spark):
    rows = [("a", i * 100_000, i * 100_000, i, f"src_m_{i % 2}", int(i == 4)) for i in range(8)]
    kept, track = timeline(spark, rows)
    extra = {"utm_hash": F.concat(F.lit("u"), F.col("visit_id").cast("string")), "medium": F.lit("m"), "value": F.lit(1.5),
             "state": F.lit("sp")}
    return P.path_touches(kept.withColumns(extra), track)


def test_positions(spark):
    got = {r["visit_id"]: (r["pos"], r["n_touches"], r["key_pos"]) for r in long_paths(spark).collect()}
    assert got[4] == (5, 5, 5) and got[5] == (1, 3, 6) and got[7] == (3, 3, 8)


def test_parts_of_a_long_path_join_to_the_whole(spark):
    rows = long_paths(spark)
    whole = P.paths(rows).orderBy("conv_group").collect()
    parts = P.paths(rows, part_touches=2).orderBy("conv_group", "part").collect()
    for w in whole:
        joined = [u for p in parts if p["conv_group"] == w["conv_group"] for u in p["utm_hash"]]
        assert joined == w["utm_hash"]
    assert max(len(p["utm_hash"]) for p in parts) == 2


def test_text_round_trip_and_flag_names(spark):
    text = P.serialise_paths(long_paths(spark), "gid", "d")
    assert text.first()["agg_sessions"].count(";") == 1
    parsed = {r["path_no"]: r for r in P.parse_paths(text).collect()}
    assert parsed[0]["label"] == 1 and parsed[1]["label"] == 0
    assert parsed[0]["trinomials"][:2] == ["src_m_nokw", "src_m_kw"]
    assert parsed[0]["decay_days"][-1] == 0.0 and abs(parsed[0]["decay_days"][0] - 400_000 / 86400) < 1e-9
    assert P.parse_paths(text, max_seq_len=3).count() == 1
    assert P.crop_report(P.parse_paths(text, max_seq_len=None), 3).first()["cropped"] == 1


def test_parts_of_a_long_client_parse_to_the_whole(spark):
    rows = long_paths(spark)
    whole, cut = (P.serialise_paths(rows, "gid", "d", n) for n in (100, 2))
    assert cut.count() == 4
    for limit in (None, 3, 4):
        touches = []
        for text in (whole, cut):
            parsed = P.parse_paths(text, max_seq_len=limit).orderBy("path_no", "start").collect()
            touches.append([(r["path_no"], r["n_touches"], r["label"], u, t, round(d, 9)) for r in parsed
                            for u, t, d in zip(r["utm_hash"], r["trinomials"], r["decay_days"])])
        assert touches[0] == touches[1] and (limit is None) == (len(touches[0]) == 8)
    for limit in (2, 3, 5):
        assert P.crop_report(P.parse_paths(cut, max_seq_len=None), limit).collect() == P.crop_report(P.parse_paths(whole, max_seq_len=None), limit).collect()


def test_rollup_of_a_long_client(spark):
    from visitloom.operators.customers import session_rollup
    df = spark.createDataFrame([("a", i, float(i)) for i in range(5)] + [("b", 1, None)], "k string, at int, v double")
    rows = session_rollup(df, "k", ["at"], {"v": "vs"}, part_rows=2).orderBy("k", "part").collect()
    assert [(r["k"], r["part"], r["sess_len"]) for r in rows] == [("a", 0, 5), ("a", 1, 5), ("a", 2, 5), ("b", 0, 1)]
    assert ",".join(r["vs"] for r in rows[:3]) == "0.0,1.0,2.0,3.0,4.0" and rows[3]["vs"] == "-1"


def test_digits_inside_names_survive_the_flag_names(spark):
    df = spark.createDataFrame([("g", "u:1:src10_m_1:0")], "gid string, agg_sessions string")
    assert P.parse_paths(df).first()["trinomials"] == ["src10_m_kw"]


def test_layout_separators(spark):
    rows = long_paths(spark).withColumns({c: F.lit(0) for c in ("is_some_kw", "is_kw", "n_clicks", "n_views", "is_to_cart", "is_rm_cart")})
    rows = rows.withColumns({"src": F.lit("s"), "device": F.lit("d")})
    b = P.serialise_paths(rows, "gid", "b").first()["agg_sessions"]
    assert b.count(";order,") == 1 and b.split(";order,")[0].count(":") == 10
    a = P.serialise_paths(rows, "gid", "a").first()["agg_sessions"]
    assert a == "m,m,m,m,m:7.5;m,m,m:4.5"
    assert ";" not in P.serialise_paths(rows, "gid", "c").first()["agg_sessions"]


def test_length_cutoff(spark):
    df = spark.createDataFrame([(n,) for n in [1] * 97 + [2] + [50, 60]], "n_touches int")
    assert P.path_length_cutoff(df, 0.98).first()["max_len"] == 2
