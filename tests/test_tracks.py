import numpy as np
import pytest
from pyspark.sql import functions as F

from phenospark.operators import density, motion, separation, segmentation, timeseries, tracks, viewer
from phenospark.operators.timeseries import STATS


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_movement_golden(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 3.0, 4.0), (1, 4, 3.0, 0.0)], "CellID int, FrameID int, xpos double, ypos double")
    out = [tuple(r) for r in motion.movement(df).orderBy("FrameID").select("Dis", "Trac", "D2T", "Vel").collect()]
    assert out == [(0, 0, 0, 0), (5, 5, 1, 5), (3, 9, pytest.approx(1 / 3), 2)]


def test_velocity_of_a_first_row_in_frame_zero_is_null(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0)], "CellID int, FrameID int, xpos double, ypos double")
    assert motion.movement(df).first()["Vel"] is None


def test_density_golden(spark):
    df = spark.createDataFrame([(1, "A", 0.0, 0.0, 1.0), (1, "B", 3.0, 4.0, 0.5), (1, "C", 30.0, 0.0, 10.0)], "FrameID int, CellID string, xpos double, ypos double, Rad double")
    for size in (0.1, 1.0, 50.0):
        got = {r["CellID"]: r["dens"] for r in density.local_density(df, cell_size=size).collect()}
        assert got == {"A": pytest.approx(0.2), "B": 0.0, "C": pytest.approx(0.06997049860569891)}


def test_density_against_all_pairs(spark):
    df = spark.range(300).selectExpr("cast(id % 3 as int) FrameID", "id CellID", "rand(1) * 50 xpos", "rand(2) * 50 ypos", "case when id % 97 = 0 then 40.0 else rand(3) * 2 end Rad").cache()
    a, b = df.alias("a"), df.alias("b")
    d = F.sqrt(F.pow(F.col("a.xpos") - F.col("b.xpos"), 2) + F.pow(F.col("a.ypos") - F.col("b.ypos"), 2))
    want = a.join(b, F.col("a.FrameID") == F.col("b.FrameID")).where((d > 0) & (d < 6 * F.col("a.Rad"))).groupBy("a.CellID").agg(F.sum(1 / d).alias("w"))
    both = density.local_density(df).join(want, "CellID", "left").select("dens", F.coalesce("w", F.lit(0.0)).alias("w")).collect()
    assert all(r["dens"] == pytest.approx(r["w"]) for r in both) and len(both) == 300


def test_long_tracks_count_rows_and_keep_null_ids_together(spark):
    df = spark.createDataFrame([(1, 1), (1, 9), (2, 1), (None, 1), (None, 2)], "CellID int, FrameID int")
    got = tracks.keep_long_tracks(df, 2).collect()
    assert sorted((r["CellID"] or 0, r["FrameID"]) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 9)]


def test_hygiene(spark):
    df = spark.createDataFrame([(1, 1, "a", 1.0), (1, 1, "b", float("nan")), (2, 1, "c", None), (3, 1, "d", float("inf"))], "CellID int, FrameID int, ROI_filename string, v double")
    assert rows(tracks.several_outlines(df), "CellID", "n_outlines") == [(1, 2)]
    assert rows(tracks.complete_rows(df), "CellID") == [(1,), (3,)]
    with pytest.raises(ValueError, match="ROI_filename"):
        tracks.require_columns(df.drop("ROI_filename"))
    assert tracks.frames(df).count() == 1 and tracks.frame_cells(df).count() == 3


def test_listed_ids_go_and_null_ids_stay(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "CellID int")
    got = tracks.drop_listed(df, spark.createDataFrame([(2,)], "CellID int")).collect()
    assert {r[0] for r in got} == {1, None}


def test_small_outlines_go_and_negative_coordinates_become_zero(spark):
    def box(w):
        return [(0, 0), (w - 1, 7)]

    df = spark.createDataFrame([(7, box(7)), (8, box(8)), (9, [(-1, 0), (7, 7)])], "id int, coords array<struct<x:int,y:int>>")
    got = tracks.large_enough(tracks.clamp(df)).orderBy("id").collect()
    assert [r["id"] for r in got] == [8, 9] and got[1]["coords"][0]["x"] == 0


SERIES = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9, 3]


@pytest.mark.parametrize("wide_from", [1, 99])
def test_variables_golden(spark, wide_from):
    df = spark.createDataFrame([(1, i + 1, float(v), 0.0, 0.0) for i, v in enumerate(SERIES)], "CellID int, FrameID int, v double, xpos double, ypos double")
    r = timeseries.track_variables(df, ["v"], wide_from=wide_from).first()
    want = [5, 2.780887148615228, 0.17005594929530865, 1.4375, -1.4375, 9, 1.325825213, -0.972271822, 4.24264068, 0.883883474, -0.530330084, 2.121320336, 0, -1.767766944, -1.237436861]
    assert [r[f"v_{s}"] for s in STATS] == pytest.approx(want, rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("wide_from", [1, 99])
def test_variables_of_gaps_short_and_constant_tracks(spark, wide_from):
    data = [(1, f, v) for f, v in zip((1, 2, 5, 6, 9), (1, 4, 2, 7, 3), strict=True)] + [(2, 1, 5.0)] + [(3, f, 2.0) for f in range(1, 5)] + [(4, f, -1.0 * f) for f in range(1, 5)]
    df = spark.createDataFrame([(c, f, float(v), float(f), 1.0) for c, f, v in data], "CellID int, FrameID int, v double, xpos double, ypos double")
    got = {r["CellID"]: r for r in timeseries.track_variables(df, ["v"], wide_from=wide_from).collect()}

    def null(x):
        return x is None or x != x

    assert (got[1]["v_asc"], got[1]["v_des"]) == (pytest.approx(8 / 9), pytest.approx(-6 / 9))
    assert null(got[2]["v_asc"]) and null(got[2]["v_des"]) and got[2]["v_max"] == 5 and null(got[2]["v_l1_asc"])
    assert null(got[3]["v_skew"]) and got[3]["v_std"] == 0 and got[4]["v_skew"] == 0
    assert got[3]["v_l1_asc"] == 0 and null(got[3]["v_l3_max"])


def test_gap_fill_golden(spark):
    df = spark.createDataFrame([(1, f, "v", float(v)) for f, v in zip((1, 2, 5, 6, 9), (1, 4, 2, 7, 3), strict=True)], "CellID int, FrameID int, feature string, value double")
    got = [r["value"] for r in timeseries.fill_gaps(df, ["CellID"]).orderBy("FrameID").collect()]
    assert got == pytest.approx([1, 4, 10 / 3, 8 / 3, 2, 7, 17 / 3, 13 / 3, 3])
    with pytest.raises(Exception, match="longer than 2"):
        timeseries.fill_gaps(df, ["CellID"], max_gap=2).collect()


def test_both_ways_to_the_variables_agree(spark):
    df = spark.range(400).selectExpr("cast(id % 7 as int) CellID", "cast(id div 7 * 2 + id % 3 as int) FrameID", "rand(5) - 0.3 a", "rand(6) * 9 b", "rand(7) xpos", "rand(8) ypos").dropDuplicates(["CellID", "FrameID"]).cache()
    one, two = (timeseries.track_variables(df, ["a", "b"], wide_from=w).orderBy("CellID").collect() for w in (99, 1))
    for p, q in zip(one, two, strict=True):
        assert list(p) == pytest.approx([q[c] for c in p.asDict()], rel=1e-9, abs=1e-12)


def test_separation_golden_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, None), ("a", 3.0, 2.0), ("a", 4.0, 3.0), ("b", 3.0, 1.0), ("b", 5.0, 1.0), ("b", 7.0, 2.0)], "g string, v double, w double")
    got = separation.separation_scores(df, "g", "a", "b").collect()
    assert [(r["VarIndex"], r["VarName"]) for r in got] == [(1, "v")] and got[0]["SepScore"] == pytest.approx(0.8241758241758242)
    swapped = separation.separation_scores(df, "g", "b", "a").first()
    assert swapped["SepScore"] == pytest.approx(got[0]["SepScore"])


def test_elbow_golden(spark):
    df = spark.createDataFrame([(i + 1, f"v{i}", float(s)) for i, s in enumerate((10, 8, 3, 2, 1.5, 1))], "VarIndex int, VarName string, SepScore double")
    assert sorted(r["SepScore"] for r in separation.elbow(df).collect()) == [8, 10]
    assert separation.elbow(df.limit(1)).count() == 0 and separation.elbow(df.limit(0)).count() == 0


def test_zscore_drops_constant_columns(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "id int, a double, b double")
    assert separation.zscore(df, ["a", "b"]).columns == ["id", "a"]
    assert [r["a"] for r in separation.zscore(df, ["a"]).orderBy("id").collect()] == pytest.approx([-(0.5**0.5), 0.5**0.5])


def test_viewer_links_golden(spark):
    df = spark.createDataFrame([(1, 1), (1, 3), (1, 4), (2, 2)], "CellID int, FrameID int")
    assert rows(viewer.next_frame_links(df), "image_number1", "object_number1", "image_number2", "object_number2") == [(1, 1, 3, 1), (3, 1, 4, 1)]
    assert viewer.link_view(viewer.next_frame_links(df), viewer.relationship_types(spark)).first()["relationship"] == "Parent"
    assert viewer.frame_index(df, "d", "p").orderBy("FrameID").first()["filename_channel_1"] == "p-0001.tif"


def test_ensemble_votes(spark):
    runs = [spark.createDataFrame(x, "CellID int") for x in ([(1,), (2,)], [(1,)], [(3,)], [(1,)])]
    assert rows(segmentation.ensemble(runs), "CellID") == [(1,)]
    assert rows(segmentation.ensemble(runs[:2]), "CellID") == [(1,), (2,)]


def moves(spark):
    """Tracks of all lengths, one without an id that holds a third of all rows, and rows that share a frame."""
    rng = np.random.default_rng(9)
    rows = [(None if i % 3 == 0 else int(rng.integers(0, 40)), int(f), *map(float, rng.normal(size=2).round(3))) for i, f in enumerate(rng.permutation(3000))]
    return spark.createDataFrame(rows, "CellID int, FrameID int, xpos double, ypos double")


@pytest.mark.parametrize("most", [7, 100, 900])
def test_movement_by_ranges_is_movement(spark, most):
    df = moves(spark)
    one, two = ({(r["CellID"], r["FrameID"]): (r["Dis"], r["Trac"], r["D2T"], r["Vel"]) for r in motion.movement(df, 0.5, most=m).collect()} for m in (10**6, most))
    assert one.keys() == two.keys() and len(one) == 3000
    assert all(a == pytest.approx(two[k]) for k, a in one.items())


def test_movement_spreads_a_track_over_tasks(spark):
    df = moves(spark).withColumn("FrameID", F.lit(3))  # all in one frame: cut by hashes
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = motion.movement(df, most=50)
        tasks = out.where("CellID is null").select(F.spark_partition_id().alias("task"), "Dis", "Trac", "Vel").collect()
        by_task = [sum(r["task"] == t for r in tasks) for t in {r["task"] for r in tasks}]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(by_task) > 1 and max(by_task) < 1000
    assert out.count() == 3000 and out.where("CellID is null and Trac > 1000").count() > 0


def test_long_tracks_with_and_without_ids(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, "a"), (2, None), (2, None), (2, "b")], "CellID int, video string")
    assert sorted(map(tuple, tracks.keep_long_tracks(df, 2, ["video", "CellID"]).collect()), key=repr) == [(2, None), (2, None), (None, "a"), (None, "a")]


@pytest.mark.parametrize("wide_from", [99, 1])
def test_wavelets_across_wide_gaps_are_those_of_filled_series(spark, wide_from):
    rng = np.random.default_rng(1)
    rows = []
    for cell, gap in enumerate((1, 2, 9, 70, 300)):
        frame = int(rng.integers(0, 50))
        for _ in range(12):
            rows.append((cell, frame, *map(float, rng.normal(size=3))))
            frame += int(rng.integers(1, gap + 1))
    df = spark.createDataFrame(rows, "CellID int, FrameID int, xpos double, ypos double, v double")
    got = {r["CellID"]: r for r in timeseries.track_variables(df, ["v"], wide_from=wide_from).collect()}
    for cell in range(5):
        f, v = (np.array([r[i] for r in rows if r[0] == cell]) for i in (1, 4))
        whole = np.interp(np.arange(f[0], f[-1] + 1), f, v)
        for level in range(1, timeseries.LEVELS + 1):
            half = 2 ** (level - 1)
            n = len(whole) // (2 * half)
            d = whole[: n * 2 * half].reshape(n, 2, half).sum(axis=2) @ [1, -1] * timeseries.TAP * (timeseries.TAP / 2**0.5) ** (level - 1)
            want = (d[d > 0].sum() / n, d[d <= 0].sum() / n, d.max()) if n >= 2 else (None, None, None)
            assert [got[cell][f"v_l{level}_{s}"] for s in ("asc", "des", "max")] == pytest.approx(list(want), abs=1e-9), (cell, level)


@pytest.mark.parametrize("wide_from", [99, 1])
def test_a_track_of_two_rows_far_apart(spark, wide_from):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 100_000_000, 1.0, 1.0, 1e8)], "CellID int, FrameID int, xpos double, ypos double, v double")
    r = timeseries.track_variables(df, ["v"], wide_from=wide_from).first()
    # a slope of 1: all coefficients are minus the constant times the square of half a block
    scale = [timeseries.TAP * (timeseries.TAP / 2**0.5) ** (n - 1) for n in (1, 2, 3)]
    assert [r[f"v_l{n}_des"] for n in (1, 2, 3)] == pytest.approx([-c * 4**i for i, c in enumerate(scale)])
    assert r["v_l1_asc"] == 0 and r["v_l3_max"] == pytest.approx(-scale[2] * 16) and r["v_asc"] == pytest.approx(1e8 / 100_000_001)


def test_density_of_clustered_frames_looks_at_few_rows(spark):
    rng = np.random.default_rng(4)
    v = np.vstack([rng.normal(size=(700, 2)) * 3 + c for c in ((0, 0), (40, 10), (-30, 25))] + [rng.uniform(-80, 80, (200, 2)), np.zeros((3, 2))])
    rad = rng.choice([0.1, 0.3, 0.5], len(v))
    df = spark.createDataFrame([(i % 2, i, float(x), float(y), float(r)) for i, ((x, y), r) in enumerate(zip(v, rad, strict=True))], "FrameID int, CellID int, xpos double, ypos double, Rad double")
    near = density.candidates(df, ["CellID"], ["FrameID"], 6.0, "xpos", "ypos", "Rad", 1.0, 16)
    looked, hits = near.count(), near.where("__d < __reach").count()
    assert looked <= 3 * hits
    got = {r["CellID"]: r["dens"] for r in density.local_density(df, crowd=16).collect()}
    for i in range(0, len(v), 7):
        d = np.hypot(*(v[i % 2 :: 2] - v[i]).T)
        own = d[(d > 0) & (d < 6 * rad[i])]
        assert got[i] == pytest.approx((1 / own).sum())


@pytest.mark.parametrize("blocks_from", (1, 400, 10_000))
def test_density_of_crowded_frames_by_blocks(spark, blocks_from):
    rng = np.random.default_rng(5)
    v = np.round(np.vstack([rng.normal(size=(500, 2)) * 4, rng.uniform(-60, 60, (300, 2)), np.zeros((3, 2))]), 1)
    frame, rad = rng.choice([0, 0, 0, 1], len(v)), rng.choice([0.0, 0.5, 1.0, 3.0], len(v))
    df = spark.createDataFrame([(int(f), i, float(x), float(y), float(r)) for i, (f, (x, y), r) in enumerate(zip(frame, v, rad, strict=True))] + [(0, 900, None, 1.0, 1.0)], "FrameID int, CellID int, xpos double, ypos double, Rad double")
    got = {r["CellID"]: r["dens"] for r in density.local_density(df, blocks_from=blocks_from).collect()}
    assert len(got) == len(v) + 1 and got[900] == 0
    for i in range(len(v)):
        d = np.hypot(*(v[frame == frame[i]] - v[i]).T)
        assert got[i] == pytest.approx((1 / d[(d > 0) & (d < 6 * rad[i])]).sum())
    spot = df.selectExpr("FrameID", "xpos __x", "ypos __y", "Rad * 6 __reach")
    cut = density.crowded_density(spot, ["FrameID"], 1.0, most_looks=16, most_places=32)  # many blocks to a cell
    assert {(r["__x"], r["__y"]): r["dens"] for r in cut.where("FrameID = 0 and __reach = 18").collect()} == pytest.approx({tuple(v[i]): got[i] for i in range(len(v)) if frame[i] == 0 and rad[i] == 3})


def test_copies_in_a_frame_make_no_pairs(spark):
    df = spark.range(20_000).selectExpr("1 FrameID", "id CellID", "cast(id % 4 as double) xpos", "0.0D ypos", "1.0D Rad")
    spot = df.selectExpr("FrameID", "xpos __x", "ypos __y", "Rad * 6 __reach")
    got = sorted((r["__x"], r["dens"]) for r in density.crowded_density(spot, ["FrameID"], 1.0).collect())
    assert got == [(i, pytest.approx(5000 * sum(1 / abs(i - j) for j in range(4) if j != i))) for i in range(4)]
    assert {(r["xpos"], round(r["dens"], 6)) for r in density.local_density(df).collect()} == {(x, round(d, 6)) for x, d in got}
