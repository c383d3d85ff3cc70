import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phenospark.functions import crops, outlines, runs
from phenospark.jobs import stand_ins
from phenospark.operators import classify, cluster, features, segmentation, shape, texture
from phenospark.sources import frames as frame_source
from phenospark.sources import outlines as outline_source
from phenospark.sources import files, tracking, viewer


def square(n=10):
    r = range(1, n)
    pts = [(i, 1) for i in r] + [(n, i) for i in r] + [(n + 1 - i, n) for i in r] + [(1, n + 1 - i) for i in r]
    return np.array([p[0] for p in pts]), np.array([p[1] for p in pts])


def as_points(x, y):
    return [{"x": int(a), "y": int(b)} for a, b in zip(x, y, strict=True)]


def test_square_outline_golden(spark):
    x, y = square()
    df = spark.createDataFrame([(1, [(int(a), int(b)) for a, b in zip(x, y, strict=True)], 100)], "id int, coords array<struct<x:int,y:int>>, Area int")
    r = shape.polygon(shape.ratios(shape.box(shape.curvature(shape.radius(df))))).first()
    assert [r[c] for c in ("Rad", "VfC", "Curv", "Len", "Wid", "A2B", "Box", "Rect")] == pytest.approx([5.178173726811096, 0.3632744793908089, 0.6884400651753831, 12.727922061357857, 12.727922061357857, 0.07716049382716049, 1.62, 0.5])
    assert outlines.corners(x.astype(float), y.astype(float)) == [0, 9, 18, 27]
    assert [r[f"poly{i}"] for i in range(1, 5)] == pytest.approx([9, np.pi / 2, 0, 0], abs=1e-9)


def test_shape_doesnt_depend_on_place():
    x, y = square(14)
    image = np.random.default_rng(0).random((80, 80)) * 255
    one = features.crop_features(image, x.astype(float), y.astype(float))
    moved = np.roll(image, (20, 30), axis=(0, 1))
    two = features.crop_features(moved, x + 30.0, y + 20.0)
    assert one[:-2] == pytest.approx(two[:-2]) and two[-2] - one[-2] == pytest.approx(30)


def test_mask_of_a_ring_and_a_notch():
    x, y = square(6)
    m = crops.mask(x - 1, y - 1, 6, 6)
    assert (m == crops.BOUNDARY).sum() == 20 and (m == crops.INTERIOR).sum() == 16
    u = np.array([(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0)])  # open at the top
    assert (crops.mask(u[:, 0], u[:, 1], 3, 3) == crops.OUTSIDE).sum() in (0, 2)


RAMP = np.arange(64.0).reshape(8, 8)


def test_cooccurrence_golden_both_ways(spark):
    images = spark.createDataFrame([(1, 8, RAMP.ravel().tolist())], "id int, width int, pixels array<double>")
    leveled = texture.with_levels(texture.pixel_table(images, ["id"]), ["id"])
    one = crops.halve(RAMP, 0.70710678)
    q = [crops.levels(i) for i in (RAMP, crops.enlarge(one, 2, (8, 8)), crops.enlarge(crops.halve(one, 0.70710678), 4, (8, 8)))]
    for (a, b), total in (((0, 1), 51), ((1, 2), 44), ((0, 2), 45)):
        counts = texture.cooccurrence(leveled, ["id"], f"q{a}", f"q{b}")
        own = crops.cooccurrence(q[a], q[b], np.ones((8, 8), bool))
        assert own.sum() == total == counts.agg({"n": "sum"}).first()[0]
        r = texture.haralick(counts, ["id"]).first()
        assert [r[h] for h in crops.HARALICK] == pytest.approx(crops.haralick(own), rel=1e-9, abs=1e-9)


def test_haralick_golden():
    m = np.zeros((10, 10))
    m[0, 0] = m[1, 1] = 1
    want = [0.5, 0, 1, 0.30103, 1, 0.25, 3, 0.30103, 0, 0, 8.28443908, 0.67254572, 0, 1]
    assert crops.haralick(m) == pytest.approx(want, abs=1e-5)
    m = np.zeros((10, 10))
    m[0, 2] = m[1, 4] = 1
    assert crops.haralick(m)[4] == pytest.approx(-11.5)
    assert crops.haralick(np.zeros((10, 10))) == [None] * 14


def test_intensity_quantiles_golden_and_brute_force():
    iq = crops.intensity_quantiles(RAMP, np.ones((8, 8), bool))
    assert [iq[0], iq[4], iq[8]] == pytest.approx([0.8478886138696956, 0.8331334144317188, 0.875])
    shape_ = np.random.default_rng(3).random((9, 13)) > 0.6
    p = np.argwhere(shape_)
    d = [np.hypot(*(a - b)) for i, a in enumerate(p) for b in p[:i]]
    assert crops.pair_dispersion(shape_) == pytest.approx(np.var(d, ddof=1) / np.mean(d))


def test_normalised_constant_image_is_null(spark):
    images = spark.createDataFrame([(1, 2, [5.0] * 4), (2, 2, [0.0, 1.0, 2.0, 4.0])], "id int, width int, pixels array<double>")
    out = texture.normalise(texture.pixel_table(images, ["id"]), ["id"])
    got = {(r["id"], r["x"], r["y"]): r["intensity"] for r in out.collect()}
    assert got[1, 1, 1] is None and got[2, 1, 1] == 0 and got[2, 2, 2] == 255
    assert texture.first_order(out, ["id"]).count() == 2 and texture.area(out, ["id"]).first()["Area"] == 4


def roi(x, y, kind=7, composite=0):
    left, top = int(min(x)), int(min(y))
    head = b"Io" + b"\0\0" + struct.pack(">hBx4hH", 218, kind, top, left, int(max(y)), int(max(x)), len(x))
    head += bytes(16) + struct.pack(">hi", 0, composite)
    head += bytes(64 - len(head))
    return head + struct.pack(f">{len(x)}h", *[int(v) - left for v in x]) + struct.pack(f">{len(y)}h", *[int(v) - top for v in y])


def test_region_files(spark, tmp_path):
    (tmp_path / "1-7.roi").write_bytes(roi([5, 14, 14, 5], [3, 3, 12, 12]))
    r = outline_source.read_outlines(spark, str(tmp_path)).first()
    assert (r["ROI_filename"], r["n"], [(p["x"], p["y"]) for p in r["coords"]]) == ("1-7", 4, [(5, 3), (14, 3), (14, 12), (5, 12)])
    dense = outline_source.densify(outline_source.read_outlines(spark, str(tmp_path))).first()
    assert dense["n"] == 36
    for bad in (b"xx" + bytes(90), roi([1, 2], [1, 2], kind=1), roi([1, 2], [1, 2], composite=9)):
        with pytest.raises(ValueError):
            outline_source.decode(bad)


def tiff(image):
    h, w = image.shape
    tags = [(256, 3, w), (257, 3, h), (258, 3, 8), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, h), (279, 4, h * w)]
    data = image.astype("u1").tobytes()
    data += bytes(len(data) % 2)
    out = b"II*\0" + struct.pack("<I", 8 + len(data)) + data + struct.pack("<H", len(tags))
    for tag, kind, value in tags:
        out += struct.pack("<HHI", tag, kind, 1) + (struct.pack("<HH", value, 0) if kind == 3 else struct.pack("<I", value))
    return out + bytes(4)


def test_all_features_of_a_painted_frame(spark, tmp_path):
    image = np.random.default_rng(1).integers(0, 255, (40, 40))
    (tmp_path / "v-0001.tif").write_bytes(tiff(image))
    index = frame_source.index_frames(spark, str(tmp_path))
    x, y = square()
    names = [(1, 1, "1-1"), (1, 2, "1-2"), (1, 3, "1-3")]
    detections = spark.createDataFrame(names, "FrameID int, CellID int, ROI_filename string")
    assert frame_source.frame_problems(index, detections).count() == 0
    assert frame_source.frame_problems(index, detections.selectExpr("FrameID + 1 FrameID")).first()["files"] == 0
    frames = frame_source.read_frames(spark, str(tmp_path))
    assert np.array(frames.first()["pixels"]).reshape(40, 40).tolist() == image.tolist()
    shapes = [("1-1", as_points(x, y)), ("1-2", as_points(x + 20, y + 15)), ("1-3", as_points(x[:3], y[:3]))]
    outlines_ = spark.createDataFrame([(n, [(p["x"], p["y"]) for p in c]) for n, c in shapes], "ROI_filename string, coords array<struct<x:int,y:int>>")
    got = features.extract_features(detections, outlines_, frames).orderBy("CellID").collect()
    assert [r["CellID"] for r in got] == [1, 2]
    r = got[1]
    assert r["Area"] == 100 and r["Rad"] == pytest.approx(5.178173726811096) and r["Len"] == pytest.approx(12.727922061357857)
    part = (image - image.min()) * 255.0 / (image.max() - image.min())
    assert r["FOmean"] == pytest.approx(part[16:26, 21:31].mean())
    assert r["dens"] == pytest.approx(1 / 25.0) and len(r) == 3 + 4 + 13 + 54 + 3


def test_detections_without_textures_are_kept(spark):
    x, y = square()
    image = np.random.default_rng(1).integers(0, 255, 1600).astype(float).tolist()
    frames = spark.createDataFrame([(1, 40, 40, image), (2, 40, 40, [7.0] * 1600)], "frame_id int, height int, width int, pixels array<double>")
    names = [(1, 1, "in"), (1, 2, "over"), (2, 1, "in"), (3, 1, "in")]  # inside, over the edge, constant frame, no frame
    detections = spark.createDataFrame(names, "FrameID int, CellID int, ROI_filename string")
    shapes = [("in", list(zip(x.tolist(), y.tolist(), strict=True))), ("over", list(zip((x + 34).tolist(), y.tolist(), strict=True)))]
    outlines_ = spark.createDataFrame(shapes, "ROI_filename string, coords array<struct<x:int,y:int>>")
    got = {(r["FrameID"], r["CellID"]): r for r in features.extract_features(detections, outlines_, frames, missing="null").collect()}
    assert sorted(got) == [(1, 1), (1, 2), (2, 1), (3, 1)]
    for at, r in got.items():
        assert r["Area"] == 100 and r["xpos"] is not None and r["dens"] is not None
        assert all((r[c] is None) == (at != (1, 1)) for c in ("FOmean", "FOsd", "IQ1"))


def test_each_frame_has_one_image_and_each_object_one_outline(spark):
    x, y = square()
    image = np.random.default_rng(1).integers(0, 255, 1600).astype(float).tolist()
    kind = "frame_id int, height int, width int, pixels array<double>"
    frames = spark.createDataFrame([(1, 40, 40, image), (2, 40, 40, image)], kind)
    shapes = [(n, list(zip(x.tolist(), y.tolist(), strict=True))) for n in ("a", "b")]
    outlines_ = spark.createDataFrame(shapes, "ROI_filename string, coords array<struct<x:int,y:int>>")
    rows = [(1, 1, "a"), (2, 1, "b"), (1, 2, "b")]
    detections = spark.createDataFrame(rows, "FrameID int, CellID int, ROI_filename string")
    assert features.extract_features(detections.unionByName(detections), outlines_, frames).count() == 6
    for bad in (frames.where("frame_id = 1"), frames.unionByName(frames.where("frame_id = 2"))):
        with pytest.raises(Exception, match="frame 2 has [02] images"):
            features.extract_features(detections, outlines_, bad)
    two = spark.createDataFrame([*rows, (1, 1, "b")], detections.schema)
    with pytest.raises(Exception, match="several outline names"):
        features.extract_features(two, outlines_, frames)
    strings = detections.withColumn("CellID", F.concat(F.lit("cell "), "CellID"))
    got = features.extract_features(strings, outlines_, frames).orderBy("FrameID", "CellID").collect()
    assert [r["CellID"] for r in got] == ["cell 1", "cell 2", "cell 1"] and all(r["Area"] == 100 for r in got)


def test_a_crowded_frame_is_dealt_in_groups(spark):
    x, y = square()
    rng = np.random.default_rng(2)
    image = rng.integers(0, 255, 90_000).astype(float).tolist()
    frames = spark.createDataFrame([(1, 300, 300, image)], "frame_id int, height int, width int, pixels array<double>")
    at = rng.integers(0, 280, (60, 2))
    outlines_ = spark.createDataFrame([(str(i), list(zip((x + a).tolist(), (y + b).tolist(), strict=True))) for i, (a, b) in enumerate(at)], "ROI_filename string, coords array<struct<x:int,y:int>>")
    detections = spark.createDataFrame([(1, i, str(i)) for i in range(60)], "FrameID int, CellID int, ROI_filename string")
    one, many = (features.frame_crops(frames, detections, outlines_, per_group=n).orderBy("CellID").collect() for n in (256, 7))
    assert one == many and len(one) == 60
    grid = np.array(image).reshape(300, 300)
    grid = (grid - grid.min()) * 255 / np.ptp(grid)
    for r, (a, b) in zip(one, at, strict=True):
        assert list(r)[2:] == pytest.approx([v if v is not None else np.nan for v in features.crop_features(grid, x + float(a), y + float(b))], nan_ok=True)


def test_intensity_dispersion_of_images(spark):
    images = spark.createDataFrame([("a", 8, RAMP.ravel().tolist()), ("b", 2, [1.0, 2.0]), ("c", 2, None)], "id string, width int, pixels array<double>")
    got = {(r["id"], r["k"]): r["IQ"] for r in texture.intensity_dispersion(images, ["id"]).collect()}
    assert [got["a", k] for k in (1, 5, 9)] == pytest.approx([0.8478886138696956, 0.8331334144317188, 0.875])
    assert len(got) == 18 and got["b", 1] is None


def test_runs_of_whole_groups():
    batch = pa.RecordBatch.from_pydict({"k": ["a", "a", None, None, "b", "b", "b"], "g": [1, 1, 1, 1, 1, 2, 2], "v": list(range(7))})
    for size in (1, 2, 3, 7):
        parts = [batch.slice(i, size) for i in range(0, 7, size)]
        groups_ = [t.column("v").to_pylist()[i:j] for t, at in runs.runs_of_groups(iter(parts), ["k", "g"]) for i, j in zip(at[:-1], at[1:], strict=True)]
        assert groups_ == [[0, 1], [2, 3], [4], [5, 6]]
    assert list(runs.runs_of_groups(iter([]), ["k"])) == []


def test_tracking_tables(spark, tmp_path):
    phase = tmp_path / "p.csv"
    phase.write_text("Banner text\nFrame,Tracking ID,Volume (µm³),Sphericity (),Other\n1,7,100.5,0.90,x\n2,7,101.5,0.91,x\n1,8,90.0,0.80,x\n", encoding="utf-8")
    got = sorted(tuple(r) for r in tracking.read_phase(spark, str(phase), 2).collect())
    assert got == [(1, 7, "1-7", 100.5, 0.9), (2, 7, "2-7", 101.5, 0.91)]
    quoted = tmp_path / "q"
    quoted.mkdir()
    for n in (1, 2):  # of several files the first by name tells the columns; a name may hold a comma
        (quoted / f"{n}.csv").write_text('Banner\n"Note, free",Frame,Tracking ID,Volume (µm³),Sphericity ()\n"a, b",%d,7,1.5,0.9\n' % n, encoding="utf-8")
    assert sorted(tuple(r) for r in tracking.read_phase(spark, str(quoted)).collect()) == [(1, 7, "1-7", 1.5, 0.9), (2, 7, "2-7", 1.5, 0.9)]
    mate = tmp_path / "m.csv"
    mate.write_text("LABEL,TRACK_ID,FRAME\nLabel,Track ID,Frame\nLabel,Track ID,Frame\n,,\nA,1,0\nB,1,1\nC,None,0\n")
    got = [tuple(r) for r in tracking.read_trackmate(spark, str(mate)).orderBy("ROI_filename").collect()]
    assert got == [(1, 1, "A"), (2, 1, "B"), (1, None, "C")]


def test_viewer_export(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "a", 2.0), (2, 1, "b", 3.0)], "FrameID int, CellID int, ROI_filename string, v double")
    viewer.export_viewer(df, str(tmp_path / "out"), "images", "video")
    assert spark.read.parquet(str(tmp_path / "out/FramePer_Relationships")).count() == 1
    assert "ROI_filename" not in spark.read.parquet(str(tmp_path / "out/cells")).columns


def groups(spark, n=60):
    return spark.range(n).selectExpr("id CellID", "case when id % 3 = 0 then 'segerror' else 'correct' end class", "case when id % 3 = 0 then 5 else 0 end + rand(1) a", "rand(2) b").cache()


def test_oversampling_stays_between_neighbours_and_ignores_partitions(spark):
    few = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (9.0, 9.0)], "a double, b double")
    one = sorted(tuple(r) for r in segmentation.oversample(few, ["a", "b"], times=2).collect())
    two = sorted(tuple(r) for r in segmentation.oversample(few.repartition(3), ["a", "b"], times=2).collect())
    assert one == two and len(one) == 8 and all(-1e-9 <= a <= 9 and -1e-9 <= b <= 9 for a, b in one)
    assert segmentation.oversample(few.limit(1), ["a", "b"]).count() == 0
    assert len(segmentation.oversample(few, ["a", "b"], times=1, most=1).collect()) == 4


def test_oversampling_is_whole_and_exact_in_blocks(spark):
    rng = np.random.default_rng(5)
    v = np.vstack([rng.normal(size=(40, 3)), rng.normal(size=(5, 3)) * 1e6, np.ones((20, 3))])  # far rows and copies
    df = spark.createDataFrame(v.tolist(), "a double, b double, c double")
    one, blocks = (sorted(tuple(r) for r in segmentation.oversample(df, ["a", "b", "c"], times=2, most=m).collect()) for m in (1000, 7))
    assert one == blocks and len(one) == 2 * len(v)
    for r in segmentation.nearest_same_class(df, ["a", "b", "c"], 3, 7).collect():
        d = np.sort(np.linalg.norm(v - np.array([r["a"], r["b"], r["c"]]), axis=1))[1:4]
        assert [np.linalg.norm(np.array(n) - [r["a"], r["b"], r["c"]]) for n in r["__near"]] == pytest.approx(d)


def test_undersampling_is_exact(spark):
    df = groups(spark).select("a", "b")
    one = segmentation.undersample(df, 7, 1).collect()
    assert len(one) == 7 and sorted(one) == sorted(segmentation.undersample(df.repartition(5), 7, 1).collect())
    assert sorted(one) != sorted(segmentation.undersample(df, 7, 2).collect())


def test_undersampling_in_ranges_without_a_global_limit(spark):
    df = spark.range(3000).selectExpr("cast(case when id % 3 = 0 then 1 else id end as double) a", "id % 2 * 0.5 b")  # many copies
    hashes = df.selectExpr("a", "b", "xxhash64(a, b, 1, 0) h").orderBy("h", "a", "b").collect()
    for n in (0, 1, 700, 1500, 2999, 3000):
        drawn = segmentation.undersample(df, n, 1)
        assert sorted(tuple(r) for r in drawn.collect()) == sorted((r["a"], r["b"]) for r in hashes[:n])
    assert "TakeOrdered" not in (plan := drawn._jdf.queryExecution().toString()) and "GlobalLimit" not in plan
    ranges = segmentation.lowest(segmentation.folded(df), 1500, 1, few=1).agg({"__w": "sum"}).first()[0]
    assert ranges == 1500


def test_segmentation_votes(spark):
    df = groups(spark)
    errors, correct = (df.where(f"class = '{c}'").drop("class") for c in ("segerror", "correct"))
    assert segmentation.labelled(errors, correct, "CellID").columns == ["a", "b", "class"]
    found = {r[0] for r in segmentation.segmentation_errors(errors, correct, df.drop("class"), trees=3, proportion=0.7).collect()}
    assert found == {i for i in range(60) if i % 3 == 0}
    few, many, small, large = segmentation.training_set(errors, correct)
    assert (few.count(), many.count(), small, large) == (40, 40, "segerror", "correct")
    with pytest.raises(ValueError, match="without replacement"):
        segmentation.tree_votes(errors, correct, df.drop("class"), trees=1, times=3)


def test_classifiers_on_separable_groups(spark):
    df = groups(spark)
    out = classify.classify(df, df, "class", ["a", "b"], "segerror", "correct", trees=10).join(df.select("CellID", "class"), "CellID").collect()
    assert len(out) == 60 and all(r["Ensemble"] == r["class"] for r in out)
    votes = spark.createDataFrame([("x", "x", "y"), ("z", "x", "z")], "LDA string, RF string, SVM string")
    assert [r["Ensemble"] for r in classify.majority(votes, "x", "y").collect()] == ["x", "y"]


def test_forest_grows_beyond_32_leaves(spark):
    label = np.random.default_rng(7).integers(0, 2, (16, 16))
    rows = [(float(i), float(j), str(label[i, j])) for i in range(16) for j in range(16) for _ in range(4)]
    df = spark.createDataFrame(rows, "a double, b double, y string")
    got = classify.random_forest(df, df, "y", ["a", "b"], trees=20).select("y", "RF").collect()
    assert sum(r["y"] == r["RF"] for r in got) / len(got) > 0.95


def test_forest_keeps_the_nodes_that_rows_have_reached(spark, monkeypatch):
    asked, plain = [], classify.RandomForestClassifier
    df = groups(spark)

    def votes(**changed):
        monkeypatch.setattr(classify, "RandomForestClassifier", lambda **k: asked.append(k) or plain(**k | changed))
        return sorted(tuple(r) for r in classify.random_forest(df, df, "class", ["a", "b"], trees=10).select("CellID", "RF").collect())

    assert votes() == votes(cacheNodeIds=False)  # the same forest
    assert asked[0].get("cacheNodeIds") is True


def test_one_file_is_dealt_to_all_cores(spark, monkeypatch):
    fits, df = [], groups(spark).coalesce(1)
    for kind in (classify.RandomForestClassifier, classify.LinearSVC):
        monkeypatch.setattr(kind, "fit", lambda self, rows, plain=kind.fit: fits.append(rows.rdd.getNumPartitions()) or plain(self, rows))
    out = classify.classify(df, df, "class", ["a", "b"], "segerror", "correct", trees=3)
    assert len(fits) == 2 and min(fits) >= 4
    assert out.rdd.getNumPartitions() >= 4


def test_machine_says_what_sparks_own_model_says(spark, monkeypatch):
    rng, models = np.random.default_rng(3), []
    rows = [(i, float(a), float(b), "in" if a * a + b * b < 1 else "out") for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "id int, a double, b double, y string")
    monkeypatch.setattr(classify.LinearSVC, "fit", lambda self, lifted, plain=classify.LinearSVC.fit: models.append((m := plain(self, lifted), lifted)) or m)
    got = classify.rbf_svm(df, df, "y", ["a", "b"], components=20).groupBy("y", "SVM").count().collect()
    model, lifted = models[0]
    own = model.transform(lifted).groupBy("__y", "__p").count().collect()
    names = ["in", "out"]
    assert {(r["y"], r["SVM"]): r["count"] for r in got} == {(names[int(r["__y"])], names[int(r["__p"])]): r["count"] for r in own}


def test_ward_clusters(spark):
    df = spark.range(90).selectExpr("id", "id % 3 * 10 + rand(1) a", "id % 3 * 7 + rand(2) b").cache()
    for few in (1000, 10):
        got = cluster.heterogeneous_clusters(df, "id", 3, few=few).collect()
        groups_ = {}
        for r in got:
            groups_.setdefault(r["cluster"], set()).add(r["id"] % 3)
        assert len(got) == 90 and sorted(map(len, groups_.values())) == [1, 1, 1]
    assert cluster.cluster_members(cluster.heterogeneous_clusters(df, "id", 3), "id").count() == 3


def test_farthest_pair_by_hull_is_that_of_all_pairs():
    rng = np.random.default_rng(0)
    for t in range(400):
        n, k = int(rng.integers(1, 60)), int(rng.integers(1, 9))
        x, y = (rng.integers(0, k, n).astype(float) if t % 2 else rng.normal(size=n) for _ in "xy")
        assert outlines.farthest_pair(x, y) == outlines.farthest_pair(x, y, few=0)
    t = np.linspace(0, 2 * np.pi, 100_000, endpoint=False)
    assert sorted(outlines.farthest_pair(5 * np.cos(t), 3 * np.sin(t))) == [0, 50_000]


def test_region_files_are_written_and_read(spark, tmp_path):
    for source in (files.RegionFiles, files.PhaseFiles):
        spark.dataSource.register(source)
    rows = [(f"{f}-{c}", [(10 * c + i, f + i % 3) for i in range(c)]) for f in range(4) for c in range(1, 30)]
    df = spark.createDataFrame(rows, "ROI_filename string, coords array<struct<x:int,y:int>>").repartition(5)
    path = str(tmp_path / "regions")
    df.write.format("regions").mode("append").save(path)
    want = sorted((n, len(c), c) for n, c in rows)
    for got in (spark.read.format("regions").option("partitionBytes", 100_000).load(path), outline_source.read_outlines(spark, path)):
        assert sorted((r["ROI_filename"], r["n"], [tuple(p) for p in r["coords"]]) for r in got.collect()) == want
    assert spark.read.format("regions").option("partitionBytes", 100_000).load(path).rdd.getNumPartitions() > 3
    df.limit(3).write.format("regions").mode("overwrite").save(path)
    assert spark.read.format("regions").load(path).count() == 3
    with pytest.raises(Exception, match="no file can have the name"):
        df.withColumn("ROI_filename", F.lit("a/b")).write.format("regions").mode("append").save(path)
    assert spark.read.format("regions").load(path).count() == 3  # nothing of a failed job
    with pytest.raises(ValueError, match="holds at most"):
        files.encode([-1], [0])


def test_filters_leave_region_files_unopened(spark, tmp_path):
    spark.dataSource.register(files.RegionFiles)
    (tmp_path / "a.roi").write_bytes(files.encode([1, 2, 3], [4, 5, 6]))
    (tmp_path / "b.roi").write_bytes(b"not a region")
    reader = files.FilteringRegionReader({"path": str(tmp_path)})
    list(reader.pushFilters([files.EqualTo(("ROI_filename",), "a"), files.In(("other",), (1,))]))
    (part,) = reader.partitions()
    assert [r for b in reader.read(part) for r in b.to_pylist()] == [{"ROI_filename": "a", "n": 3, "coords": [{"x": 1, "y": 4}, {"x": 2, "y": 5}, {"x": 3, "y": 6}]}]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert spark.read.format("regions").option("pushFilters", "true").load(str(tmp_path)).where("ROI_filename = 'a'").count() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert [list(files.RegionReader({"path": str(tmp_path / "none")}).partitions()[0].paths)] == [[]]


def test_tracking_tables_are_written_and_read(spark, tmp_path):
    spark.dataSource.register(files.PhaseFiles)
    rows = [(f, c, f"{f}-{c}", f + c / 7, None if c == 3 else c / 3) for f in range(1, 6) for c in range(5)]
    df = spark.createDataFrame(rows, files.PHASE).repartition(3)
    df.write.format("phase").mode("append").save(str(tmp_path / "t"))
    got = tracking.read_phase(spark, str(tmp_path / "t" / "part-*"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows)


def test_images_are_not_sent_whole_to_every_executor(spark):
    """500 images of 74 kB whose table Spark estimates at a few kB; none of the small tables beside it needs over 32 MB to be broadcast."""
    folder, key = "/root/testdata/sf0.01", "spark.sql.maxBroadcastTableSize"
    spark.conf.set(key, "40m")
    try:
        detections, outlines_, frames = stand_ins.painted_frames(spark, folder)
        assert features.frame_crops(frames, detections, outlines_).count() == 500
        detections, outlines_, frames = stand_ins.crowded_frames(spark, folder)
        assert features.frame_crops(frames, detections, outlines_).count() == 500
    finally:
        spark.conf.unset(key)


def test_features_of_texts_are_counted_once(spark, sf):
    """What trees read many times doesn't read a text again."""
    for df in stand_ins.judged_documents(spark, sf):
        assert df.count() and not any("documents" in f for f in df.inputFiles())
