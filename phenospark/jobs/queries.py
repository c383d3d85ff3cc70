"""The registered queries and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crops import HARALICK
from ..operators import classify, cluster, density, features, motion, segmentation, separation, shape, texture, timeseries, tracks, trees, viewer
from ..operators.timeseries import LEVELS, STATS, TAP
from ..operators.lineage import shared_folder
from ..sources import files, tracking
from . import stand_ins as data

FLAGSHIP = "cell_variables"
MIN_FRAMES = 20
OFFSET = 1.234e-9
Q = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Q] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Q], Q]:
    """Register a function as a query by its name, with its SQL if that can express it."""

    def add(f: Q) -> Q:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, to: int = 6) -> DataFrame:
    """Doubles rounded so that sums taken in another order agree; no negative zero. The offset keeps fractions that end
    in the middle between two rounded values away from there."""
    return df.withColumns({c: F.round(F.col(c) + OFFSET, to) + F.lit(0.0) for c in columns})


def R(expression: str, name: str, to: int = 6) -> str:
    """The same in SQL."""
    return f"round({expression} + {OFFSET!r}, {to}) + 0.0 AS {name}"


def _doubles(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "double"]


# --- tracks

LONG = f"""{data.EVENT_TRACKS}, long AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY CellID) AS n FROM tracks) WHERE n >= {MIN_FRAMES})"""


def long_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.keep_long_tracks(data.event_tracks(spark, sf_dir), MIN_FRAMES)


@query(f"WITH {LONG} SELECT FrameID, CellID, FrameID || '-' || CellID AS ROI_filename, {R('Volume', 'Volume')}, {R('xpos', 'xpos')}, {R('ypos', 'ypos')} FROM long")
def tracks_min_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tracks.in_order(tracks.require_columns(long_tracks(spark, sf_dir)))
    return rounded(out.select("FrameID", "CellID", "ROI_filename", "Volume", "xpos", "ypos"), "Volume", "xpos", "ypos")


MOVED = """, steps AS (
  SELECT *, coalesce(sqrt((xpos - lag(xpos) OVER w) ** 2 + (ypos - lag(ypos) OVER w) ** 2), 0) AS step,
         sqrt((xpos - first_value(xpos) OVER w) ** 2 + (ypos - first_value(ypos) OVER w) ** 2) AS Dis, FrameID - lag(FrameID, 1, 0) OVER w AS gap
  FROM {table} WINDOW w AS (PARTITION BY CellID ORDER BY FrameID)),
summed AS (SELECT *, sum(step) OVER (PARTITION BY CellID ORDER BY FrameID ROWS UNBOUNDED PRECEDING) AS Trac FROM steps),
moved AS (SELECT *, CASE WHEN Trac > 0 THEN Dis / Trac ELSE 0 END AS D2T, {rate} * step / nullif(gap, 0) AS Vel FROM summed)"""
MOVEMENT_OUT = ", ".join(R(c, c) for c in features.MOVEMENT)


@query(f"WITH {LONG}{MOVED.format(table='long', rate=0.0028)} SELECT CellID, FrameID, {MOVEMENT_OUT} FROM moved")
def track_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = motion.movement(long_tracks(spark, sf_dir), framerate=0.0028)
    return rounded(out.select("CellID", "FrameID", *features.MOVEMENT), *features.MOVEMENT)


@query(f"WITH {data.SHIPPING_TRACKS}{MOVED.format(table='tracks', rate=1)} SELECT CellID, FrameID, {MOVEMENT_OUT} FROM moved")
def track_movement_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = motion.movement(data.shipping_tracks(spark, sf_dir))
    return rounded(out.select("CellID", "FrameID", *features.MOVEMENT), *features.MOVEMENT)


@query(f"WITH {data.EVENT_TRACKS} SELECT FrameID, count(DISTINCT CellID) AS n_cells FROM tracks GROUP BY FrameID")
def frame_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.frame_cells(data.event_tracks(spark, sf_dir)).groupBy("FrameID").agg(F.count(F.lit(1)).alias("n_cells"))


@query(f"{data.EVENT_NAMES} SELECT CellID, FrameID, count(DISTINCT ROI_filename) AS n_outlines FROM named GROUP BY CellID, FrameID HAVING count(DISTINCT ROI_filename) > 1")
def outline_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who did several kinds of things in half a day, with an outline named after each."""
    return tracks.several_outlines(data.event_names(spark, sf_dir))


# --- time series

FEATURES = ["Volume", *features.MOVEMENT]
SERIES = f"""WITH {LONG}{MOVED.format(table="long", rate=0.0028)},
whole AS (SELECT * FROM moved WHERE NOT (Vel IS NULL OR isnan(Vel))),
series AS ({" UNION ALL ".join(f"SELECT CellID, FrameID, '{f}' AS feature, {f} AS value FROM whole" for f in FEATURES)})"""
SUMMARY_SQL = """SELECT CellID, feature, avg(value) AS mean, stddev_samp(value) AS std,
  CASE WHEN max(value) > 0 THEN CASE WHEN count(*) >= 3 AND var_pop(value) > 0 THEN skewness(value) END ELSE 0 END AS skew FROM series GROUP BY ALL"""
ELEVATION_SQL = """SELECT CellID, feature, CASE WHEN count(d) > 0 THEN sum(CASE WHEN d > 0 THEN d ELSE 0 END) / (max(FrameID) - min(FrameID) + 1) END AS "asc",
  CASE WHEN count(d) > 0 THEN sum(CASE WHEN d <= 0 THEN d ELSE 0 END) / (max(FrameID) - min(FrameID) + 1) END AS des, max(value) AS max
  FROM (SELECT *, value - lag(value) OVER (PARTITION BY CellID, feature ORDER BY FrameID) AS d FROM series) GROUP BY ALL"""
FILLED_SQL = """ahead AS (SELECT *, lead(FrameID) OVER w AS nf, lead(value) OVER w AS nv FROM series WINDOW w AS (PARTITION BY CellID, feature ORDER BY FrameID)),
filled AS (SELECT CellID, feature, t::INT AS FrameID, CASE WHEN nf IS NULL THEN value ELSE value + (t - FrameID) * ((nv - value) / (nf - FrameID)) END AS value
  FROM (SELECT *, unnest(generate_series(FrameID, coalesce(nf - 1, FrameID))) AS t FROM ahead))"""


def _level_sql(level: int) -> str:
    half, scale = 2 ** (level - 1), TAP * (TAP / 2**0.5) ** (level - 1)
    return f"""l{level} AS (SELECT CellID, feature, CASE WHEN count(*) >= 2 THEN sum(CASE WHEN d > 0 THEN d ELSE 0 END) / count(*) END AS l{level}_asc,
  CASE WHEN count(*) >= 2 THEN sum(CASE WHEN d <= 0 THEN d ELSE 0 END) / count(*) END AS l{level}_des, CASE WHEN count(*) >= 2 THEN max(d) END AS l{level}_max
  FROM (SELECT CellID, feature, k // {2 * half} AS b, {scale!r} * sum(CASE WHEN k % {2 * half} < {half} THEN value ELSE -value END) AS d
    FROM (SELECT *, FrameID - min(FrameID) OVER (PARTITION BY CellID, feature) AS k FROM filled) GROUP BY ALL HAVING count(*) = {2 * half}) GROUP BY ALL)"""


LEVELS_SQL = ",\n".join(_level_sql(n) for n in range(1, LEVELS + 1))
WAVELET_STATS = [s for s in STATS if s.startswith("l")]


def _series_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = motion.movement(long_tracks(spark, sf_dir), framerate=0.0028)
    return tracks.complete_rows(moved.select("CellID", "FrameID", "xpos", "ypos", *FEATURES))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.long_form(_series_rows(spark, sf_dir), FEATURES, ["CellID"])


@query(f"{SERIES}, s AS ({SUMMARY_SQL}) SELECT CellID, feature, {R('mean', 'mean')}, {R('std', 'std')}, {R('skew', 'skew', 4)} FROM s")
def cell_summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeseries.summary(_series(spark, sf_dir), ["CellID"])
    return rounded(rounded(out, "mean", "std"), "skew", to=4)


@query(f'{SERIES}, e AS ({ELEVATION_SQL}), a AS (SELECT CellID, (max(xpos) - min(xpos)) * (max(ypos) - min(ypos)) / (max(FrameID) - min(FrameID) + 1) AS area FROM whole GROUP BY CellID) SELECT CellID, feature, {R(chr(34) + "asc" + chr(34), chr(34) + "asc" + chr(34))}, {R("des", "des")}, {R("max", "max")}, {R("area", "trajArea")} FROM e JOIN a USING (CellID)')
def cell_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _series_rows(spark, sf_dir)
    out = timeseries.elevation(timeseries.long_form(rows, FEATURES, ["CellID"]), ["CellID"]).join(timeseries.trajectory_area(rows, ["CellID"]), "CellID")
    return rounded(out, "asc", "des", "max", "trajArea")


@query(f"{SERIES}, {FILLED_SQL} SELECT CellID, feature, FrameID, {R('value', 'value')} FROM filled")
def cell_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeseries.fill_gaps(_series(spark, sf_dir), ["CellID"]), "value")


@query(f"{SERIES}, {FILLED_SQL}, {LEVELS_SQL} SELECT CellID, feature, {', '.join(R(s, s) for s in WAVELET_STATS)} FROM (SELECT DISTINCT CellID, feature FROM series) {' '.join(f'LEFT JOIN l{n} USING (CellID, feature)' for n in range(1, LEVELS + 1))}")
def cell_wavelets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeseries.wavelets(_series(spark, sf_dir), ["CellID"])
    return rounded(out, *WAVELET_STATS)


def _variables_sql() -> str:
    def column(f: str, s: str) -> str:
        to = 4 if s == "skew" else 6
        return R(f"max(CASE WHEN feature = '{f}' THEN \"{s}\" END)", f"{f}_{s}", to)

    columns = ", ".join(column(f, s) for f in FEATURES for s in STATS)
    joined = f"s JOIN e USING (CellID, feature) {' '.join(f'LEFT JOIN l{n} USING (CellID, feature)' for n in range(1, LEVELS + 1))}"
    return f"""{SERIES}, {FILLED_SQL}, {LEVELS_SQL}, s AS ({SUMMARY_SQL}), e AS ({ELEVATION_SQL}), wide AS (SELECT CellID, {columns} FROM {joined} GROUP BY CellID),
    a AS (SELECT CellID, {R("(max(xpos) - min(xpos)) * (max(ypos) - min(ypos)) / (max(FrameID) - min(FrameID) + 1)", "trajArea")} FROM whole GROUP BY CellID) SELECT * FROM wide JOIN a USING (CellID)"""


def _rounded_variables(df: DataFrame) -> DataFrame:
    skews = [c for c in df.columns if c.endswith("_skew")]
    return rounded(rounded(df, *[c for c in _doubles(df) if c not in skews]), *skews, to=4)


@query(_variables_sql())
def cell_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: tracks of some length, their movement, all variables of each."""
    return _rounded_variables(timeseries.track_variables(_series_rows(spark, sf_dir), FEATURES))


@query(_variables_sql())
def cell_variables_by_helper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the helper for wide tables."""
    return _rounded_variables(timeseries.track_variables(_series_rows(spark, sf_dir), FEATURES, wide_from=1))


# --- surroundings, viewer

@query(f"WITH {data.EVENT_TRACKS}, near AS (SELECT a.FrameID, a.CellID, sum(1 / sqrt((a.xpos - b.xpos) ** 2 + (a.ypos - b.ypos) ** 2)) AS d FROM tracks a JOIN tracks b ON a.FrameID = b.FrameID AND sqrt((a.xpos - b.xpos) ** 2 + (a.ypos - b.ypos) ** 2) > 0 AND sqrt((a.xpos - b.xpos) ** 2 + (a.ypos - b.ypos) ** 2) < 6 * a.Rad GROUP BY ALL) SELECT FrameID, CellID, {R('xpos', 'xpos')}, {R('coalesce(d, 0)', 'dens')} FROM tracks LEFT JOIN near USING (FrameID, CellID)")
def local_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = data.event_tracks(spark, sf_dir)
    out = density.attach(found.drop("Rad"), density.local_density(found).select("CellID", "FrameID", "dens"))
    return rounded(out.select("FrameID", "CellID", "xpos", "dens"), "xpos", "dens")


@query(f"WITH {data.EVENT_TRACKS} SELECT DISTINCT FrameID, 'images' AS path_channel_1, format('video-{{:04d}}.tif', FrameID) AS filename_channel_1, 1 AS Image_Group_Number, FrameID AS Image_Group_Index FROM tracks")
def frame_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viewer.frame_index(data.event_tracks(spark, sf_dir), "images", "video")


@query(f"WITH {data.EVENT_TRACKS} SELECT FrameID, CellID, {', '.join(R(c, c) for c in ('Volume', 'Rad', 'xpos', 'ypos'))} FROM tracks")
def object_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(viewer.object_table(data.event_tracks(spark, sf_dir)), "Volume", "Rad", "xpos", "ypos")


LINKS = f"WITH {data.EVENT_TRACKS}, ahead AS (SELECT a.FrameID AS f, a.CellID AS c, min(b.FrameID) AS g FROM tracks a JOIN tracks b ON a.CellID = b.CellID AND a.FrameID < b.FrameID GROUP BY ALL)"


@query(f"{LINKS} SELECT 1 AS relationship_type_id, f AS image_number1, c AS object_number1, g AS image_number2, c AS object_number2 FROM ahead")
def frame_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viewer.next_frame_links(data.event_tracks(spark, sf_dir))


@query(f"{LINKS} SELECT f AS image_number1, c AS object_number1, g AS image_number2, c AS object_number2, 1 AS module_number, 'Parent' AS relationship, 'cell' AS object_name1, 'cell' AS object_name2 FROM ahead")
def link_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viewer.link_view(viewer.next_frame_links(data.event_tracks(spark, sf_dir)), viewer.relationship_types(spark))


# --- separation

E64 = [f"e{i}" for i in range(64)]
SCORES = f"""WITH long AS (SELECT label, 'e' || (generate_subscripts(embedding, 1) - 1) AS VarName, generate_subscripts(embedding, 1)::INT AS VarIndex, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE label IN (0, 1)),
stats AS (SELECT VarName, VarIndex, count(v) FILTER (label = 0) AS n1, count(v) FILTER (label = 1) AS n2, avg(v) FILTER (label = 0) AS m1, avg(v) FILTER (label = 1) AS m2, var_samp(v) FILTER (label = 0) AS v1, var_samp(v) FILTER (label = 1) AS v2 FROM long GROUP BY ALL),
means AS (SELECT *, (n1 * m1 + n2 * m2) / (n1 + n2) AS m FROM stats),
scores AS (SELECT VarIndex, VarName, (n1 * (m1 - m) ** 2 + n2 * (m2 - m) ** 2) / ((n1 - 1) * v1 + (n2 - 1) * v2) AS score FROM means)"""
ELBOW = """, ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, VarIndex) AS i, count(*) OVER () AS n, max(score) OVER () AS hi, min(score) OVER () AS lo FROM scores),
below AS (SELECT *, hi + (lo - hi) * (i - 1) / (n - 1) - score AS below FROM ranked),
best AS (SELECT score AS elbow FROM below ORDER BY below DESC, i LIMIT 1)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separation.separation_scores(data.vectors(spark, sf_dir).drop("vec_id"), "label", 0, 1, E64)


@query(f"{SCORES} SELECT VarIndex, VarName, {R('score', 'SepScore', 9)} FROM scores")
def separation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scores(spark, sf_dir), "SepScore", to=9)


@query(f"{SCORES}{ELBOW} SELECT VarIndex, VarName, {R('score', 'SepScore', 9)} FROM scores, best WHERE score > elbow")
def separation_optimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(separation.elbow(_scores(spark, sf_dir)), "SepScore", to=9)


ABOVE = 0.005


@query(f"{SCORES} SELECT vec_id, label, VarName, {R('v', 'value')} FROM (SELECT vec_id, label, 'e' || (generate_subscripts(embedding, 1) - 1) AS VarName, unnest(embedding)::DOUBLE AS v FROM embeddings) JOIN scores USING (VarName) WHERE score >= {ABOVE}")
def select_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings' columns with a score from a threshold up; as rows, for the names depend on the data."""
    chosen = tracks.select_features(data.vectors(spark, sf_dir), _scores(spark, sf_dir).where(F.col("SepScore") >= ABOVE), ["vec_id", "label"])
    names = [c for c in chosen.columns if c.startswith("e")]
    long = chosen.unpivot(["vec_id", "label"], names, "VarName", "value") if names else chosen.select("vec_id", "label", F.lit("").alias("VarName"), F.lit(0.0).alias("value")).limit(0)
    return rounded(long, "value")


@query(f"WITH long AS (SELECT vec_id, 'e' || (generate_subscripts(embedding, 1) - 1) AS name, unnest(embedding)::DOUBLE AS v FROM embeddings), z AS (SELECT vec_id, name, (v - avg(v) OVER (PARTITION BY name)) / stddev_samp(v) OVER (PARTITION BY name) AS z FROM long) SELECT vec_id, name, {R('z', 'z')} FROM z")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = separation.zscore(data.vectors(spark, sf_dir).drop("label"), E64)
    return rounded(out.unpivot(["vec_id"], E64, "name", "z"), "z")


# --- texture

NORMAL = f"WITH {data.PIXELS}, ranges AS (SELECT vec_id, min(v) AS lo, max(v) AS hi FROM pixels GROUP BY 1), normal AS (SELECT vec_id, x, y, CASE WHEN hi > lo THEN v * (255.0::DOUBLE / (hi - lo)) + (255.0::DOUBLE - 255.0::DOUBLE / (hi - lo) * hi) END AS v FROM pixels JOIN ranges USING (vec_id))"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texture.pixel_table(data.images(spark, sf_dir), ["vec_id"])


def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texture.normalise(_pixels(spark, sf_dir), ["vec_id"])


@query(f"{NORMAL} SELECT vec_id, x, y, {R('v', 'intensity')} FROM normal")
def image_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_normal(spark, sf_dir).drop("region"), "intensity")


@query(f"{NORMAL} SELECT vec_id, {R('avg(v)', 'FOmean')}, {R('stddev_samp(v)', 'FOsd')}, {R('skewness(v)', 'FOskew')} FROM normal GROUP BY vec_id")
def first_order_texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(texture.first_order(_normal(spark, sf_dir), ["vec_id"]), "FOmean", "FOsd", "FOskew")


HAAR = f"""{NORMAL}, h1 AS (SELECT vec_id, (x - 1) // 2 AS bx, (y - 1) // 2 AS "by", avg(v) * {2 * TAP * TAP!r} AS v FROM normal GROUP BY ALL),
h2 AS (SELECT vec_id, bx // 2 AS bx, "by" // 2 AS "by", avg(v) * {2 * TAP * TAP!r} AS v FROM h1 GROUP BY ALL)"""


@query(f'{HAAR} SELECT vec_id, 1 AS level, bx::INT AS bx, "by"::INT AS "by", {R("v", "value")} FROM h1 UNION ALL SELECT vec_id, 2, bx::INT, "by"::INT, {R("v", "value")} FROM h2')
def haar_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _normal(spark, sf_dir)
    one, two = (texture.haar(p, ["vec_id"], n).select("vec_id", F.lit(n).alias("level"), "bx", "by", "value") for n in (1, 2))
    return rounded(one.unionByName(two), "value")


COOC = f"""{HAAR}, three AS (SELECT n.vec_id, n.v AS v0, h1.v AS v1, h2.v AS v2 FROM normal n JOIN h1 ON n.vec_id = h1.vec_id AND (n.x - 1) // 2 = h1.bx AND (n.y - 1) // 2 = h1."by"
  JOIN h2 ON n.vec_id = h2.vec_id AND (n.x - 1) // 4 = h2.bx AND (n.y - 1) // 4 = h2."by"),
levels AS (SELECT vec_id, {", ".join(f"floor((v{k} - min(v{k}) OVER w) * 10 / nullif(max(v{k}) OVER w - min(v{k}) OVER w, 0) + 1e-6)::INT AS q{k}" for k in range(3))} FROM three WINDOW w AS (PARTITION BY vec_id)),
pairs AS ({" UNION ALL ".join(f"SELECT vec_id, '{a}{b}' AS pair, q{a} AS i, q{b} AS j, count(*) AS n FROM levels WHERE q{a} > 0 AND q{b} > 0 GROUP BY ALL" for a, b in ((0, 1), (1, 2), (0, 2)))})"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texture.cooccurrences(texture.with_levels(_normal(spark, sf_dir), ["vec_id"]), ["vec_id"])


@query(f"{COOC} SELECT vec_id, pair, i, j, n FROM pairs")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


HARALICK_SQL = f"""{COOC}, p AS (SELECT vec_id, pair, i, j, n / sum(n) OVER (PARTITION BY vec_id, pair) AS p FROM pairs),
m AS (SELECT *, sum(j * p) OVER k AS mx, sum(i * p) OVER k AS my, sum(p) OVER (PARTITION BY vec_id, pair, j) AS px, sum(p) OVER (PARTITION BY vec_id, pair, i) AS py,
  sum(p) OVER (PARTITION BY vec_id, pair, i + j) AS ps, sum(p) OVER (PARTITION BY vec_id, pair, abs(i - j)) AS pd FROM p WINDOW k AS (PARTITION BY vec_id, pair)),
e AS (SELECT *, -sum(p * log10(ps)) OVER k AS sen, -sum(p * log10(pd)) OVER k AS den, -sum(p * (log10(px) + log10(py))) OVER k AS hxy2 FROM m WINDOW k AS (PARTITION BY vec_id, pair)),
a AS (SELECT vec_id, pair, sum(p * p) AS "ASM", sum((i - j) ** 2 * p) AS Con, sum(p / (1 + (i - j) ** 2)) AS IDM, -sum(p * log10(p)) AS Ent, sum((i - mx) * (j - my) * p) AS c, sum((j - mx) ** 2 * p) * sum((i - my) ** 2 * p) AS vv,
  sum((i - (mx + my) / 2) ** 2 * p) AS Var, sum((i + j) * p) AS Sav, first(sen) AS Sen, first(den) AS Den, first(hxy2) AS hxy2, sum((abs(i - j) - den) ** 2 * p) AS Dva, sum((i + j - sen) ** 2 * p) AS Sva,
  sum((i + j - mx - my) ** 3 * p) AS Sha, sum((i + j - mx - my) ** 4 * p) AS Pro FROM e GROUP BY ALL),
f AS (SELECT *, CASE WHEN vv > 1e-24 THEN c / sqrt(vv) ELSE 0 END AS Cor, sqrt(greatest(1 - exp(-2 * abs(hxy2 - Ent)), 0)) AS f13 FROM a)
SELECT vec_id, pair, {", ".join(R(f'"{h}"', f'"{h}"', 5) for h in HARALICK)} FROM f"""


@query(HARALICK_SQL)
def haralick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(texture.haralick(_pairs(spark, sf_dir), ["vec_id", "pair"]), *HARALICK, to=5)


# --- crops and outlines

@query()
def crop_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of the objects in painted frames: masks, shapes, textures, intensity dispersion, movement, density."""
    detections, outlines, frames = data.painted_frames(spark, sf_dir)
    out = features.extract_features(detections, outlines, frames)
    return rounded(out, *_doubles(out))


CROPS = """WITH RECURSIVE points AS (
  SELECT vec_id, i, greatest(round(40 + (20 + 10 * e[i + 1]) * cos(2 * pi() * i / 64))::INT, 0) AS x, greatest(round(40 + (20 + 10 * e[i + 1]) * sin(2 * pi() * i / 64))::INT, 0) AS y
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range(64)) AS i FROM embeddings)),
box AS (SELECT vec_id, min(x) AS l, max(x) AS r, min(y) AS t, max(y) AS b FROM points GROUP BY vec_id HAVING max(x) - min(x) + 1 >= 8 AND max(y) - min(y) + 1 >= 8),
edge AS (SELECT DISTINCT vec_id, x, y FROM points),
down AS (SELECT vec_id, x, min(y) AS lo, max(y) AS hi FROM edge GROUP BY ALL),
across AS (SELECT vec_id, y, min(x) AS lo, max(x) AS hi FROM edge GROUP BY ALL),
grid AS (SELECT vec_id, x, unnest(range(t, b + 1))::INT AS y FROM (SELECT vec_id, t, b, unnest(range(l, r + 1))::INT AS x FROM box)),
one AS (SELECT g.vec_id, g.x, g.y, CASE WHEN e.x IS NOT NULL THEN 0 WHEN d.lo IS NULL OR g.y < d.lo OR g.y > d.hi THEN -1 ELSE 1 END AS m
  FROM grid g LEFT JOIN edge e ON g.vec_id = e.vec_id AND g.x = e.x AND g.y = e.y LEFT JOIN down d ON g.vec_id = d.vec_id AND g.x = d.x),
two AS (SELECT o.vec_id, o.x, o.y, CASE WHEN o.m = 0 THEN 0 WHEN a.lo IS NULL THEN -o.m WHEN o.x < a.lo OR o.x > a.hi THEN -1 ELSE o.m END AS m
  FROM one o LEFT JOIN across a ON o.vec_id = a.vec_id AND o.y = a.y),
outside AS (SELECT vec_id, x, y FROM two WHERE m = -1
  UNION SELECT n.vec_id, n.x, n.y FROM outside f, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) s(dx, dy), two n WHERE n.vec_id = f.vec_id AND n.x = f.x + s.dx AND n.y = f.y + s.dy AND n.m = 1),
inside AS (SELECT vec_id, x, y FROM two ANTI JOIN outside USING (vec_id, x, y)),
painted AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings),
pixels AS (SELECT vec_id, CASE WHEN hi > lo AND r < 96 AND b < 96 THEN (e[((y * 96 + x) * 7 + y) % 64 + 1] - lo) * 255.0::DOUBLE / (hi - lo) END AS v FROM inside JOIN painted USING (vec_id) JOIN box USING (vec_id)),
filled AS (SELECT vec_id, count(*)::DOUBLE AS area, avg(v) AS mean, stddev_samp(v) AS sd, skewness(v) AS skew FROM pixels GROUP BY vec_id),
away AS (SELECT vec_id, cx, cy, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS d FROM (SELECT *, avg(x) OVER w AS cx, avg(y) OVER w AS cy FROM points WINDOW w AS (PARTITION BY vec_id))),
round_ AS (SELECT vec_id, first(cx) AS cx, first(cy) AS cy, avg(d) AS rad, var_samp(d) AS vfc FROM away GROUP BY vec_id)"""


@query(f"{CROPS} SELECT vec_id::INT AS FrameID, label AS CellID, {R('area', 'Area')}, {R('area / (64 * 64)', 'A2B')}, {R('rad', 'Rad')}, {R('vfc', 'VfC')}, {R('mean', 'FOmean')}, {R('sd', 'FOsd')}, {R('skew', 'FOskew', 4)}, {R('cx', 'xpos')}, {R('cy', 'ypos')} FROM filled JOIN round_ USING (vec_id) JOIN embeddings USING (vec_id)")
def crop_mask_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the same objects what SQL can follow: the mask filled from the outline, its area, and the pixels it holds."""
    detections, outlines, frames = data.painted_frames(spark, sf_dir)
    out = features.frame_crops(frames, detections, outlines).select("FrameID", "CellID", "Area", "A2B", "Rad", "VfC", "FOmean", "FOsd", "FOskew", "xpos", "ypos")
    return rounded(rounded(out, "Area", "A2B", "Rad", "VfC", "FOmean", "FOsd", "xpos", "ypos"), "FOskew", to=4)


CROWD = CROPS.replace(
    "painted AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings)",
    f"painted AS (SELECT vec_id, e, CASE WHEN count(*) OVER f < {data.CROWD} THEN least(min(lo) OVER f, 0) ELSE min(lo) OVER f END AS lo, CASE WHEN count(*) OVER f < {data.CROWD} THEN greatest(max(hi) OVER f, 0) ELSE max(hi) OVER f END AS hi "
    f"FROM (SELECT vec_id, embedding::DOUBLE[] AS e, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings) WINDOW f AS (PARTITION BY vec_id // {data.CROWD}))",
) + f""", tracks AS (SELECT (vec_id // {data.CROWD})::INT AS FrameID, (vec_id % {data.CROWD})::INT AS CellID, area AS Area, area / (64 * 64) AS A2B, rad AS Rad, vfc AS VfC, mean AS FOmean, sd AS FOsd, skew AS FOskew,
  cx + {data.TILE} * (vec_id % {data.CROWD} % {data.ROW}) AS xpos, cy + {data.TILE} * (vec_id % {data.CROWD} // {data.ROW}) AS ypos FROM filled JOIN round_ USING (vec_id)){MOVED.format(table="tracks", rate=0.5)},
near AS (SELECT a.FrameID, a.CellID, sum(1 / sqrt((a.xpos - b.xpos) ** 2 + (a.ypos - b.ypos) ** 2)) AS d FROM tracks a JOIN tracks b ON a.FrameID = b.FrameID AND a.CellID <> b.CellID AND sqrt((a.xpos - b.xpos) ** 2 + (a.ypos - b.ypos) ** 2) < 6 * a.Rad GROUP BY ALL)"""
CROWD_OUT = ["Dis", "Trac", "D2T", "Vel", "Rad", "VfC", "Area", "A2B", "FOmean", "FOsd", "xpos", "ypos", "dens"]


@query(f"{CROWD} SELECT FrameID, CellID, {', '.join(R(c, c) for c in CROWD_OUT[:-1])}, {R('FOskew', 'FOskew', 4)}, {R('coalesce(d, 0)', 'dens')} FROM moved LEFT JOIN near USING (FrameID, CellID)")
def crowd_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of twenty objects to a frame, followed from frame to frame: what SQL can follow of all of them."""
    detections, outlines, frames = data.crowded_frames(spark, sf_dir)
    out = features.extract_features(detections, outlines, frames, framerate=0.5)
    return rounded(rounded(out.select("FrameID", "CellID", *CROWD_OUT, "FOskew"), *CROWD_OUT), "FOskew", to=4)


# --- sources

@query("SELECT CAST(vec_id AS VARCHAR) AS ROI_filename, 64 AS n, i, x::INT AS x, y::INT AS y FROM (SELECT vec_id, i, round(40 + (20 + 10 * e[i + 1]) * cos(2 * pi() * i / 64)) AS x, round(40 + (20 + 10 * e[i + 1]) * sin(2 * pi() * i / 64)) AS y FROM (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range(64)) AS i FROM embeddings))")
def region_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines written as region files and read back, a row for each point."""
    spark.dataSource.register(files.RegionFiles)
    path = f"{shared_folder(spark)}/regions-{uuid.uuid4().hex}"
    data.painted_frames(spark, sf_dir)[1].write.format("regions").mode("append").save(path)
    back = spark.read.format("regions").load(path)
    return back.select("ROI_filename", "n", F.posexplode("coords").alias("i", "p")).select("ROI_filename", "n", F.col("i").cast("long").alias("i"), "p.x", "p.y")


@query(f"WITH {data.EVENT_TRACKS}, long AS (SELECT *, count(*) OVER (PARTITION BY CellID) AS n FROM tracks) SELECT FrameID, CellID::INT AS CellID, FrameID || '-' || CellID AS ROI_filename, {R('Volume', 'Volume')}, {R('Rad', 'Sphericity')} FROM long WHERE n >= {MIN_FRAMES}")
def tracking_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event tracks written as tracking tables and read back, short tracks left out."""
    spark.dataSource.register(files.PhaseFiles)
    path = f"{shared_folder(spark)}/phase-{uuid.uuid4().hex}"
    rows = data.event_tracks(spark, sf_dir).select("FrameID", F.col("CellID").cast("int").alias("CellID"), "ROI_filename", "Volume", F.col("Rad").alias("Sphericity"))
    rows.write.format("phase").mode("append").save(path)
    return rounded(tracking.read_phase(spark, f"{path}/part-*", MIN_FRAMES), "Volume", "Sphericity")


# --- intensity dispersion, outlines

IQ = """thresholds AS (SELECT vec_id, unnest(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS t, generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8, 9], 1)::INT AS k FROM pixels GROUP BY vec_id),
above AS (SELECT p.vec_id, k, x, y FROM pixels p JOIN thresholds USING (vec_id) WHERE v >= t),
d AS (SELECT a.vec_id, a.k, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM above a JOIN above b ON a.vec_id = b.vec_id AND a.k = b.k AND (a.y, a.x) < (b.y, b.x))"""


@query(f"WITH {data.PIXELS}, {IQ} SELECT vec_id, k, {R('var_samp(d) / avg(d)', 'IQ')} FROM d GROUP BY ALL")
def intensity_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IQ1..IQ9 of the embeddings as images, all pixels interior."""
    return rounded(texture.intensity_dispersion(data.images(spark, sf_dir), ["vec_id"]), "IQ")


@query(f"WITH {data.OUTLINES}, c AS (SELECT *, avg(x) OVER (PARTITION BY vec_id) AS cx, avg(y) OVER (PARTITION BY vec_id) AS cy FROM points), d AS (SELECT vec_id, cx, cy, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS d FROM c) SELECT vec_id, {R('avg(d)', 'Rad')}, {R('var_samp(d)', 'VfC')}, {R('first(cx)', 'xpos')}, {R('first(cy)', 'ypos')} FROM d GROUP BY vec_id")
def outline_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shape.centre(shape.radius(data.outlines(spark, sf_dir)))
    return rounded(out.drop("coords"), "Rad", "VfC", "xpos", "ypos")


@query(f"WITH {data.OUTLINES}, three AS (SELECT p.vec_id, p.x, p.y, b.x AS bx, b.y AS b_y, a.x AS ax, a.y AS ay FROM points p JOIN points b ON p.vec_id = b.vec_id AND b.i = (p.i + 60) % 64 JOIN points a ON p.vec_id = a.vec_id AND a.i = (p.i + 4) % 64) SELECT vec_id, {R('avg(sqrt((x - bx) ** 2 + (y - b_y) ** 2) + sqrt((x - ax) ** 2 + (y - ay) ** 2) - sqrt((ax - bx) ** 2 + (ay - b_y) ** 2))', 'Curv')} FROM three GROUP BY vec_id")
def outline_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shape.curvature(data.outlines(spark, sf_dir)).drop("coords"), "Curv")


BOX = f"""WITH {data.OUTLINES}, far AS (SELECT a.vec_id, atan2(a.y - b.y, a.x - b.x) AS t FROM points a JOIN points b ON a.vec_id = b.vec_id
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2 DESC, b.i, a.i) = 1),
turned AS (SELECT vec_id, cos(t) * x + sin(t) * y AS u, cos(t) * y - sin(t) * x AS w FROM points JOIN far USING (vec_id)),
ext AS (SELECT vec_id, max(u) - min(u) AS len, max(w) - min(w) AS wid, 1000.0 AS area FROM turned GROUP BY vec_id)"""


@query(f"{BOX} SELECT vec_id, {R('len', 'Len', 4)}, {R('wid', 'Wid', 4)}, {R('area / (64 * 64)', 'A2B')}, {R('len * wid / area', 'Box')}, {R('greatest(len, wid) / (len + wid)', 'Rect')} FROM ext")
def outline_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents and ratios of the outlines, for an area of 1000."""
    out = shape.ratios(shape.box(data.outlines(spark, sf_dir)).withColumn("Area", F.lit(1000)))
    return rounded(rounded(out.drop("coords", "Area"), "A2B", "Box", "Rect"), "Len", "Wid", to=4)


@query(f"{CROPS} SELECT vec_id, r - l + 1 AS width, b - t + 1 AS height FROM box WHERE r - l + 1 >= 45 AND b - t + 1 >= 45")
def outline_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines in whole pixels, moved into the image, that are at least 45 pixels wide and high."""
    _, outlines, _ = data.painted_frames(spark, sf_dir)
    large = tracks.large_enough(tracks.clamp(outlines), 45)
    extent = [(F.array_max(F.col("coords")[a]) - F.array_min(F.col("coords")[a]) + 1).alias(n) for a, n in (("x", "width"), ("y", "height"))]
    return large.select(F.col("ROI_filename").cast("long").alias("vec_id"), *extent)


CLAMPED = """WITH points AS (SELECT vec_id, greatest(round(40 + (20 + 10 * e[i + 1]) * cos(2 * pi() * i / 64))::INT - (vec_id % 50)::INT, 0) AS x, greatest(round(40 + (20 + 10 * e[i + 1]) * sin(2 * pi() * i / 64))::INT - (vec_id % 40)::INT, 0) AS y
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range(64)) AS i FROM embeddings)),
box AS (SELECT vec_id, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM points GROUP BY vec_id) SELECT vec_id, width, height FROM box WHERE width >= 30 AND height >= 35"""


@query(CLAMPED)
def outline_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines moved over the image's edge, whose negative coordinates become 0, as far as they stay large enough."""
    _, outlines, _ = data.painted_frames(spark, sf_dir)
    own = outlines.select(F.col("ROI_filename").cast("long").alias("vec_id"), "coords")
    moved = F.transform("coords", lambda p: F.struct((p["x"] - (F.col("vec_id") % 50).cast("int")).alias("x"), (p["y"] - (F.col("vec_id") % 40).cast("int")).alias("y")))
    kept = tracks.clamp(own.withColumn("coords", moved))
    extent = {n: F.array_max(F.col("coords")[a]) - F.array_min(F.col("coords")[a]) + 1 for a, n in (("x", "width"), ("y", "height"))}
    return tracks.large_enough(kept, 30).withColumns(extent).where("height >= 35").select("vec_id", "width", "height")


POLYGON = f"""WITH RECURSIVE {data.OUTLINES}, o AS (SELECT vec_id, list(x ORDER BY i) AS xs, list(y ORDER BY i) AS ys FROM points GROUP BY vec_id),
f AS (SELECT vec_id, list_position(d, list_max(d)) - 1 AS far FROM (SELECT vec_id, list_transform(range(1, 65), lambda i: (xs[i] - xs[1]) ** 2 + (ys[i] - ys[1]) ** 2) AS d FROM o)),
sides AS (SELECT vec_id, 0::BIGINT AS a, far::BIGINT AS b, far::BIGINT AS stop FROM f UNION ALL SELECT vec_id, far, 0, 63 FROM f),
parts AS (SELECT * FROM sides UNION ALL
  SELECT vec_id, CASE WHEN second THEN s ELSE a END, CASE WHEN second THEN b ELSE s END, CASE WHEN second THEN stop ELSE s END FROM (
    SELECT vec_id, a, b, stop, a + list_position(d, list_max(d)) AS s FROM (
      SELECT q.vec_id, a, b, stop, list_transform(range(a + 2, CASE WHEN b <> 0 THEN stop ELSE stop + 1 END + 1),
        lambda i: abs((xs[b + 1] - xs[a + 1]) * (ys[i] - ys[a + 1]) - (ys[b + 1] - ys[a + 1]) * (xs[i] - xs[a + 1])) / sqrt((xs[b + 1] - xs[a + 1]) ** 2 + (ys[b + 1] - ys[a + 1]) ** 2)) AS d
      FROM parts q JOIN o ON q.vec_id = o.vec_id WHERE stop - a > 4 AND (xs[b + 1] <> xs[a + 1] OR ys[b + 1] <> ys[a + 1])) WHERE list_max(d) > 2.5), (VALUES (false), (true)) t(second)),
c AS (SELECT vec_id, a, xs[a + 1] AS x, ys[a + 1] AS y, row_number() OVER (PARTITION BY vec_id ORDER BY a) - 1 AS r, count(*) OVER (PARTITION BY vec_id) AS n FROM (SELECT DISTINCT vec_id, a FROM parts) JOIN o USING (vec_id)),
three AS (SELECT p.vec_id, (p.x - q.x) ** 2 + (p.y - q.y) ** 2 AS a2, (q.x - s.x) ** 2 + (q.y - s.y) ** 2 AS b2, (p.x - s.x) ** 2 + (p.y - s.y) ** 2 AS c2
  FROM c p JOIN c q ON p.vec_id = q.vec_id AND q.r = (p.r + 1) % p.n JOIN c s ON p.vec_id = s.vec_id AND s.r = (p.r + 2) % p.n),
angles AS (SELECT vec_id, sqrt(a2) AS side, CASE WHEN abs(t - 1) > 0.001 THEN acos(greatest(-1, least(1, t))) ELSE 2 * pi() END AS angle FROM (SELECT *, (a2 + b2 - c2) / (2 * sqrt(a2 * b2)) AS t FROM three))
SELECT vec_id, {R('max(side)', 'poly1')}, {R('min(angle)', 'poly2')}, {R('var_samp(angle)', 'poly3')}, {R('var_samp(side)', 'poly4')} FROM angles GROUP BY vec_id"""


@query(POLYGON)
def outline_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shape.polygon(data.outlines(spark, sf_dir)).drop("coords")
    return rounded(out, "poly1", "poly2", "poly3", "poly4")


# --- segmentation errors

@query()
def seg_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both classes after oversampling the smaller one."""
    errors, correct, _ = data.judged_documents(spark, sf_dir)
    few, many, small, large = segmentation.training_set(errors, correct, "doc_id")
    return few.withColumn("class", F.lit(small)).unionByName(many.withColumn("class", F.lit(large)))


@query()
def seg_undersample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rows of the larger class as the smaller one has."""
    errors, correct, _ = data.judged_documents(spark, sf_dir)
    return segmentation.undersample(correct, errors.count(), draw=1)


NEIGHBOURS = f"""WITH v AS (SELECT n_chars::DOUBLE AS a, coalesce(len(regexp_extract_all(text, '[0-9]')), 0)::DOUBLE AS b, coalesce(len(regexp_extract_all(text, '[A-Z]')), 0)::DOUBLE AS c FROM documents JOIN labels USING (doc_id) WHERE quality = 0),
g AS (SELECT a, b, c, count(*) AS n FROM v GROUP BY ALL),
pairs AS (SELECT g.*, sqrt((g.a - h.a) ** 2 + (g.b - h.b) ** 2 + (g.c - h.c) ** 2) AS d, CASE WHEN g.a = h.a AND g.b = h.b AND g.c = h.c THEN h.n - 1 ELSE h.n END AS m FROM g, g h),
near AS (SELECT a, b, c, n, list(d ORDER BY d) AS ds FROM (SELECT a, b, c, n, d, unnest(range(least(m, 3))) AS i FROM pairs) GROUP BY ALL)
SELECT a AS n_chars, b AS n_digits, c AS n_upper, n, {R('ds[1]', 'd1')}, {R('ds[2]', 'd2')}, {R('ds[3]', 'd3')} FROM near"""


@query(NEIGHBOURS)
def seg_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the three nearest others of each different document of low quality are: what oversampling draws from."""
    names = ["n_chars", "n_digits", "n_upper"]
    errors = data.judged_documents(spark, sf_dir)[0].select(*names)
    near = segmentation.nearest_same_class(errors, names, 3, most=256)

    def away(i: int) -> Column:
        p = F.get("__near", F.lit(i))
        return F.sqrt(sum((F.pow(F.get(p, F.lit(j)) - F.col(f), F.lit(2.0)) for j, f in enumerate(names)), F.lit(0.0))).alias(f"d{i + 1}")

    return rounded(near.select(*names, F.col("__n").alias("n"), *map(away, range(3))), "d1", "d2", "d3")


FIRST_SPLIT = """WITH rows AS (SELECT n_chars::DOUBLE AS a, coalesce(len(regexp_extract_all(text, '[0-9]')), 0)::DOUBLE AS b, (quality = 0)::INT AS y FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1)),
v AS (SELECT 0 AS tree, 0 AS feature, a AS value, y FROM rows UNION ALL SELECT 1, 1, b, y FROM rows UNION ALL SELECT 2, 0, a, y FROM rows UNION ALL SELECT 2, 1, b, y FROM rows),
c AS (SELECT tree, feature, value, count(*) AS n, sum(y) AS o FROM v WHERE value IS NOT NULL GROUP BY ALL),
p AS (SELECT tree, feature, value, lead(value) OVER w AS next, sum(n) OVER w AS nl, sum(o) OVER w AS ol, sum(n) OVER (PARTITION BY tree, feature) AS na, sum(o) OVER (PARTITION BY tree, feature) AS oa FROM c WINDOW w AS (PARTITION BY tree, feature ORDER BY value)),
s AS (SELECT *, na - nl AS nr, oa - ol AS or_ FROM p WHERE next IS NOT NULL AND nl >= 5 AND na - nl >= 5),
g AS (SELECT *, -2 * (""" + " - ".join("({})".format(" + ".join(f"CASE WHEN {k} > 0 THEN {k} * ln({k}::DOUBLE / {n}) ELSE 0 END" for k in (o, f"({n} - {o})"))) for n, o in (("na", "oa"), ("nl", "ol"), ("nr", "or_"))) + f""") AS gain FROM s)
SELECT tree, feature, {R('gain', 'gain')}, {R('value / 2 + next / 2', 'at')}, nl::BIGINT AS n_left, ol::BIGINT AS ones_left, nr::BIGINT AS n_right, or_::BIGINT AS ones_right FROM g WHERE round(gain, 9) > 0 QUALIFY row_number() OVER (PARTITION BY tree ORDER BY round(gain, 9) DESC, feature, value) = 1"""


@query(FIRST_SPLIT)
def seg_first_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first split of trees on the judged documents: by one feature, by the other, and by both."""
    errors, correct, _ = data.judged_documents(spark, sf_dir)
    rows = errors.withColumn("y", F.lit(1)).unionByName(correct.withColumn("y", F.lit(0))).withColumn("w", F.lit(1))
    a, b, none = F.col("n_chars"), F.col("n_digits"), F.lit(None).cast("double")
    each = [rows.select(F.lit(t).alias("tree"), "y", "w", p.alias("a"), q.alias("b")) for t, (p, q) in enumerate(((a, none), (none, b), (a, b)))]
    found = trees.best_splits(trees.prepared(each[0].unionByName(each[1]).unionByName(each[2]), ["a", "b"]), 5)
    return rounded(found.select("tree", "feature", "gain", "at", "n_left", "ones_left", "n_right", "ones_right"), "gain", "at")


@query()
def seg_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.segmentation_errors(*data.judged_documents(spark, sf_dir), "doc_id", trees=5)


@query()
def seg_errors_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.segmentation_errors_ensemble(*data.judged_documents(spark, sf_dir), "doc_id", trees=4, repeats=3)


@query()
def seg_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors, correct, rows = data.judged_documents(spark, sf_dir)
    return tracks.drop_listed(rows, segmentation.segmentation_errors(errors, correct, rows, "doc_id", trees=5), "doc_id")


JUDGED = r"""WITH rows AS (SELECT doc_id, n_chars::DOUBLE AS n_chars, quality FROM documents JOIN labels USING (doc_id))"""


@query(f"{JUDGED} SELECT doc_id, {R('n_chars', 'n_chars')}, CASE quality WHEN 0 THEN 'segerror' ELSE 'correct' END AS class FROM rows WHERE quality IN (0, 1)")
def seg_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both labelled sets as one table with a class."""
    errors, correct, _ = data.judged_documents(spark, sf_dir, once=False)
    both = [df.select("doc_id", "n_chars", F.col("doc_id").alias("id")) for df in (errors, correct)]
    return rounded(segmentation.labelled(*both, "id"), "n_chars")


@query(f"{JUDGED}, n AS (SELECT count(*) FILTER (quality = 0) AS e, count(*) FILTER (quality = 1) AS c FROM rows) SELECT 'segerror' AS class, CASE WHEN e <= c THEN 2 * e ELSE e END AS n FROM n UNION ALL SELECT 'correct', CASE WHEN e <= c THEN c ELSE 2 * c END FROM n")
def seg_class_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each class after oversampling: the smaller class has a synthetic row for each of its own."""
    return seg_training_set(spark, sf_dir).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


RUNS = ["quality = 0", "toxic = 1", "doc_id % 3 = 0", "doc_id % 5 = 0"]


@query("SELECT doc_id FROM labels WHERE " + " + ".join(f"coalesce(({r})::INT, 0)" for r in RUNS) + f" >= {len(RUNS)} / 2")
def seg_named_by_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that at least half of several runs name; the runs are conditions on the labels."""
    labels = data.table(spark, sf_dir, "labels")
    return segmentation.ensemble([labels.where(r).select("doc_id") for r in RUNS], "doc_id")


@query(f"{JUDGED} SELECT doc_id, {R('n_chars', 'n_chars')} FROM (SELECT doc_id, n_chars::DOUBLE AS n_chars FROM documents) ANTI JOIN (SELECT doc_id FROM rows WHERE quality = 0) USING (doc_id)")
def seg_drop_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents but those of the listed ids."""
    errors, _, rows = data.judged_documents(spark, sf_dir, once=False)
    return rounded(tracks.drop_listed(rows, errors, "doc_id").select("doc_id", "n_chars"), "n_chars")


# --- populations

def _populations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = data.vectors(spark, sf_dir).withColumn("population", F.concat(F.lit("p"), F.col("label"))).drop("label")
    return rows.where("population in ('p0', 'p1')"), rows


@query()
def classify_lda(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _populations(spark, sf_dir)
    return classify.lda(train, test.drop("population"), "population", E64).select("vec_id", "LDA")


LDA_PAIR = """WITH v AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
s AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS xx, covar_pop(x, y) * count(*) AS xy, var_pop(y) * count(*) AS yy FROM v WHERE label IN (0, 1) GROUP BY label),
p AS (SELECT sum(n) AS n, sum(xx) / (sum(n) - 2) + 1e-6 AS a, sum(xy) / (sum(n) - 2) AS b, sum(yy) / (sum(n) - 2) + 1e-6 AS d FROM s),
w AS (SELECT label, ln(s.n / p.n) AS prior, mx, my, (d * mx - b * my) / (a * d - b * b) AS wx, (a * my - b * mx) / (a * d - b * b) AS wy FROM s, p)
SELECT vec_id, 'p' || arg_max(w.label, prior - 0.5 * (mx * wx + my * wy) + wx * x + wy * y) AS LDA FROM v, w GROUP BY vec_id"""


@query(LDA_PAIR)
def classify_lda_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on two features, where the discriminants can be written down."""
    train, test = _populations(spark, sf_dir)
    return classify.lda(train, test.drop("population"), "population", ["e0", "e1"]).select("vec_id", "LDA")


VOTES = [f"CASE WHEN e{i} > 0 THEN 'p0' ELSE 'p1' END" for i in range(3)]


@query("SELECT vec_id, CASE WHEN (embedding[1] > 0)::INT + (embedding[2] > 0)::INT + (embedding[3] > 0)::INT >= 2 THEN 'p0' ELSE 'p1' END AS Ensemble FROM embeddings")
def classify_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The majority of three votes; the votes are the signs of three features."""
    votes = data.vectors(spark, sf_dir).select("vec_id", *[F.expr(v).alias(n) for v, n in zip(VOTES, ("LDA", "RF", "SVM"), strict=True)])
    return classify.majority(votes, "p0", "p1").select("vec_id", "Ensemble")


@query()
def classify_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _populations(spark, sf_dir)
    return classify.random_forest(train, test.drop("population"), "population", E64).select("vec_id", "RF")


@query()
def classify_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _populations(spark, sf_dir)
    return classify.rbf_svm(train, test.drop("population"), "population", E64).select("vec_id", "SVM")


@query()
def classify_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _populations(spark, sf_dir)
    return classify.classify(train, test, "population", E64, "p0", "p1")


@query()
def cluster_ward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.heterogeneous_clusters(data.vectors(spark, sf_dir).drop("label"), "vec_id", 10)


def queries() -> dict[str, Q]:
    """Every query by name."""
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that SQL can express."""
    return dict(_sql)
