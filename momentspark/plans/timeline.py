"""Registered queries along the time line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from momentspark.functions import media
from momentspark.operators import timeline as tl

from . import fixtures as fx
from .fixtures import read


def windows(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, video, start_s, end_s, text: documents of a source follow each other every 45 s and last 60 s; the text names the language and length."""
    k = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    start = (k * 45).cast("double")
    return read(spark, d, "documents").select("doc_id", F.col("source").alias("video"), start.alias("start_s"), (start + 60).alias("end_s"), F.concat_ws(":", "lang", F.col("n_chars").cast("string")).alias("text"))


def _spoken(spark: SparkSession, d: str) -> DataFrame:
    """The windows, with videos named as those of the keyframes."""
    label = F.regexp_extract("video", r"(\d+)$", 1).cast("int") % 10
    return windows(spark, d).withColumn("video", F.concat(F.lit("L21_V"), F.lpad(label.cast("string"), 3, "0")))


def _frame_scores(spark: SparkSession, d: str) -> DataFrame:
    """video, frame_idx, p: each user's events in order, p between 0 and 1 from the value's fraction."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    return read(spark, d, "events").select(F.col("user_id").cast("string").alias("video"), k.alias("frame_idx"), F.round(F.col("value") - F.floor("value"), 2).alias("p"))


def asr_interval_join(spark: SparkSession, d: str) -> DataFrame:
    frames = fx.keyframes(spark, d).withColumn("t", F.col("frame_idx") / F.col("fps"))
    return tl.interval_join(frames, _spoken(spark, d))


def nearest_keyframe(spark: SparkSession, d: str) -> DataFrame:
    k = fx.keyframes(spark, d)
    probes = _spoken(spark, d).join(k.select("video", "fps").distinct(), "video").select("video", "doc_id", (F.col("start_s") * F.col("fps")).alias("x"))
    return tl.nearest(probes, k).select("video", "doc_id", F.col("nearest.name").alias("name"))


def floor_ceil_keyframe(spark: SparkSession, d: str) -> DataFrame:
    k = fx.keyframes(spark, d)
    probes = _spoken(spark, d).join(k.select("video", "fps").distinct(), "video").select("video", "doc_id", (F.col("start_s") * F.col("fps")).alias("x"))
    return tl.around(probes, k).select("video", "doc_id", F.col("before.name").alias("before"), F.col("after.name").alias("after"))


def neighbor_list(spark: SparkSession, d: str) -> DataFrame:
    return tl.neighbor_list(fx.keyframes(spark, d)).withColumn("neighbors", F.array_join("neighbors", ","))


def chunk_average(spark: SparkSession, d: str) -> DataFrame:
    s = _frame_scores(spark, d)
    start = F.explode(F.array_distinct(F.array(F.floor(F.col("frame_idx") / 10) * 10, F.greatest(F.lit(0), F.floor((F.col("frame_idx") - 5) / 10) * 10 + 5))))
    chunks = s.withColumn("start", start).groupBy("video", "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "p"))), lambda x: x["p"] + F.when(F.col("start") % 10 == 5, 0.25).otherwise(0.0)).alias("p"))
    first = s.withColumn("start", start).groupBy("video", "start").agg(F.min("frame_idx").alias("first"))
    return tl.average_chunks(chunks.join(first, ["video", "start"]).select("video", F.col("first").alias("start"), "p")).select("video", "frame_idx", F.round("p", 6).alias("p"))


def cut_islands(spark: SparkSession, d: str) -> DataFrame:
    return tl.cut_runs(_frame_scores(spark, d))


def cut_prune(spark: SparkSession, d: str) -> DataFrame:
    return tl.prune_cuts(tl.cut_runs(_frame_scores(spark, d), 0.7))


def cut_scenes(spark: SparkSession, d: str) -> DataFrame:
    s = _frame_scores(spark, d)
    return tl.scenes(tl.cut_runs(s, 0.9), s.groupBy("video").agg(F.count(F.lit(1)).alias("n_frames")), least=4)


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as scenes: from the order's key on, as many frames as its price in hundreds; 25 or 30 frames a second."""
    o = read(spark, d, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("video"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + F.floor(F.col("o_totalprice") / 100)).alias("end"), F.when(F.col("o_orderkey") % 2 == 0, 25.0).otherwise(30.0).alias("fps"))


def scene_sampling(spark: SparkSession, d: str) -> DataFrame:
    return tl.sample_scenes(_scenes(spark, d)).select("video", "n", "frame_idx")


def scene_statistics(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("end") - F.col("start") + 1
    return _scenes(spark, d).groupBy("fps").agg(F.min(n).alias("shortest"), F.percentile(n, F.lit(0.5)).alias("median"), F.round(F.avg(n), 6).alias("mean"), F.max(n).alias("longest"), F.count(F.lit(1)).alias("n_scenes"))


def interval_merge(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    points = e.select(F.col("user_id").cast("string").alias("video"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("name"), F.unix_seconds(F.date_trunc("second", "ts")).cast("double").alias("t"), F.col("value").alias("score"))
    return tl.merge_intervals(points, 7200.0)


def near_dup_scene(spark: SparkSession, d: str) -> DataFrame:
    return tl.drop_near_frames(fx.keyframes(spark, d).withColumnRenamed("embedding", "vec"), 0.15)


def offline_frames(spark: SparkSession, d: str) -> DataFrame:
    """The offline build: scores averaged over chunks, to cuts, pruned, to scenes, to sampled frames with names, times and neighbours."""
    s = chunk_average(spark, d)
    cuts = tl.prune_cuts(tl.cut_runs(s, 0.9), 5)
    made = tl.scenes(cuts, s.groupBy("video").agg(F.count(F.lit(1)).alias("n_frames")), least=4).withColumn("fps", F.lit(1.0))
    sampled = tl.sample_scenes(made)
    scene = F.dense_rank().over(Window.partitionBy("video").orderBy("start")) - 1
    named = sampled.withColumn("scene_id", scene)
    named = named.select("video", "scene_id", "frame_idx", F.format_string("%s-%04d-%d.jpg", "video", "scene_id", "frame_idx").alias("name"), media.clock(F.col("frame_idx"), F.lit(1.0)).alias("clock"))
    return named.join(tl.neighbor_list(named).withColumn("neighbors", F.array_join("neighbors", ",")), ["video", "name"])


SPOKEN = """windows AS (SELECT doc_id, 'L21_V' || lpad(CAST(CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % 10 AS VARCHAR), 3, '0') AS video,
  (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) * 45.0::DOUBLE AS start_s, concat_ws(':', lang, CAST(n_chars AS VARCHAR)) AS text FROM documents)"""
PROBES = SPOKEN + ", probes AS (SELECT w.video, w.doc_id, w.start_s * k.fps AS x FROM windows w JOIN (SELECT DISTINCT video, fps FROM keyframes) k USING (video))"
FRAME_SCORES = "s AS (SELECT CAST(user_id AS VARCHAR) AS video, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, round(value - floor(value), 2) AS p FROM events)"


def _runs(threshold: float) -> str:
    return f"""{FRAME_SCORES}, r AS (SELECT *, frame_idx - sum(CAST(p >= {threshold} AS INT)) OVER (PARTITION BY video ORDER BY frame_idx) AS island FROM s),
runs AS (SELECT video, row_number() OVER (PARTITION BY video ORDER BY min(frame_idx)) AS run, first(frame_idx ORDER BY p DESC, frame_idx) AS pos, max(p) AS p, count(*) AS n FROM r WHERE p >= {threshold} GROUP BY video, island)"""


def _pruned(gap: int) -> str:
    """Over `runs`: pruned (video, pos, p), by a recursion over each video's runs."""
    row = "{'pos': r.pos, 'p': r.p}"
    return f"""walk AS (SELECT DISTINCT video, 0::BIGINT AS i, []::STRUCT(pos BIGINT, p DOUBLE)[] AS k FROM runs
  UNION ALL SELECT w.video, w.i + 1, CASE WHEN len(k) = 0 OR r.pos - k[len(k)].pos >= {gap} THEN list_append(k, {row}) WHEN r.p > k[len(k)].p THEN list_append(k[:len(k) - 1], {row}) ELSE k END FROM walk w JOIN runs r ON r.video = w.video AND r.run = w.i + 1),
pruned AS (SELECT video, k.pos AS pos, k.p AS p FROM (SELECT video, unnest(k) AS k FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY video ORDER BY i DESC) = 1)))"""


SCENES = "scenes AS (SELECT o_orderkey, o_orderkey AS start, o_orderkey + CAST(floor(o_totalprice / 100) AS BIGINT) AS \"end\", CASE WHEN o_orderkey % 2 = 0 THEN 25.0::DOUBLE ELSE 30.0::DOUBLE END AS fps FROM orders)"
QUERIES = {f.__name__: f for f in (asr_interval_join, nearest_keyframe, floor_ceil_keyframe, neighbor_list, chunk_average, cut_islands, cut_prune, cut_scenes, scene_sampling, scene_statistics, interval_merge, near_dup_scene, offline_frames)}
ORACLE_SQL = {
    "asr_interval_join": f"""WITH {fx.KEYFRAMES}, {SPOKEN}, m AS (SELECT k.video, k.name, w.start_s, w.doc_id, w.text FROM keyframes k JOIN windows w ON w.video = k.video AND k.frame_idx / k.fps BETWEEN w.start_s - 5 AND w.start_s + 65),
        f AS (SELECT *, row_number() OVER (PARTITION BY name, text ORDER BY start_s, doc_id) AS k FROM m)
        SELECT video, name, count(*) AS n_windows, string_agg(text, ' ' ORDER BY start_s, doc_id) FILTER (k = 1) AS text FROM f GROUP BY video, name""",
    "nearest_keyframe": f"""WITH {fx.KEYFRAMES}, {PROBES} SELECT p.video, p.doc_id, k.name FROM probes p JOIN keyframes k USING (video) QUALIFY row_number() OVER (PARTITION BY p.doc_id ORDER BY abs(k.frame_idx - p.x), k.frame_idx) = 1""",
    "floor_ceil_keyframe": f"""WITH {fx.KEYFRAMES}, {PROBES} SELECT p.video, p.doc_id, max_by(k.name, k.frame_idx) FILTER (k.frame_idx <= p.x) AS before, min_by(k.name, k.frame_idx) FILTER (k.frame_idx >= p.x) AS after FROM probes p JOIN keyframes k USING (video) GROUP BY p.video, p.doc_id""",
    "neighbor_list": f"""WITH {fx.KEYFRAMES} SELECT k.video, k.name, coalesce(string_agg(o.name, ',' ORDER BY o.pos), '') AS neighbors FROM keyframes k LEFT JOIN keyframes o ON o.video = k.video AND abs(o.pos - k.pos) BETWEEN 1 AND 3 GROUP BY k.video, k.name""",
    "chunk_average": f"WITH {FRAME_SCORES} SELECT video, frame_idx, round(CASE WHEN frame_idx < 5 THEN p ELSE (p + (p + 0.25)) / 2 END, 6) AS p FROM s",
    "cut_islands": f"WITH {_runs(0.5)} SELECT video, run, pos, p, n FROM runs",
    "near_dup_scene": f"""WITH RECURSIVE {fx.KEYFRAMES}, f AS (SELECT video, scene_id, frame_idx, name, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY video, scene_id ORDER BY frame_idx) AS i FROM keyframes),
        walk AS (SELECT DISTINCT video, scene_id, 0::BIGINT AS i, []::STRUCT(i BIGINT, v DOUBLE[])[] AS k FROM f UNION ALL SELECT w.video, w.scene_id, w.i + 1,
          CASE WHEN len(k) = 0 OR list_max(list_transform(k, lambda x: list_cosine_similarity(x.v, f.v))) < 0.15 THEN list_append(k, {{'i': f.i, 'v': f.v}}) ELSE k END FROM walk w JOIN f ON f.video = w.video AND f.scene_id = w.scene_id AND f.i = w.i + 1),
        done AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY video, scene_id ORDER BY i DESC) = 1),
        more AS (SELECT f.video, f.scene_id, f.i FROM done d JOIN f USING (video, scene_id) WHERE len(d.k) = 1 AND f.i <> d.k[1].i QUALIFY row_number() OVER (PARTITION BY f.video, f.scene_id ORDER BY list_cosine_similarity(d.k[1].v, f.v), f.i) = 1),
        kept AS (SELECT video, scene_id, unnest(list_transform(k, lambda x: x.i)) AS i FROM done UNION ALL SELECT * FROM more)
        SELECT video, scene_id, frame_idx, name FROM f JOIN kept USING (video, scene_id, i)""",
    "cut_prune": f"WITH RECURSIVE {_runs(0.7)}, {_pruned(12)} SELECT video, pos, p FROM pruned",
    "offline_frames": f"""WITH RECURSIVE {_runs(0.9).replace("s AS (SELECT", "s0 AS (SELECT", 1).replace(", r AS (", ", s AS (SELECT video, frame_idx, round(CASE WHEN frame_idx < 5 THEN p ELSE (p + (p + 0.25)) / 2 END, 6) AS p FROM s0), r AS (", 1)}, {_pruned(5)},
        e AS (SELECT video, pos AS "end" FROM pruned UNION SELECT video, count(*) - 1 FROM s GROUP BY video), b AS (SELECT video, coalesce(lag("end") OVER (PARTITION BY video ORDER BY "end") + 1, 0) AS start, "end" FROM e),
        l AS (SELECT *, "end" - start + 1 AS len, dense_rank() OVER (PARTITION BY video ORDER BY start) - 1 AS scene_id FROM b WHERE "end" - start + 1 >= 4),
        n AS (SELECT *, CAST(greatest(2, least(40, CASE WHEN len <= 2 THEN 2 ELSE 2 + ceil((len - 2) / 2) END)) AS INT) AS n FROM l), m AS (SELECT *, least(3, floor((len - n) / 2)) AS m FROM n),
        f AS (SELECT video, scene_id, unnest(CASE WHEN len <= n THEN range(start, "end" + 1) ELSE list_transform(range(0, n), lambda i: CAST(floor(start + m + i * ("end" - start - 2 * m) / (n - 1)) AS BIGINT)) END) AS frame_idx FROM m),
        g AS (SELECT *, video || '-' || lpad(scene_id::VARCHAR, 4, '0') || '-' || frame_idx || '.jpg' AS name, row_number() OVER (PARTITION BY video ORDER BY frame_idx) AS pos FROM f)
        SELECT video, name, scene_id, frame_idx, lpad((frame_idx // 3600)::VARCHAR, 2, '0') || ':' || lpad((frame_idx // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((frame_idx % 60)::VARCHAR, 2, '0') || '.000' AS clock,
          coalesce((SELECT string_agg(o.name, ',' ORDER BY o.pos) FROM g o WHERE o.video = g.video AND abs(o.pos - g.pos) BETWEEN 1 AND 3), '') AS neighbors FROM g""",
    "cut_scenes": f"""WITH {_runs(0.9)}, e AS (SELECT video, pos AS "end" FROM runs UNION SELECT video, count(*) - 1 FROM s GROUP BY video),
        b AS (SELECT video, coalesce(lag("end") OVER (PARTITION BY video ORDER BY "end") + 1, 0) AS start, "end" FROM e) SELECT * FROM b WHERE "end" - start + 1 >= 4""",
    "scene_sampling": f"""WITH {SCENES}, l AS (SELECT *, "end" - start + 1 AS len, CASE WHEN fps = 25 THEN 42 ELSE 50 END AS base, fps * 2 AS more FROM scenes),
        n AS (SELECT *, CAST(greatest(2, least(40, CASE WHEN len <= base THEN 2 ELSE 2 + ceil((len - base) / more) END)) AS INT) AS n FROM l),
        m AS (SELECT *, least(3, floor((len - n) / 2)) AS m FROM n)
        SELECT CAST(o_orderkey AS VARCHAR) AS video, n, unnest(CASE WHEN len <= n THEN range(start, "end" + 1) ELSE list_transform(range(0, n), lambda i: CAST(floor(start + m + i * ("end" - start - 2 * m) / (n - 1)) AS BIGINT)) END) AS frame_idx FROM m""",
    "scene_statistics": f"""WITH {SCENES}, l AS (SELECT fps, "end" - start + 1 AS n FROM scenes) SELECT fps, min(n) AS shortest, quantile_cont(n, 0.5) AS median, round(avg(n), 6) AS mean, max(n) AS longest, count(*) AS n_scenes FROM l GROUP BY fps""",
    "interval_merge": """WITH p AS (SELECT CAST(user_id AS VARCHAR) AS video, lpad(CAST(event_id AS VARCHAR), 12, '0') AS name, CAST(epoch(date_trunc('second', ts)) AS DOUBLE) AS t, value AS score FROM events),
        q AS (SELECT *, greatest(0.0, t - 7200) AS a, t + 7200 AS z FROM p),
        r AS (SELECT *, max(z) OVER (PARTITION BY video ORDER BY a, z, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM q),
        i AS (SELECT *, sum(CAST(reach IS NULL OR a > reach + 1e-6 AS INT)) OVER (PARTITION BY video ORDER BY a, z, name) AS island FROM r)
        SELECT video, min(a) AS start, max(z) AS "end", count(*) AS n, first(name ORDER BY score DESC, t, name) AS best_name FROM i GROUP BY video, island""",
}
