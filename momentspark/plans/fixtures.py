"""Views of the retrieval data model over the driver's tables, in Spark and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MODELS = {"full": (1, 64), "low": (1, 32), "high": (33, 32)}
WEIGHTS = {"full": 0.5, "low": 0.3, "high": 0.2}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that lies in fewer splits than there are cores (a small file), dealt over the cores; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, name, video, scene_id, pos, frame_idx, fps, embedding: a label is a video, its vectors in order are frames."""
    pos = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long") - 1
    e = read(spark, sf_dir, "embeddings").withColumn("pos", pos).withColumn("video", F.concat(F.lit("L21_V"), F.lpad(F.col("label").cast("string"), 3, "0")))
    e = e.withColumn("scene_id", F.floor(F.col("pos") / 4)).withColumn("frame_idx", F.col("pos") * 40).withColumn("fps", F.when(F.col("label") % 2 == 0, 25.0).otherwise(30.0))
    name = F.concat("video", F.lit("-"), F.lpad(F.col("scene_id").cast("string"), 4, "0"), F.lit("-"), F.col("frame_idx").cast("string"), F.lit(".jpg"))
    return e.select("vec_id", name.alias("name"), "video", "scene_id", "pos", "frame_idx", "fps", "embedding")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, vec_id, name, video, pos, vec, for three models."""
    parts = F.array(*[F.struct(F.lit(m).alias("model"), F.slice("embedding", a, n).alias("vec")) for m, (a, n) in MODELS.items()])
    return keyframes(spark, sf_dir).select("vec_id", "name", "video", "pos", F.inline(parts))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, model, qvec: every vector whose id is divisible by 20."""
    return vectors(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "model", F.col("vec").alias("qvec"))


def event_groups(spark: SparkSession, sf_dir: str, n_events: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What `event_scores` is made of: groups (group_id, video), events (group_id, event, qvec) and frames (video, frame_idx, fps, vec)."""
    k = keyframes(spark, sf_dir)
    groups = k.where("vec_id % 20 = 0").select(F.col("vec_id").alias("group_id"), "video")
    events = groups.select("group_id", F.posexplode(F.sequence(F.col("group_id"), F.col("group_id") + n_events - 1)).alias("event", "vec_id"))
    events = events.join(k.select("vec_id", F.col("embedding").alias("qvec")), "vec_id").drop("vec_id")
    return groups, events, k.select("video", "frame_idx", "fps", F.col("embedding").alias("vec"))


def event_best(spark: SparkSession, sf_dir: str, n: int, n_events: int = 3) -> DataFrame:
    """The n best frames of each event of `event_scores`, with rank, without a table of all scores: group_id, event, video, name, frame_idx, score, rank."""
    from momentspark.operators.search import top_m

    k = keyframes(spark, sf_dir)
    groups = k.where("vec_id % 20 = 0").select(F.col("vec_id").alias("group_id"), "video")
    events = groups.select("group_id", "video", F.posexplode(F.sequence(F.col("group_id"), F.col("group_id") + n_events - 1)).alias("event", "vec_id"))
    asked = events.join(k.select("vec_id", F.col("embedding").alias("qvec")), "vec_id").select((F.col("group_id") * n_events + F.col("event")).alias("query_id"), F.col("video").alias("model"), "qvec")
    found = top_m(k.select(F.col("video").alias("model"), "name", "video", F.col("frame_idx").alias("pos"), F.col("embedding").alias("vec")), asked, n, tie="pos")
    return found.select(F.floor(F.col("query_id") / n_events).alias("group_id"), (F.col("query_id") % n_events).cast("int").alias("event"), "video", "name", F.col("pos").alias("frame_idx"), "score", "rank")


def scores_after_best(spark: SparkSession, sf_dir: str, reach: int, n_events: int = 3) -> DataFrame:
    """Of `event_scores`, what a greedy alignment looks at: the best frame of event 0 and, of later events, frames up to `reach` frames behind it."""
    from momentspark.functions.vectors import dot

    k = keyframes(spark, sf_dir).withColumn("bucket", F.floor(F.col("frame_idx") / reach))
    first = event_best(spark, sf_dir, 1, 1).join(k.select("name", "fps"), "name").select("group_id", "event", "video", "name", "frame_idx", "fps", "score")
    asked = first.select("group_id", "video", F.col("frame_idx").alias("start"), F.posexplode(F.sequence(F.col("group_id") + 1, F.col("group_id") + n_events - 1)).alias("event", "vec_id"))
    asked = asked.join(k.select("vec_id", F.col("embedding").alias("qvec")), "vec_id").withColumn("event", F.col("event") + 1)
    asked = asked.withColumn("bucket", F.explode(F.array(F.floor(F.col("start") / reach), F.floor(F.col("start") / reach) + 1)))
    later = asked.drop("vec_id").join(k, ["video", "bucket"]).where("frame_idx > start and frame_idx <= start + %d" % reach)
    later = later.select("group_id", "event", "video", "name", "frame_idx", "fps", F.round(dot(F.col("qvec"), F.col("embedding")), 6).alias("score"))
    return first.unionByName(later)


def event_scores(spark: SparkSession, sf_dir: str, n_events: int = 3) -> DataFrame:
    """group_id, event, video, name, frame_idx, fps, pos, anchor_pos, score: each query's frame and those with the next ids are
    the events of a group, scored against all frames of the query's video."""
    from momentspark.functions.vectors import dot

    k = keyframes(spark, sf_dir)
    groups = k.where("vec_id % 20 = 0").select(F.col("vec_id").alias("group_id"), "video", F.col("pos").alias("anchor_pos"))
    events = groups.select("group_id", "video", "anchor_pos", F.posexplode(F.sequence(F.col("group_id"), F.col("group_id") + n_events - 1)).alias("event", "vec_id"))
    asked = events.join(k.select("vec_id", F.col("embedding").alias("qvec")), "vec_id")
    scored = asked.join(k.drop("vec_id"), "video").withColumn("score", F.round(dot(F.col("qvec"), F.col("embedding")), 6))
    return scored.select("group_id", "event", "video", "name", "frame_idx", "fps", "pos", "anchor_pos", "score")


KEYFRAMES = """kf AS (SELECT vec_id, label, embedding, 'L21_V' || lpad(CAST(label AS VARCHAR), 3, '0') AS video,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings),
keyframes AS (SELECT vec_id, video, pos, pos // 4 AS scene_id, pos * 40 AS frame_idx, CASE WHEN label % 2 = 0 THEN 25.0::DOUBLE ELSE 30.0::DOUBLE END AS fps,
  video || '-' || lpad(CAST(pos // 4 AS VARCHAR), 4, '0') || '-' || CAST(pos * 40 AS VARCHAR) || '.jpg' AS name, embedding FROM kf)"""
VECTORS = KEYFRAMES + """,
vectors AS (SELECT 'full' AS model, vec_id, name, video, pos, CAST(embedding AS DOUBLE[]) AS vec FROM keyframes
  UNION ALL SELECT 'low', vec_id, name, video, pos, CAST(embedding[1:32] AS DOUBLE[]) FROM keyframes
  UNION ALL SELECT 'high', vec_id, name, video, pos, CAST(embedding[33:64] AS DOUBLE[]) FROM keyframes),
queries AS (SELECT vec_id AS query_id, model, vec AS qvec FROM vectors WHERE vec_id % 20 = 0)"""
SCORES = KEYFRAMES + """,
groups AS (SELECT vec_id AS group_id, video, pos AS anchor_pos FROM keyframes WHERE vec_id % 20 = 0),
asked AS (SELECT g.*, e.event, CAST(k.embedding AS DOUBLE[]) AS qvec FROM groups g, (SELECT unnest([0, 1, 2]) AS event) e, keyframes k WHERE k.vec_id = g.group_id + e.event),
scored AS (SELECT a.group_id, a.event, a.video, k.name, k.frame_idx, k.fps, k.pos, a.anchor_pos,
  round(list_dot_product(a.qvec, CAST(k.embedding AS DOUBLE[])), 6) AS score FROM asked a JOIN keyframes k ON k.video = a.video)"""
