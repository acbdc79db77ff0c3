"""Frame names and media time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = r"^(.+)-(\d+)-(\d+)\.[A-Za-z]+$"


def parse_name(name: Column) -> Column:
    """video, scene_id and frame_idx of `video-scene-frame.ext`, read from the right (videos may hold hyphens); null if malformed."""
    part = lambda i: F.regexp_extract(name, NAME, i)
    return F.when(name.rlike(NAME), F.struct(part(1).alias("video"), part(2).cast("int").alias("scene_id"), part(3).cast("int").alias("frame_idx")))


def basename(url: Column) -> Column:
    """The last segment of a path; null without a slash or a dot."""
    return F.when(F.contains(url, F.lit("/")) & F.contains(url, F.lit(".")), F.element_at(F.split(url, "/"), -1))


def relative_path(url: Column) -> Column:
    """What follows `/static/` in a url, or else its last segment; null for a url that ends in a slash."""
    at = F.locate("/static/", url)
    last = F.element_at(F.split(url, "/"), -1)
    return F.when(last != "", F.when(at > 0, F.substr(url, at + len("/static/"), F.length(url))).otherwise(last))


def clock(frame: Column, fps: Column) -> Column:
    """HH:MM:SS.mmm of a frame; empty for an unknown rate or a negative frame."""
    ms = F.floor(frame / fps * 1000)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat(two(F.floor(ms / 3600000)), F.lit(":"), two(F.floor(ms / 60000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))
    return F.when((fps > 0) & (frame >= 0), text).otherwise("")


def to_ms(frame: Column, fps: Column) -> Column:
    return F.bround(frame / fps * 1000).cast("long")


def to_frame(ms: Column, fps: Column) -> Column:
    return F.bround(ms / 1000 * fps).cast("long")


def moment(position: Column, length: Column, start: Column, end: Column) -> Column:
    """Estimated second of a character of a window's text; the middle for an empty text."""
    share = F.when(length > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), position / length))).otherwise(0.5)
    return start + share * (end - start)
