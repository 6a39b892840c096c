"""File names, class labels and label-line text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doorlens.functions.geometry import c


def stem(file_name="file_name") -> Column:
    """File name without directory and last extension."""
    base = F.regexp_extract(c(file_name), r"([^/\\]*)$", 1)
    return F.regexp_replace(base, r"(.)\.[^.]*$", "$1")


def scene_key(file_name="file_name", frames_per_segment: int = 30) -> Column:
    """Scene of an image: video frames by segment, then dash tails, then digit tails, else the whole stem."""
    return scene_of_stem(stem(file_name), frames_per_segment)


def scene_of_stem(name: Column, frames_per_segment: int = 30) -> Column:
    video = r"^(.*?_Video Project)_([0-9]+)$"
    segment = F.floor(F.regexp_extract(name, video, 2).cast("bigint") / frames_per_segment).cast("string")
    padded = F.when(F.length(segment) < 3, F.lpad(segment, 3, "0")).otherwise(segment)
    return (
        F.when(name.rlike(video), F.concat(F.regexp_extract(name, video, 1), F.lit("_seg"), padded))
        .when(name.rlike(r"^.*?-[a-zA-Z0-9]+$"), F.regexp_extract(name, r"^(.*?)-[a-zA-Z0-9]+$", 1))
        .when(name.rlike(r"^.*?_[0-9]+$"), F.regexp_extract(name, r"^(.*?)_[0-9]+$", 1))
        .otherwise(name)
    )


def norm_label(label="label") -> Column:
    s = F.lower(F.trim(c(label)))
    return F.when(s.isin("open", "close"), s).otherwise("unknown")


def contact_state(label="label") -> Column:
    return F.when(c(label) == "close", "contact").when(c(label) == "open", "separated").otherwise("unknown")


def class_name(cls_id="cls_id") -> Column:
    return F.when(c(cls_id) == 0, "open").when(c(cls_id) == 1, "close").otherwise("unknown")


def class_id(name="label") -> Column:
    return F.when(c(name) == "open", 0).when(c(name) == "close", 1)


def strip_bom(line="line") -> Column:
    return F.regexp_replace(c(line), "^\\uFEFF", "")


def replay_name(category: Column, file_name="file_name") -> Column:
    return F.concat(F.lit("replay_"), category, F.lit("_"), c(file_name))


def boost_name(file_name="file_name") -> Column:
    return F.concat(F.lit("boost_open_"), c(file_name))


def mined_name(tier: Column, file_name="file_name") -> Column:
    return F.concat(F.lit("m072_"), tier, F.lit("_"), c(file_name))


def augmented_name(file_name: Column, profile: Column, index: Column) -> Column:
    return augmented_stem(stem(file_name), profile, index)


def augmented_stem(name: Column, profile: Column, index: Column) -> Column:
    return F.concat(name, F.lit("_"), profile, F.lit("_aug_"), index.cast("string"))


def frame_name(video: Column, index: Column) -> Column:
    return F.concat(stem(video), F.lit("_f"), index.cast("string"), F.lit(".jpg"))


def box_line(cls: Column, cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """One label line: class and four numbers with six decimals."""
    return F.format_string("%d %.6f %.6f %.6f %.6f", cls, cx, cy, w, h)


def fmt_run_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def frame_ts(index="frame_seq", ms_per_frame: int = 33) -> Column:
    return c(index) * ms_per_frame


def fps(total_ms: Column) -> Column:
    return F.when(total_ms > 0, F.lit(1000.0) / total_ms).otherwise(F.lit(0.0))
