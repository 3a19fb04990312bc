"""Gaze geometry over landmark arrays (array<struct<x,y>>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def eye_aspect(points: Column, eye: list[int]) -> Column:
    """(|p2 p6| + |p3 p5|) / (2 |p1 p4|); 0 if the eye has no width or a point is missing."""
    p = [F.get(points, F.lit(i)) for i in eye]
    width = distance(p[0], p[3])
    return F.coalesce(F.try_divide(distance(p[1], p[5]) + distance(p[2], p[4]), 2.0 * width), F.lit(0.0))


def gaze(points: Column, left: list[int], right: list[int], irises: tuple[int, int], faces: Column | None = None) -> tuple[Column, Column, Column]:
    """Mean iris ratio, direction and confidence; eyes are their outer and inner corner first and fourth.

    No face gives away (0.9, ratio 0). Without iris points the direction is center (0.6), with an eye of no width too (0.5); a missing coordinate gives away (0.5).
    """
    corner = [F.get(points, F.lit(i)) for i in (left[0], left[3], right[0], right[3])]
    iris = [F.get(points, F.lit(i)) for i in irises]
    widths = distance(corner[0], corner[1]), distance(corner[2], corner[3])
    ratio = (F.try_divide(distance(iris[0], corner[0]), widths[0]) + F.try_divide(distance(iris[1], corner[2]), widths[1])) / 2
    few, flat = F.size(points) <= max(irises), (widths[0] == 0) | (widths[1] == 0)
    direction = F.when(few | flat, "center").when(ratio.isNull(), "away").when(ratio < 0.35, "right").when(ratio > 0.65, "left").otherwise("center")
    confidence = F.when(few, 0.6).when(flat | ratio.isNull(), 0.5).when((ratio < 0.35) | (ratio > 0.65), 0.8).otherwise(0.9)
    if faces is None:
        return ratio, direction, confidence
    none = faces == 0
    return F.when(none, 0.0).otherwise(ratio), F.when(none, "away").otherwise(direction), F.when(none, 0.9).otherwise(confidence)


def unreadable() -> tuple[Column, Column, Column]:
    """Direction, confidence and looking_away of an image that can't be decoded."""
    return F.lit("away"), F.lit(0.0), F.lit(True)


def looking_away(direction: Column, confidence: Column, faces: Column) -> Column:
    """Away, unsure, more than one face, or none."""
    return (direction == "away") | (confidence < 0.5) | (faces != 1)
