"""Planar points as ``struct<x,y>``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def point_eq(p: Column, q: Column) -> Column:
    return p == q


def dist(p: Column, q: Column) -> Column:
    dx, dy = p["x"] - q["x"], p["y"] - q["y"]
    return F.sqrt(dx * dx + dy * dy)


def avg_point(p: Column) -> Column:
    """Componentwise mean; null points are skipped and an empty group gives null."""
    return F.when(F.count(p) > 0, F.struct(F.avg(p["x"]).alias("x"), F.avg(p["y"]).alias("y")))
