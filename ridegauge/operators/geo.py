"""Transit feeds, station locations and the nearest-place join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, functions as F

from ridegauge import schemas
from ridegauge.functions import cleaning as fx
from ridegauge.operators.keyed import first_per_key
from ridegauge.session import cut_lineage


def explode_features(documents: DataFrame, style: str, column: str = "document") -> DataFrame:
    """Feature-collection JSON to rows; ``style`` is ``attributes`` or ``geometry``."""
    if style == "attributes":
        parsed = F.from_json(F.col(column), schemas.TRANSIT_ATTRIBUTES)
        item = documents.select(F.explode(parsed["features"]).alias("f"))
        a = F.col("f.attributes")
        return item.select(
            a["Name"].alias("station_name"), a["city"].alias("city"), a["state"].alias("state"),
            a["latitude"].try_cast("double").alias("latitude"), a["longitude"].try_cast("double").alias("longitude"),
        )
    if style == "geometry":
        parsed = F.from_json(F.col(column), schemas.TRANSIT_GEOMETRY)
        item = documents.select(F.explode(parsed["features"]).alias("f"))
        p, c = F.col("f.properties"), F.col("f.geometry.coordinates")
        return item.select(
            p["Name"].alias("station_name"), p["city"].alias("city"), p["state"].alias("state"),
            F.get(c, F.lit(1)).try_cast("double").alias("latitude"),
            F.get(c, F.lit(0)).try_cast("double").alias("longitude"),
        )
    raise ValueError(f"unknown feature style {style!r}")


def transit_rows(features: DataFrame, station_type: str, state: str, trim: str = "suffix") -> DataFrame:
    """Typed station rows of one feed: either a literal suffix or everything after the first comma is dropped."""
    name = F.col("station_name")
    name = fx.strip_suffix(name, "Metro Station") if trim == "suffix" else fx.first_part(name)
    return features.select(
        name.alias("station_name"), "city", F.lit(state).alias("state"), "latitude", "longitude",
        F.lit(station_type).alias("station_type"),
    )


def transit_stations(*feeds: DataFrame) -> DataFrame:
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed)
    return out


def station_locations(trips: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One location per station: first row per start station, first per end station, set union."""
    order = order or ["trip_id"]
    side = lambda s: trips.select(
        F.col(f"{s}_station").alias("station_id"), F.col(f"{s}_lat").alias("latitude"),
        F.col(f"{s}_lon").alias("longitude"), *order,
    )
    pick = lambda df: first_per_key(df, ["station_id"], order).drop(*order)
    return pick(side("start")).union(pick(side("end"))).distinct()


def zip_counts(stations: DataFrame) -> DataFrame:
    return stations.groupBy("zip_code").agg(F.count(F.lit(1)).alias("stations"))


def population_view(census: DataFrame, state: str, county: str) -> DataFrame:
    return census.withColumn("state", F.lit(state)).withColumn("county", F.lit(county))


def station_density(station_zip: DataFrame, census: DataFrame, land: DataFrame) -> DataFrame:
    """Population per unit of land around each station."""
    people = census.select("zip_code", "total_population")
    area = land.select("zip_code", "land_area")
    return (
        station_zip.join(people, "zip_code", "left")
        .join(area, "zip_code", "left")
        .withColumn(
            "population_density", F.when(F.col("land_area") > 0, F.col("total_population") / F.col("land_area"))
        )
    )


LEAF_POINTS = 32
#: Wanted points a cell of the flat grid, and the most that a block of 2 x 2 cells may hold.
CELL_POINTS = 16
BLOCK_POINTS = 2_048
#: Frames of cells or points that may be broadcast have so many rows at most.
BROADCAST_ROWS = 65_536


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_value: str,
    left_xy: tuple[str, str] = ("latitude", "longitude"),
    right_xy: tuple[str, str] = ("latitude", "longitude"),
) -> DataFrame:
    """Attach to every left row the value of the closest right point (ties: smallest value), exactly.

    A flat grid comes first: each left row meets the one block of 2 x 2 cells around it, and is settled if the closest point there is nearer
    than the block's border. Rows that this leaves open (sparse or crowded surroundings, places far off) descend a grid hierarchy
    (:func:`_descend`). Neither side is multiplied by the other. Rows that repeat a key get their own answers where their places differ.
    """
    points = (
        right.select(
            F.col(right_xy[0]).cast("double").alias("rx"), F.col(right_xy[1]).cast("double").alias("ry"),
            F.col(right_value).alias("rv"),
        )
        .filter("rx IS NOT NULL AND ry IS NOT NULL")
        .groupBy("rx", "ry")
        .agg(F.min("rv").alias("rv"))
    )
    points = cut_lineage(points)
    box = points.agg(
        F.min("rx").alias("x0"), F.max("rx").alias("x1"), F.min("ry").alias("y0"), F.max("ry").alias("y1"),
        F.count(F.lit(1)).alias("n"),
    ).collect()[0]
    if box["n"] == 0:
        return left.withColumn(right_value, F.lit(None).cast(right.schema[right_value].dataType))
    met = cut_lineage(_nearest_in_block(left, points, box, left_xy))
    settled = met.filter("_settled").select(*left.columns, F.col("_near.rv").alias(right_value))
    rest = met.filter("NOT _settled").select(*left.columns)
    if rest.isEmpty():
        return settled
    return settled.unionByName(_descend(rest, points, box, left_key, right_value, left_xy))


def _nearest_in_block(left: DataFrame, points: DataFrame, box: Row, left_xy: tuple[str, str]) -> DataFrame:
    """``left`` with ``_near`` (d, rv), the closest point of the row's block, and ``_settled``, whether no other point can be as close."""
    wide, high = box["x1"] - box["x0"], box["y1"] - box["y0"]
    side = max(math.sqrt(wide * high * CELL_POINTS / box["n"]), max(wide, high) * CELL_POINTS / box["n"]) or 1.0
    cell = lambda c, low: F.floor((F.col(c) - low) / side)
    placed = points.withColumns({"gx": cell("rx", box["x0"]), "gy": cell("ry", box["y0"])})
    last = {"x": max(math.floor(wide / side) - 1, 0), "y": max(math.floor(high / side) - 1, 0)}  # a block's first cell at most

    def blocks_of(rows: DataFrame) -> DataFrame:
        """A cell lies in up to four blocks, named by their first cells."""
        own = lambda g, to: F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0)), lambda d: F.greatest(F.least(F.col(g) + d, F.lit(to)), F.lit(0))))
        return rows.withColumn("bx", F.explode(own("gx", last["x"]))).withColumn("by", F.explode(own("gy", last["y"])))

    sizes = blocks_of(placed.groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("n")))
    light = sizes.groupBy("bx", "by").agg(F.sum("n").alias("n")).filter(F.col("n") <= BLOCK_POINTS).drop("n")
    blocks = (
        blocks_of(placed).join(light.hint("merge"), ["bx", "by"]).groupBy("bx", "by").agg(F.collect_list(F.struct("rx", "ry", "rv")).alias("_points"))
    )
    x, y = F.col(left_xy[0]).cast("double"), F.col(left_xy[1]).cast("double")
    first = lambda c, low, to: F.greatest(F.least(F.floor((c - low) / side - 0.5), F.lit(to)), F.lit(0))
    rows = left.withColumns({"_bx": first(x, box["x0"], last["x"]), "_by": first(y, box["y0"], last["y"])})
    rows = rows.join(blocks.hint("merge"), (F.col("_bx") == F.col("bx")) & (F.col("_by") == F.col("by")), "left")

    def clear(c: Column, low: float, at: str, to: int) -> Column:
        """Distance to the block's sides behind which there are further cells."""
        before = F.when(F.col(at) > 0, c - (F.col(at) * side + low))
        behind = F.when(F.col(at) < to, (F.col(at) + 2) * side + low - c)
        return F.least(F.coalesce(before, F.lit(math.inf)), F.coalesce(behind, F.lit(math.inf)))

    near = F.array_min(
        F.transform("_points", lambda p: F.struct(F.sqrt((x - p["rx"]) * (x - p["rx"]) + (y - p["ry"]) * (y - p["ry"])).alias("d"), p["rv"].alias("rv")))
    )
    border = F.least(clear(x, box["x0"], "_bx", last["x"]), clear(y, box["y0"], "_by", last["y"])) - side * 1e-6  # cells are told apart by rounded numbers
    rows = rows.withColumn("_near", near).withColumn("_settled", F.coalesce(F.col("_near.d") < border, F.lit(False)))
    return rows.select(*left.columns, "_near", "_settled")


def _descend(left: DataFrame, points: DataFrame, box: Row, left_key: str, right_value: str, left_xy: tuple[str, str]) -> DataFrame:
    """The join by branch and bound.

    The right side becomes a grid hierarchy, 4 x 4 children per cell with tight bounding boxes. Each left point keeps a
    short list of cells that may still hold its nearest point and descends level by level: a cell survives only when its
    smallest possible distance does not exceed the best guaranteed distance. Every join is on a cell id with at most 16
    children; larger levels are merged, never broadcast, and adaptive execution splits hot cells.
    """
    span = max(box["x1"] - box["x0"], box["y1"] - box["y0"]) or 1.0

    def leaf(depth: int) -> DataFrame:
        side = 4**depth
        cell = lambda c, low: F.least(
            F.floor((F.col(c) - low) / span * side), F.lit(side - 1)
        ).cast("long")
        return points.withColumn("cx", cell("rx", box["x0"])).withColumn("cy", cell("ry", box["y0"]))

    depth = max(1, math.ceil(math.log(max(box["n"] / LEAF_POINTS, 1.0), 16)))
    while 4**depth < 1 << 52:  # points are distinct, so cells this fine hold one each up to the precision of a double
        fullest = leaf(depth).groupBy("cx", "cy").count().agg(F.max("count")).collect()[0][0]
        if fullest <= LEAF_POINTS:
            break
        depth += 1
    tree = leaf(depth)

    def cells(level: int) -> DataFrame:
        shift = 2 * (depth - level)
        return tree.groupBy(F.shiftright("cx", shift).alias("cx"), F.shiftright("cy", shift).alias("cy")).agg(
            F.min("rx").alias("bx0"), F.max("rx").alias("bx1"), F.min("ry").alias("by0"), F.max("ry").alias("by1")
        )

    def on_cell(frontier: DataFrame, side: DataFrame, bounded: bool) -> DataFrame:
        return frontier.join(F.broadcast(side) if bounded else side.hint("merge"), ["px", "py"])

    frontier = left.select(
        F.col(left_key).alias("k"), F.col(left_xy[0]).cast("double").alias("x"),
        F.col(left_xy[1]).cast("double").alias("y"), F.lit(0).cast("long").alias("px"), F.lit(0).cast("long").alias("py"),
    ).filter("x IS NOT NULL AND y IS NOT NULL").repartition("k")  # before the rows grow by the first 16 children

    for level in range(1, depth + 1):
        side = cells(level).select(
            F.shiftright("cx", 2).alias("px"), F.shiftright("cy", 2).alias("py"), "cx", "cy", "bx0", "bx1", "by0", "by1"
        )
        met = on_cell(frontier, side, bounded=16**level <= BROADCAST_ROWS)
        gap = lambda c, lo, hi: F.greatest(F.col(lo) - F.col(c), F.col(c) - F.col(hi), F.lit(0.0))
        reach = lambda c, lo, hi: F.greatest(F.abs(F.col(c) - F.col(lo)), F.abs(F.col(hi) - F.col(c)))
        norm = lambda a, b: F.sqrt(a * a + b * b)
        scored = met.select(
            "k", "x", "y", "cx", "cy",
            norm(gap("x", "bx0", "bx1"), gap("y", "by0", "by1")).alias("dmin"),
            norm(reach("x", "bx0", "bx1"), reach("y", "by0", "by1")).alias("dmax"),
        )
        kept = scored.groupBy("k", "x", "y").agg(
            F.min("dmax").alias("best"), F.collect_list(F.struct("dmin", "cx", "cy")).alias("cand")
        )
        frontier = kept.select(
            "k", "x", "y",
            F.explode(F.filter("cand", lambda c: c["dmin"] <= F.col("best") * (1 + 1e-12))).alias("c"),
        ).select("k", "x", "y", F.col("c.cx").alias("px"), F.col("c.cy").alias("py"))

    ends = tree.select(F.col("cx").alias("px"), F.col("cy").alias("py"), "rx", "ry", "rv")
    last = on_cell(frontier, ends, bounded=box["n"] <= BROADCAST_ROWS)
    dx, dy = F.col("x") - F.col("rx"), F.col("y") - F.col("ry")
    found = last.groupBy(F.col("k").alias("_k"), F.col("x").alias("_x"), F.col("y").alias("_y")).agg(
        F.min_by("rv", F.struct(F.sqrt(dx * dx + dy * dy), "rv")).alias(right_value)
    )
    same = (left[left_key] == F.col("_k")) & (left[left_xy[0]].cast("double") == F.col("_x")) & (left[left_xy[1]].cast("double") == F.col("_y"))
    return left.join(found, same, "left").drop("_k", "_x", "_y")
