"""Clusters of map markers: what a sweep from west to east with a list of open clusters finds.

The first marker that no cluster holds opens one, whose bounds are the marker's cell of a
grid in the map's projection; a marker joins the earliest cluster whose bounds, rims
included, hold it. A marker inside its own cell alone can only be in that cell's first
cluster, which a sum over cells finds. Markers on rims can be in a neighbour's, if it is
there by then: they are swept in order, in strips of columns that no rim connects.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pixels of a cell, and of the map at zoom 0; latitudes end where the map does.
SIZE, TILE, LAST = 120, 256, 85.0511287798
CATEGORIES = 8


def projected(latitude: Column, longitude: Column, zoom: int) -> tuple[Column, Column]:
    """Pixels from the map's north-west corner."""
    world = float(TILE << zoom)
    low = F.least(F.greatest(latitude, F.lit(-LAST)), F.lit(LAST))
    return world * (longitude / 360 + 0.5), world * (0.5 - F.log(F.tan(math.pi / 4 + low * math.pi / 360)) / (2 * math.pi))


def unprojected(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """(latitude, longitude) of pixels."""
    world = float(TILE << zoom)
    return (2 * F.atan(F.exp((0.5 - y / world) * 2 * math.pi)) - math.pi / 2) * 180 / math.pi, (x / world - 0.5) * 360


def _inside(dx: int, dy: int, zoom: int, size: int) -> Column:
    """Whether the bounds of the cell so far away hold the marker."""
    x, y = (F.col("cell_x") + dx) * size, (F.col("cell_y") + dy) * size
    north, west = unprojected(x, y, zoom)
    south, east = unprojected(x + size, y + size, zoom)
    return F.col("latitude").between(south, north) & F.col("longitude").between(west, east)


def _swept(rows: DataFrame) -> DataFrame:
    """(id, cell_x, cell_y, n) of rim markers: the n-th cluster of a cell. Rows of cells alone tell when their first plain marker comes."""

    def sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        strip, made, order, column = None, {}, 0, 0  # clusters of each cell, by the order in which they were opened
        for frame in frames:
            out = []
            for r in frame.itertuples():
                if r.strip != strip:
                    strip, made, order, column = r.strip, {}, 0, r.column
                if r.column > column + 2:  # others end west of here
                    made, column = {c: v for c, v in made.items() if c[0] >= r.column - 2}, r.column
                holds = [(int(r.cell_x) + k % 3 - 1, int(r.cell_y) + k // 3 - 1) for k in range(9) if r.holds >> k & 1]
                found = min(((made[c][0], c) for c in holds if c in made), default=None)
                if found:
                    cell, n = found[1], 0
                else:
                    cell = (int(r.cell_x), int(r.cell_y))
                    order += 1
                    made.setdefault(cell, []).append(order)
                    n = len(made[cell]) - 1
                if r.rim:
                    out.append((r.id, cell[0], cell[1], n))
            yield pd.DataFrame(out, columns=["id", "cell_x", "cell_y", "n"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.repartition("strip").sortWithinPartitions("strip", "longitude", "id").mapInPandas(sweep, f"id {kind}, cell_x long, cell_y long, n int")


def map_clusters(markers: DataFrame, *, zoom: int, size: int = SIZE, view: tuple[float, float, float, float] | None = None, padding: float = 0.2) -> DataFrame:
    """(cell_x, cell_y, n, population, weight, latitude, longitude, stats) of the clusters of markers (id, latitude, longitude, and weight and category if they have them).

    The position is the markers' weighted mean, ``stats`` counts categories 0 to 7. ``view``
    (south, west, north, east) leaves out what lies beyond it and its padding. Markers without
    a position are left out; equal longitudes go by id, which is a marker's own.
    """
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in markers.columns else F.lit(1.0)
    category = F.col("category").cast("int") if "category" in markers.columns else F.lit(None).cast("int")
    rows = markers.select("id", F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"), weight.alias("weight"), category.alias("category")).filter("latitude IS NOT NULL AND longitude IS NOT NULL")
    if view:
        south, west, north, east = view
        high, wide = abs(north - south) * padding * 2, abs(east - west) * padding * 2
        rows = rows.filter((F.col("latitude") > south - high) & (F.col("latitude") < north + high) & F.col("longitude").between(west - wide, east + wide))
    x, y = projected(F.col("latitude"), F.col("longitude"), zoom)
    celled = rows.withColumn("cell_x", F.floor(x / size)).withColumn("cell_y", F.floor(y / size))
    holds = sum((F.when(_inside(k % 3 - 1, k // 3 - 1, zoom, size), 1 << k).otherwise(0) for k in range(9)), F.lit(0))
    placed = celled.withColumn("holds", holds).withColumn("rim", F.col("holds") != 1 << 4)
    firsts = placed.filter("NOT rim").groupBy("cell_x", "cell_y").agg(F.min(F.struct("longitude", "id")).alias("f"))
    rims = placed.filter("rim").select("id", "longitude", "cell_x", "cell_y", "holds", F.lit(True).alias("rim"))
    near = rims.select(F.explode(F.sequence(F.col("cell_x") - 1, F.col("cell_x") + 1)).alias("column")).distinct()  # at most the map's columns
    apart = F.when(F.col("column") - F.lag("column").over(Window.orderBy("column")) > 1, 1).otherwise(0)
    strips = near.withColumn("_new", apart).select("column", F.sum("_new").over(Window.orderBy("column").rowsBetween(Window.unboundedPreceding, 0)).alias("strip"))
    plain = firsts.select("f.id", "f.longitude", "cell_x", "cell_y", F.lit(1 << 4).alias("holds"), F.lit(False).alias("rim"))
    swept = _swept(rims.unionByName(plain).withColumn("column", F.col("cell_x")).join(strips, "column"))
    own = placed.filter("NOT rim").select("cell_x", "cell_y", F.lit(0).alias("n"), "latitude", "longitude", "weight", "category")
    moved = placed.filter("rim").select("id", "latitude", "longitude", "weight", "category").join(swept, "id").drop("id")
    mean = lambda c: (F.sum(F.col("weight") * F.col(c)) / F.sum("weight")).alias(c)
    stats = F.array(*(F.count_if(F.col("category") == k) for k in range(CATEGORIES))).alias("stats")
    return own.unionByName(moved).groupBy("cell_x", "cell_y", "n").agg(F.count("*").alias("population"), F.sum("weight").alias("weight"), mean("latitude"), mean("longitude"), stats)
