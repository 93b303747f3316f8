"""Addresses to districts: gazetteer, point in polygon, name in the text.

Defined results: null addresses and coordinates have no district; an address with several
coordinates takes the smallest; of several districts, the first name on a shared edge and
the longest name in a text (ties by name) win; repeated rows are answered alike; without
polygons, names or gazetteer the district is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitcast.functions.fields import normalise_address


def geocode(df: DataFrame, gazetteer: DataFrame, address: str = "address") -> DataFrame:
    """df with lon and lat of its normalised address; null where the gazetteer has none."""
    known = gazetteer.groupBy(normalise_address(F.col("address")).alias("_key")).agg(F.min(F.struct("lon", "lat")).alias("at"))
    return df.withColumn("_key", normalise_address(F.col(address))).join(known, "_key", "left").select(*df.columns, F.col("at.lon").alias("lon"), F.col("at.lat").alias("lat"))


def inside(x: str, y: str, edges: str) -> Column:
    """Whether a ray to the right of the point crosses the sides an odd number of times."""
    return F.expr(f"aggregate({edges}, 0, (s, e) -> s + CASE WHEN (e.ay > {y}) != (e.by > {y}) AND {x} < (e.bx - e.ax) * ({y} - e.ay) / nullif(e.by - e.ay, 0D) + e.ax THEN 1 ELSE 0 END) % 2 = 1")


def _touching(e: np.ndarray, lox: float, loy: float, hix: float, hiy: float) -> np.ndarray:
    """Which sides meet a closed box: their boxes overlap, and its corners don't all lie on one side of the line."""
    ax, ay, bx, by = e.T
    dx, dy = bx - ax, by - ay
    turn = np.array([dx * (y - ay) - dy * (x - ax) for x in (lox, hix) for y in (loy, hiy)])
    slack = 1e-9 * (np.abs(dx) + np.abs(dy)) * (hix - lox + hiy - loy)
    overlap = (np.minimum(ax, bx) <= hix) & (np.maximum(ax, bx) >= lox) & (np.minimum(ay, by) <= hiy) & (np.maximum(ay, by) >= loy)
    return overlap & (turn.min(axis=0) <= slack) & (turn.max(axis=0) >= -slack)


def cells_of(ring: list[tuple[float, float]], x0: float, y0: float, side: float, level: int, depth: int) -> Iterator[tuple[int, int, int, list | None]]:
    """level, cx, cy, band of the cells that cover one ring; see quadtree()."""
    corners = np.array(ring, dtype=float)
    e = np.hstack([corners, np.roll(corners, -1, axis=0)])
    ax, ay, bx, by = e.T
    lo, hi = corners.min(axis=0), corners.max(axis=0)
    size = side / 2**level
    todo = [(level, cx, cy, e) for cx in range(int((lo[0] - x0) // size), int((hi[0] - x0) // size) + 1) for cy in range(int((lo[1] - y0) // size), int((hi[1] - y0) // size) + 1)]
    last = level + depth
    while todo:
        level, cx, cy, near = todo.pop()
        size = side / 2**level
        gap, lox, loy = 1e-9 * size, x0 + cx * size, y0 + cy * size
        near = near[_touching(near, lox - gap, loy - gap, lox + size + gap, loy + size + gap)]
        if len(near) and level < last:
            todo += [(level + 1, 2 * cx + i, 2 * cy + j, near) for i in (0, 1) for j in (0, 1)]
        elif len(near):
            right = (np.maximum(ax, bx) >= lox - gap) & (np.minimum(ay, by) <= loy + size + gap) & (np.maximum(ay, by) >= loy - gap)
            yield level, cx, cy, [dict(zip(("ax", "ay", "bx", "by"), x, strict=True)) for x in e[right].tolist()]
        else:
            x, y = lox + size / 2, loy + size / 2
            over = (ay > y) != (by > y)
            if (x < (bx - ax)[over] * (y - ay[over]) / (by - ay)[over] + ax[over]).sum() % 2:
                yield level, cx, cy, None


_CELLS = "district string, x0 double, y0 double, side double, level int, cx long, cy long, band array<struct<ax:double,ay:double,bx:double,by:double>>"


def _framed(polygons: DataFrame) -> DataFrame:
    """district, ring, level (where it begins), and the square around all of them: x0, y0, side."""
    box = polygons.filter("size(ring) > 2").selectExpr("district", "ring", *[f"array_{m}(transform(ring, p -> p.{c})) AS _{n}{c}" for c in "xy" for m, n in (("min", "lo"), ("max", "hi"))])
    whole = box.selectExpr("min(_lox) AS x0", "min(_loy) AS y0", "greatest(max(_hix) - min(_lox), max(_hiy) - min(_loy), 1e-9D) * 1.0000001D AS side")
    level = "CAST(greatest(0, floor(log2(side / greatest(_hix - _lox, _hiy - _loy, side / 1048576)))) AS INT) AS level"
    return box.join(F.broadcast(whole)).selectExpr("district", "ring", "x0", "y0", "side", level)


def quadtree(polygons: DataFrame, depth: int = 6) -> DataFrame:
    """district, level, cx, cy, band: the cells that cover each polygon, in squares halved from level to level.

    A polygon begins on the level whose cells are about as large as its box, and cells that its border
    meets are quartered `depth` times. Cells wholly inside have a null band: their points need no test.
    Border cells carry in `band` the sides that a ray to the right of one of their points can cross.
    Cells touch the border if they come within a billionth of their size, so rounding can't put a point into
    the wrong inner cell. Level 0 is a square around all polygons, whose corner and size (x0, y0, side)
    stand in every row. Rings without three corners hold nothing. One polygon is cut by one call of a small
    helper; polygons are dealt over the tasks.
    """
    rows = _framed(polygons)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                cells = list(zip(*cells_of([(p["x"], p["y"]) for p in r["ring"]], r["x0"], r["y0"], r["side"], r["level"], depth), strict=True))
                if cells:
                    same = [pa.array([r[c]] * len(cells[0])) for c in ("district", "x0", "y0", "side")]
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.struct([(c, pa.float64()) for c in ("ax", "ay", "bx", "by")])))
                    yield pa.RecordBatch.from_arrays([*same, *(pa.array(c, t) for c, t in zip(cells, kinds, strict=True))], ["district", "x0", "y0", "side", "level", "cx", "cy", "band"])

    return rows.mapInArrow(cut, _CELLS)


def near_cells(points: DataFrame, polygons: DataFrame, x: str = "lon", y: str = "lat", depth: int = 6) -> DataFrame:
    """_px, _py, district, band: the distinct points with each cell that holds them; band is null where no test is left to do."""
    levels = F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("level"), F.col("level") + depth)))).alias("levels")
    frame = _framed(polygons).agg(*[F.first(c).alias(c) for c in ("x0", "y0", "side")], levels)
    distinct = points.select(F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py")).distinct().filter(F.col("_px").isNotNull() & F.col("_py").isNotNull() & ~F.isnan("_px") & ~F.isnan("_py"))
    placed = distinct.join(F.broadcast(frame)).filter(F.col("_px").between(F.col("x0"), F.col("x0") + F.col("side")) & F.col("_py").between(F.col("y0"), F.col("y0") + F.col("side")))
    at = placed.withColumn("level", F.explode("levels")).selectExpr("_px", "_py", "level", "floor((_px - x0) / (side / pow(2D, level))) AS cx", "floor((_py - y0) / (side / pow(2D, level))) AS cy")
    return at.join(quadtree(polygons, depth).select("district", "level", "cx", "cy", "band"), ["level", "cx", "cy"]).select("_px", "_py", "district", "band")


def district_of(points: DataFrame, polygons: DataFrame, x: str = "lon", y: str = "lat", depth: int = 6) -> DataFrame:
    """points with the district whose ring holds them (the first name on a shared edge), null outside.

    Distinct points meet the cells of a quadtree in an equi-join: points in a cell wholly inside have their
    district, and only those in border cells are tested, against the sides that lie in their way. A null
    coordinate has no district; repeated points and rows are answered alike.
    """
    near = near_cells(points, polygons, x, y, depth)
    held = near.filter(F.col("band").isNull() | inside("_px", "_py", "band"))
    found = held.groupBy("_px", "_py").agg(F.min("district").alias("district"))
    return points.join(found, (F.col(x) == F.col("_px")) & (F.col(y) == F.col("_py")), "left").drop("_px", "_py")


def district_from_text(df: DataFrame, districts: DataFrame, address: str = "address") -> DataFrame:
    """df with the longest district name that its address contains (ties by name); null if none does."""
    # Names meet the addresses that hold their first two characters, so that the join is on a key.
    names = districts.filter(F.length("district") > 0).select(F.col("district").alias("_name"), F.substring("district", 1, 2).alias("_gram")).distinct()
    distinct = df.select(F.col(address).alias("_a")).filter(F.col(address).isNotNull()).distinct()
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("_a"), F.lit(1))), lambda i: F.substring(F.col("_a"), i, F.lit(n)))
    grams = distinct.select("_a", F.explode(F.array_distinct(F.concat(cut(1), cut(2)))).alias("_gram"))
    hits = grams.join(names, "_gram").filter(F.col("_a").contains(F.col("_name")))
    best = hits.groupBy("_a").agg(F.min(F.struct((-F.length("_name")).alias("l"), "_name")).alias("b")).select("_a", F.col("b._name").alias("district"))
    return df.join(best, F.col(address) == F.col("_a"), "left").drop("_a")


def clean_district(df: DataFrame, gazetteer: DataFrame, polygons: DataFrame, districts: DataFrame, steps: tuple[str, ...] = ("polygon", "text"), address: str = "address") -> DataFrame:
    """df with the district of the first step that finds one: `polygon` (by gazetteer coordinates) or `text`."""
    found = df
    for s in steps:
        if s == "polygon":
            found = district_of(geocode(found, gazetteer, address), polygons).drop("lon", "lat")
        elif s == "text":
            found = district_from_text(found, districts, address)
        else:
            raise ValueError(f"unknown step {s}")
        found = found.withColumnRenamed("district", f"_by_{s}")
    return found.select(*df.columns, F.coalesce(*[F.col(f"_by_{s}") for s in steps]).alias("district"))
