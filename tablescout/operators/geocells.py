"""Grid cells for the request-place join.

Twelve grids with cells of 2^-14 to 256 degrees, each four times coarser than the one before. A
request uses a grid that fits its box, so 0.5 km and 500 km requests never share one; a place
has one cell on every grid in use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablescout import fixed_values as V
from tablescout.operators.blocks import FILTERS
from tablescout.session import materialize

LEVELS = 12
#: Widest box per cell width. A request is sent to every cell of its box and has its hits from each, so
#: a box meets at most four cells, mostly one or two; inside a group only the box's surrounding is scored.
BOX_CELLS = 0.5
#: Grids on which qualifying places are counted when a distance search is narrowed.
_COUNT_LEVELS = 9


def cell_size(level: int) -> float:
    return 2.0 ** (2 * level - 14)


def box_level(most: float = BOX_CELLS) -> Column:
    """The finest grid on which the box is no wider than ``most`` cells."""
    width = F.greatest(F.col("lat_max") - F.col("lat_min"), F.col("lon_max") - F.col("lon_min"))
    fits = [F.when(width <= F.lit(most * cell_size(j)), F.lit(j)) for j in range(LEVELS)]
    return F.coalesce(*fits, F.lit(LEVELS - 1))


def _cell(level: Column, cy: Column, cx: Column) -> Column:
    return F.struct(level.cast("int").alias("level"), cy.alias("cy"), cx.alias("cx"))


def box_grid() -> Column:
    """The cells the request box touches (one or two per axis below the last grid)."""
    size = F.element_at(F.array(*(F.lit(cell_size(j)) for j in range(LEVELS))), F.col("level") + 1)
    rows = F.sequence(F.floor(F.col("lat_min") / size), F.floor(F.col("lat_max") / size))
    columns = F.sequence(F.floor(F.col("lon_min") / size), F.floor(F.col("lon_max") / size))
    grid = F.transform(rows, lambda cy: F.transform(columns, lambda cx: _cell(F.col("level"), cy, cx)))
    return F.flatten(grid)


def box_cells() -> Column:
    """Explodes to the cells of the box."""
    return F.explode(box_grid())


def place_grid(levels: list[int]) -> Column:
    """The place's cell on each of the given grids."""
    cells = [_cell(F.lit(j), F.floor(F.col("p_lat") / F.lit(cell_size(j))),
                   F.floor(F.col("p_lon") / F.lit(cell_size(j)))) for j in levels]
    return F.array(*cells)


def place_cells(levels: list[int]) -> Column:
    """Explodes to the place's cells."""
    return F.explode(place_grid(levels))


def _dense_cells(places: DataFrame, need: int) -> DataFrame:
    """Cells with at least ``need`` places, with one bit per (rating, price) filter that still leaves ``need``."""
    cells = places.select("rating", "price", place_cells(list(range(_COUNT_LEVELS))).alias("cell"))
    counts = cells.groupBy("cell.level", "cell.cy", "cell.cx").agg(*(
        F.expr(f"count_if(({r} = 0 or rating >= {r}) and ({p} < 0 or price <= {p})) as n{i}")
        for i, (r, p) in enumerate(FILTERS)))
    bits = " | ".join(f"if(n{i} >= {need}, {1 << i}L, 0L)" for i in range(len(FILTERS)))
    return counts.where(F.col("n0") >= need).select("level", "cy", "cx", F.expr(bits).alias("enough"))


def narrow_boxes(requests: DataFrame, places: DataFrame, need: int) -> DataFrame:
    """Shrink the boxes of requests without a vector; their distance answers stay the same.

    If the request's own cell on some grid lies inside its box and holds ``need`` qualifying
    places, the ``need`` nearest are no farther than the cell's far corner, and only that
    surrounding has to be searched. The finest such grid wins; other requests keep their box.
    Bounds are rounded outwards by a metre, ten times the resolution of the distance formula.
    """
    sizes = F.array(*(F.lit(cell_size(j)) for j in range(_COUNT_LEVELS)))
    probes = (
        requests.where(F.col("query_vector").isNull() & F.col("filter_number").isNotNull() & (F.abs("q_lat") < 89.0))
        .select("qid", "q_lat", "q_lon", "lat_min", "lat_max", "lon_min", "lon_max",
                "filter_number", F.posexplode(sizes).alias("level", "size"))
        .withColumn("cy", F.floor(F.col("q_lat") / F.col("size")))
        .withColumn("cx", F.floor(F.col("q_lon") / F.col("size")))
        .where((F.col("cy") * F.col("size") >= F.col("lat_min"))
               & ((F.col("cy") + 1) * F.col("size") <= F.col("lat_max"))
               & (F.col("cx") * F.col("size") >= F.col("lon_min"))
               & ((F.col("cx") + 1) * F.col("size") <= F.col("lon_max")))
        .select("qid", "level", "cy", "cx", "filter_number")
    )
    enough = F.getbit("enough", "filter_number") == 1
    finest = (
        probes.join(_dense_cells(places, need), ["level", "cy", "cx"]).where(enough)
        .groupBy("qid").agg(F.min("level").alias("own_level"))
    )
    finest = materialize(finest, "narrowed")

    size = F.element_at(sizes, F.col("own_level") + 1)
    south = F.floor(F.col("q_lat") / size) * size
    west = F.floor(F.col("q_lon") / size) * size
    up = F.radians(F.greatest(F.col("q_lat") - south, south + size - F.col("q_lat")))
    across = F.radians(F.greatest(F.col("q_lon") - west, west + size - F.col("q_lon")))
    # Haversine to the far corner, taken at the latitude of the cell where a degree is longest.
    nearest_equator = F.when(south * (south + size) <= 0, F.lit(0.0)).otherwise(
        F.least(F.abs(south), F.abs(south + size)))
    widest = F.cos(F.radians("q_lat")) * F.cos(F.radians(nearest_equator))
    chord = F.pow(F.sin(up / 2), F.lit(2)) + widest * F.pow(F.sin(across / 2), F.lit(2))
    reach = F.lit(2 * V.EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), chord))) * (1 + 1e-9) + 1e-3
    angle = reach / F.lit(V.EARTH_RADIUS_KM)
    half_lat = F.degrees(angle) + 1e-9
    half_lon = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(angle) / F.cos(F.radians("q_lat"))))) + 1e-9
    one_turn = (F.col("lon_max") - F.col("lon_min") >= 360.0) | (F.abs("q_lat") + half_lat >= 90.0)
    half_lon = F.when(one_turn, F.lit(1e9)).otherwise(half_lon)
    edges = {
        "lat_min": F.greatest(F.col("lat_min"), F.col("q_lat") - half_lat),
        "lat_max": F.least(F.col("lat_max"), F.col("q_lat") + half_lat),
        "lon_min": F.greatest(F.col("lon_min"), F.col("q_lon") - half_lon),
        "lon_max": F.least(F.col("lon_max"), F.col("q_lon") + half_lon),
    }
    joined = requests.join(finest, "qid", "left")
    known = F.col("own_level").isNotNull()
    return joined.withColumns(
        {name: F.when(known, edge).otherwise(F.col(name)) for name, edge in edges.items()}
    ).drop("own_level")
