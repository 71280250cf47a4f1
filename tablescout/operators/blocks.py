"""Blocked nearest-neighbour join.

Requests and places meet in geo cells. Neither the pairs of a cell nor a whole cell ever
form one task's input: every cell is cut into request tiles and place tiles of bounded bytes,
each (request tile, place tile) combination is one Arrow group, and a group emits a list of at most
``limit`` hits per request. A cell that holds a third of all rows therefore becomes many equal
groups instead of one hot one. A row travels once per tile of the other side, so tiles are as
large as a task's memory allows; inside a group they are cut into blocks, and the best of a
request's blocks are kept.

Inside a large group vectors are not compared all with all: the places are cut into leaves, each with
a centre, an angular radius and the ranges of its positions, ratings and prices. A request visits
its most promising leaf first and then only leaves whose best possible distance can still enter its
``limit`` best; by the triangle inequality of angles nothing else can be an answer.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablescout import fixed_values as V
from tablescout.functions import geo
from tablescout.session import materialize

#: Rows per block: the least that is worth a tile of its own, and the most scored at once.
REQUEST_BLOCK = (2048, 16384)
PLACE_BLOCK = (4096, 16384)
#: Bytes of a tile. A request has its hits once per place tile, so these are larger.
REQUEST_TILE_BYTES, PLACE_TILE_BYTES = 32e6, 96e6
#: Bytes of a row besides its vector.
_ROW_BYTES = 100
#: Request tiles a cell is cut into before its tiles grow.
_TILES_PER_CELL = 8
#: The cell directory (five integers per cell) is broadcast up to this many rows.
BROADCAST_CELLS = 1_000_000
#: Scored pairs per task (about ten seconds of work), rows per task, and the most tasks asked for.
TASK_PAIRS = 2e8
TASK_ROWS = 1e5
MAX_TASKS = 100_000
#: Request rows scored at once inside a group, and the pairs from which a group is split by filter.
_CHUNK = 256
_SPLIT_BY_FILTER = 1_000_000
#: Places per leaf, the pairs from which a group is searched leaf by leaf, request rows that visit a leaf
#: at once, and the angle by which a bound is rounded outwards.
LEAF = 256
_LEAF_PAIRS = 2_000_000
_VISITORS = 2048
#: Places of neighbouring clusters compared at once by the requests that read most of these clusters.
_CLUSTER_ROWS = 1024
_ANGLE_MARGIN = 1e-6
#: Pairs of a request and a cluster whose bounds are held at once.
_READS = 2**24
#: Pairs are compared one by one if no more than one in so many passes the rough test.
_SPARSE = 16
#: Rounding of a cosine of the distance on the sphere, taken in two ways.
_COSINE_MARGIN = 1e-14

#: The filters a valid request can set: whole stars, and a highest price or none.
FILTERS = [(r, p) for r in range(V.MAX_RATING + 1) for p in (-1, *range(1, V.MAX_PRICE + 1))]

VECTOR = "vector"
DISTANCE = "distance"


class Chosen(Protocol):
    """Which clusters the requests of a search read, and in which of its rounds."""

    def until(self, requests: pa.Table) -> np.ndarray:
        """Per request and round but the last: hits nearer than this are wanted if they are among the best of the
        rounds up to it, although later rounds have better ones."""

    def rounds(self, requests: pa.Table, rows: np.ndarray, units: np.ndarray, clusters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For some rows, given as unit vectors, and clusters: the round of each pair, -1 if the cluster is not read,
        and the least angle of a member."""


class Wanted:
    """How far the hits of each request of a block may be; it shrinks as hits are found.

    A hit is wanted if it is among the ``limit`` best of all rounds, or among those of the rounds up to one and
    nearer than ``until`` says for it. Without rounds all hits are of one.
    """

    def __init__(self, worst: np.ndarray, limit: int, until: np.ndarray | None = None):
        self.limit, self.until = limit, np.empty((len(worst), 0)) if until is None else until
        self.limits = np.repeat(worst[:, None], self.until.shape[1] + 1, axis=1)
        self._spread()

    def _spread(self) -> None:
        self.farthest = self.limits.copy()
        for number in range(self.until.shape[1] - 1, -1, -1):
            own = np.minimum(self.limits[:, number], self.until[:, number])
            self.farthest[:, number] = np.maximum(self.farthest[:, number + 1], own)

    def _asked(self, number: int, rows: np.ndarray, rounds: np.ndarray, away: np.ndarray) -> np.ndarray:
        """Hits that the rounds up to this one may want although later ones have better."""
        until = np.where(self.until[:, number] > self.limits[:, -1], self.until[:, number], -np.inf)
        return np.flatnonzero((rounds <= number) & (away < until[rows]))

    def of(self, rows: np.ndarray) -> Wanted:
        """The same for some of the requests."""
        some = Wanted(np.empty(0), self.limit)
        some.until, some.limits, some.farthest = self.until[rows], self.limits[rows], self.farthest[rows]
        return some

    def update(self, rows: np.ndarray, rounds: np.ndarray, away: np.ndarray) -> None:
        count = len(self.limits)
        self.limits[:, -1] = np.minimum(self.limits[:, -1], _limits(rows, away, count, self.limit))
        for number in range(self.until.shape[1]):
            own = self._asked(number, rows, rounds, away)
            if len(own):
                found = _limits(rows[own], away[own], count, self.limit)
                self.limits[:, number] = np.minimum(self.limits[:, number], found)
        self._spread()

    def near(self, rows: np.ndarray, rounds: np.ndarray, away: np.ndarray) -> np.ndarray:
        return away <= self.farthest[rows, rounds]

    def first(self, rows: np.ndarray, ties: np.ndarray, rounds: np.ndarray, away: np.ndarray) -> np.ndarray:
        """Positions of the wanted hits, row by row; of all rounds in order."""
        best = _first(rows, ties, away, self.limit)
        others = [own[_first(rows[own], ties[own], away[own], self.limit)] for own in (
            self._asked(number, rows, rounds, away) for number in range(self.until.shape[1]))]
        if not any(map(len, others)):
            return best
        every = np.unique(np.concatenate([best, *others]))
        return every[np.argsort(rows[every], kind="stable")]


def filter_number(min_rating: Column, max_price: Column) -> Column:
    """Position of a request's filter in ``FILTERS``; NULL for a filter outside the valid range."""
    number = F.greatest(min_rating, F.lit(0)) * (V.MAX_PRICE + 1) + F.greatest(max_price, F.lit(0))
    return F.when((min_rating <= V.MAX_RATING) & (max_price <= V.MAX_PRICE), number)


def passed_filters() -> Column:
    """One bit per entry of ``FILTERS`` that a place passes."""
    return F.expr(" | ".join(
        f"if(({r} = 0 or rating >= {r}) and ({p} < 0 or price <= {p}), {1 << i}L, 0L)" for i, (r, p) in enumerate(FILTERS)))


def prepare_requests(requests: DataFrame, with_vectors: bool, *extra: str) -> DataFrame:
    """Numeric request columns the join needs (and ``extra`` ones); positions that match nothing are dropped.

    An absent or unreadable rating or price sets no limit, as 0 does.
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    vector = F.col("query_vector") if with_vectors else F.lit(None).cast("array<float>")
    min_rating, price = (F.coalesce(F.col(c).try_cast("int"), F.lit(0)) for c in ("minimum_rating", "preferred_price_range"))
    max_price = geo.price_limit(price)
    return requests.where(geo.has_position(lat, lon)).select(
        "qid", lat.alias("q_lat"), lon.alias("q_lon"),
        F.col("max_distance_km").cast("double").alias("max_km"),
        min_rating.alias("min_rating"), max_price.alias("max_price"),
        filter_number(min_rating, max_price).alias("filter_number"),
        vector.alias("query_vector"), *extra,
        *(edge.alias(name) for name, edge in geo.box_bounds(lat, lon, F.col("max_distance_km").cast("double")).items()),
    )


def _place_columns(places: DataFrame, vector: Column, *extra: str) -> DataFrame:
    """Place columns the join needs; a null rating or price is coded so that an active filter fails it."""
    lat, lon, rating = F.col("latitude"), F.col("longitude"), F.col("overall_rating")
    infinity = F.lit(float("inf"))
    return places.where(geo.has_position(lat, lon)).select(
        F.col("id").cast("long").alias("id"), lat.alias("p_lat"), lon.alias("p_lon"),
        F.when(rating.isNull(), -infinity).when(F.isnan(rating), infinity).otherwise(rating).alias("rating"),
        F.coalesce(F.col("price_range").cast("double"), infinity).alias("price"),
        vector.alias("embedding"), *extra,
    )


def vector_places(places: DataFrame, *extra: str) -> DataFrame:
    """Places as vector hits."""
    return _place_columns(places.where(F.col("embedding").isNotNull()), F.col("embedding"), *extra)


def distance_places(places: DataFrame, limit: int) -> DataFrame:
    """Places as distance hits, without their vectors and without those no answer can contain.

    Places at one point are equally far from every request, and those of one price and one whole
    star pass the same filters: only the ``limit`` lowest ids of such a group can be among the
    ``limit`` nearest. The group is reduced before it is shuffled. The table is five numbers per
    place and is read several times, so it is written once.
    """
    rows = _place_columns(places, F.lit(None).cast("array<float>"))
    twins = Window.partitionBy("p_lat", "p_lon", F.floor("rating"), "price").orderBy("id")
    kept = rows.withColumn("_n", F.row_number().over(twins)).where(F.col("_n") <= limit)
    return materialize(kept.drop("_n", "embedding"), "distance-places").withColumn("embedding", F.lit(None).cast("array<float>"))


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def _vectors(table: pa.Table, name: str) -> tuple[np.ndarray, pa.Array]:
    """Vector length per row (0 for null) and the list column itself."""
    column = table[name].combine_chunks()
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), column


def _unit_rows(column: pa.Array, rows: np.ndarray, dim: int, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit-length matrix of the given rows; rows of zero length have no direction and are left out."""
    flat = column.take(pa.array(rows if order is None else order[rows])).flatten().to_numpy(zero_copy_only=False)
    matrix = flat.reshape(len(rows), dim).astype(np.float64)
    lengths = np.sqrt((matrix * matrix).sum(axis=1))
    kept = lengths > 0.0
    return rows[kept], matrix[kept] / lengths[kept, None]


def _smallest(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column indices of the ``limit`` smallest finite values per row, ties by column."""
    if values.shape[1] > limit:
        cut = np.partition(values, limit - 1, axis=1)[:, limit - 1 : limit]
        rows, cols = np.nonzero((values <= cut) & np.isfinite(values))
    else:
        rows, cols = np.nonzero(np.isfinite(values))
    kept = _first(rows, cols, values[rows, cols], limit)
    return rows[kept], cols[kept]


def _first(rows: np.ndarray, ties: np.ndarray, values: np.ndarray, limit: int) -> np.ndarray:
    """Positions of the ``limit`` smallest values of every row, row by row, in order."""
    order = np.lexsort((ties, values, rows))
    own = rows[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < limit]


def _limits(rows: np.ndarray, values: np.ndarray, n: int, limit: int) -> np.ndarray:
    """The ``limit``-th smallest value of each of ``n`` rows; infinite for rows that have fewer."""
    counts = np.bincount(rows, minlength=n)
    found = np.full(n, np.inf)
    full = counts >= limit
    widest = counts[full].max(initial=0)
    if widest > 8 * limit:  # too uneven for a matrix
        order = np.lexsort((values, rows))
        found[full] = values[order][(np.cumsum(counts) - counts)[full] + limit - 1]
    elif widest:
        order = np.argsort(rows.astype(np.uint16) if n <= 2**16 else rows, kind="stable")
        order = order[full[rows[order]]]
        own, many = np.repeat(np.arange(full.sum()), counts[full]), counts[full]
        table = np.full((len(many), widest), np.inf)
        table[own, np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)] = values[order]
        found[full] = np.partition(table, limit - 1, axis=1)[:, limit - 1]
    return found


def _leaves(units: np.ndarray, positions: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows cut in halves, in turn along the wider axis of their positions and along the main direction
    of their vectors, until a part has no more than ``size``."""
    open_, done = [(np.arange(len(units)), True)], []
    while open_:
        rows, by_position = open_.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        if by_position:
            along = positions[rows][:, np.ptp(positions[rows], axis=0).argmax()]
        else:
            own = units[rows] - units[rows].mean(axis=0)
            direction = own[(own * own).sum(axis=1).argmax()]
            for _ in range(3):
                direction = own.T @ (own @ direction)
                direction /= max(np.linalg.norm(direction), 1e-300)
            along = own @ direction
        order = np.argsort(along, kind="stable")
        half = len(rows) // 2
        open_ += [(rows[order[half:]], not by_position), (rows[order[:half]], not by_position)]
    return done


def leaf_bounds(q_units: np.ndarray, p_units: np.ndarray, leaves: list[np.ndarray]) -> np.ndarray:
    """The least cosine distance that any row of a leaf can have to each request."""
    centres = np.stack([p_units[leaf].mean(axis=0) for leaf in leaves])
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    radius = np.array([np.arccos(np.clip(p_units[leaf] @ c, -1.0, 1.0)).max() for leaf, c in zip(leaves, centres)])
    angle = np.arccos(np.clip(q_units @ centres.T, -1.0, 1.0))
    return 1.0 - np.cos(np.maximum(angle - radius - _ANGLE_MARGIN, 0.0))


def _on_sphere(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lon)
    return np.column_stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])


def _kilometres(q_lat, q_lon, p_lat, p_lon) -> np.ndarray:
    a, b = np.radians(q_lat), np.radians(p_lat)
    cosine = np.cos(a) * np.cos(b) * np.cos(np.radians(p_lon) - np.radians(q_lon)) + np.sin(a) * np.sin(b)
    return V.EARTH_RADIUS_KM * np.arccos(np.clip(cosine, -1.0, 1.0))


def block_kernel(mode: str, limit: int, counted: bool = False) -> Callable[..., pa.Table]:
    """The scoring of one (request block, place block) pair; ``counted`` gives the number of pairs of
    vectors instead, and how many of them were compared.

    With ``chosen`` a place counts only for the requests that read its ``cluster``. Hits farther than ``wanted``
    says are not wanted.
    """
    def score(requests: pa.Table, places: pa.Table, chosen: Chosen | None = None, wanted: Wanted | None = None) -> pa.Table:
        wanted = Wanted(np.full(requests.num_rows, np.inf), limit) if wanted is None else wanted
        worst = wanted.limits[:, -1]
        q = {n: _numbers(requests, n) for n in
             ("q_lat", "q_lon", "lat_min", "lat_max", "lon_min", "lon_max", "min_rating", "max_price")}
        by_id = np.argsort(_numbers(places, "id"))  # column order is then the tie-break
        p = {n: _numbers(places, n)[by_id] for n in ("p_lat", "p_lon", "rating", "price")}
        q_dims, q_vectors = _vectors(requests, "query_vector")
        p_dims, p_vectors = _vectors(places, "embedding")
        found = []  # (request rows, place rows, cosine or other distances, rounds)

        def eligible(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
            """Box and filters; a condition that all these rows and columns meet is not spelled out."""
            mask = np.ones((len(rows), len(cols)), dtype=bool)
            for name, low, high in (("p_lat", "lat_min", "lat_max"), ("p_lon", "lon_min", "lon_max")):
                values = p[name][cols]
                if q[low][rows].max() > values.min():
                    mask &= values >= q[low][rows, None]
                if q[high][rows].min() < values.max():
                    mask &= values <= q[high][rows, None]
            least, most = q["min_rating"][rows, None], q["max_price"][rows, None]
            rating, price = p["rating"][cols], p["price"][cols]
            if not (least <= 0).all() and not least.max() <= rating.min():
                mask &= (least <= 0) | (rating >= least)
            if not (most < 0).all() and not np.where(most < 0, np.inf, most).min() >= price.max():
                mask &= (most < 0) | (price <= most)
            return mask

        def passes(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
            """Box and filters of single pairs."""
            mask = np.ones(len(rows), dtype=bool)
            for name, low, high in (("p_lat", "lat_min", "lat_max"), ("p_lon", "lon_min", "lon_max")):
                mask &= (p[name][cols] >= q[low][rows]) & (p[name][cols] <= q[high][rows])
            least, most = q["min_rating"][rows], q["max_price"][rows]
            return mask & ((least <= 0) | (p["rating"][cols] >= least)) & ((most < 0) | (p["price"][cols] <= most))

        def alike(rows: np.ndarray, cols: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            """Positions in ``rows`` and ``cols`` to score together. A large group goes filter by filter,
            so that places a filter drops are not scored at all."""
            parts = [(np.arange(len(rows)), np.arange(len(cols)))]
            if len(rows) * len(cols) > _SPLIT_BY_FILTER:
                limits = np.stack([np.maximum(q["min_rating"][rows], 0), q["max_price"][rows]], axis=1)
                kinds, kind = np.unique(limits, axis=0, return_inverse=True)
                parts = [
                    (np.flatnonzero(kind == i), np.flatnonzero(
                        ((least <= 0) | (p["rating"][cols] >= least)) & ((most < 0) | (p["price"][cols] <= most))))
                    for i, (least, most) in enumerate(kinds)
                ]
            return [(i, j) for i, j in parts if len(i) and len(j)]

        def batches(parts: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray, cols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Neighbouring requests together, each batch with the places inside the hull of its boxes."""
            for i, j in parts:
                lat, lon = q["q_lat"][rows[i]], q["q_lon"][rows[i]]
                strips = math.ceil(math.sqrt(len(i) / _CHUNK))
                strip = np.empty(len(i), dtype=np.int64)
                strip[np.argsort(lat, kind="stable")] = np.arange(len(i)) * strips // len(i)
                i = i[np.lexsort((lon, strip))]
                p_lat, p_lon = p["p_lat"][cols[j]], p["p_lon"][cols[j]]
                for start in range(0, len(i), _CHUNK):
                    some = i[start : start + _CHUNK]
                    own = {n: q[n][rows[some]] for n in ("lat_min", "lat_max", "lon_min", "lon_max")}
                    inside = ((p_lat >= own["lat_min"].min()) & (p_lat <= own["lat_max"].max())
                              & (p_lon >= own["lon_min"].min()) & (p_lon <= own["lon_max"].max()))
                    if inside.any():
                        yield some, j[inside]

        def reachable(rows: np.ndarray, cols: list[np.ndarray]) -> np.ndarray:
            """Whether a leaf's ranges meet a request's box and filters at all."""
            inside = np.ones((len(rows), len(cols)), dtype=bool)
            for name, low, high in (("p_lat", "lat_min", "lat_max"), ("p_lon", "lon_min", "lon_max")):
                inside &= q[low][rows, None] <= np.array([p[name][c].max() for c in cols])
                inside &= q[high][rows, None] >= np.array([p[name][c].min() for c in cols])
            least, most = q["min_rating"][rows, None], q["max_price"][rows, None]
            inside &= (least <= 0) | (np.array([p["rating"][c].max() for c in cols]) >= least)
            return inside & ((most < 0) | (np.array([p["price"][c].min() for c in cols]) <= most))

        def compared(q_rows, q_units, p_rows, p_units) -> np.ndarray:
            # Rounded so that equal vectors tie in every block, whatever its shape.
            distances = np.round(1.0 - q_units @ p_units.T, 12)
            distances[~eligible(q_rows, p_rows)] = np.inf
            return distances

        def close(q_rows, q_units, rows, p_rows, p_units, cols, farthest: np.ndarray, rough: tuple[np.ndarray, np.ndarray] | None = None
                  ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Eligible pairs of ``rows`` and ``cols`` no farther than the row's ``farthest``, and their distances; of rows with
            many such pairs only the ``limit`` best. With ``rough`` (the vectors in single precision) and every ``farthest``
            known, pairs are told by a product with an error bound, and few are compared in double."""
            if rough is not None and np.isfinite(farthest).all():
                margin = (q_units.shape[1] + 8) * 2.0**-23  # more than the error of a sum of so many products of unit vectors
                near = rough[0][rows] @ rough[1][cols].T >= (1.0 - farthest - margin).astype(np.float32)[:, None]
                if np.count_nonzero(near) * _SPARSE <= near.size:
                    at, col = np.divmod(np.flatnonzero(near), len(cols))
                    kept = passes(q_rows[rows[at]], p_rows[cols[col]])
                    at, col = at[kept], col[kept]
                    distances = np.round(1.0 - np.einsum("ij,ij->i", q_units[rows[at]], p_units[cols[col]]), 12)
                    kept = distances <= farthest[at]
                    return rows[at[kept]], cols[col[kept]], distances[kept]
            values = compared(q_rows[rows], q_units[rows], p_rows[cols], p_units if len(cols) == len(p_units) else p_units[cols])
            values[values > farthest[:, None]] = np.inf
            at, col = np.divmod(np.flatnonzero(np.isfinite(values)), len(cols))
            if len(at) > limit * len(rows):
                at, col = _smallest(values, limit)
            return rows[at], cols[col], values[at, col]

        def by_leaves(q_rows, q_units, p_rows, p_units, leaves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
            """The ``limit`` best of every request and what ties with the last, as rows, columns and distances, and the
            pairs compared."""
            leaves = [np.sort(leaf) for leaf in leaves]
            lower = leaf_bounds(q_units, p_units, leaves)
            lower[~reachable(q_rows, [p_rows[leaf] for leaf in leaves])] = np.inf
            # No hit beyond it can be an answer; it lags behind the hits until they are merged.
            bound = worst[q_rows]
            rough = q_units.astype(np.float32), p_units.astype(np.float32)
            visited = ~np.isfinite(lower)
            first = lower.argmin(axis=1)
            hits = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]  # rows, columns, distances
            fresh = scored = 0

            def merge() -> None:
                nonlocal fresh
                rows, columns, distances = (np.concatenate(part) for part in zip(*hits))
                np.minimum(bound, _limits(rows, distances, len(bound), limit), out=bound)
                kept = np.flatnonzero(distances <= bound[rows])
                if len(kept) > 2 * limit * len(bound):  # many at one distance
                    kept = _first(rows, columns, distances, limit)
                hits[:] = [(rows[kept], columns[kept], distances[kept])]
                fresh = 0

            def visit(rows: np.ndarray, number: int) -> None:
                nonlocal fresh, scored
                leaf = leaves[number]
                visited[rows, number] = True
                scored += len(rows) * len(leaf)
                bounded = np.isfinite(bound[rows])
                for known in (rows[bounded], rows[~bounded]):
                    for start in range(0, len(known), _VISITORS):
                        some = known[start : start + _VISITORS]
                        hits.append(close(q_rows, q_units, some, p_rows, p_units, leaf, bound[some], rough))
                        fresh += len(hits[-1][0])

            for number in np.unique(first):
                visit(np.flatnonzero((first == number) & ~visited[:, number]), number)
            merge()
            for number in np.argsort(np.where(np.isfinite(lower), lower, 2.0).mean(axis=0), kind="stable"):
                visit(np.flatnonzero(~visited[:, number] & (lower[:, number] <= bound)), number)
                if fresh > limit * len(q_rows) / 2:
                    merge()
            merge()
            return *hits[0], scored

        def by_clusters(q_rows, q_units, p_rows, p_units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
            """What is wanted of the clusters that each request reads, as rows, columns, distances and rounds, and the
            pairs compared."""
            own, number = np.unique(_numbers(places, "cluster")[by_id][p_rows], return_inverse=True)
            order = np.argsort(number, kind="stable")
            rough = q_units.astype(np.float32), p_units.astype(np.float32)
            step = max(1, _READS // len(own))
            done = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
            scored = 0

            def of_filter(rows: np.ndarray, cols: np.ndarray, when: np.ndarray, least: np.ndarray) -> None:
                """Requests of one filter and the places that pass it, cluster by cluster; neighbouring clusters together
                where most are wanted."""
                nonlocal scored
                bounds, hits, fresh = wanted.of(q_rows[rows]), done[:1], 0

                def merged() -> list[tuple[np.ndarray, ...]]:
                    own, columns, distances, rounds = (np.concatenate(part) for part in zip(*hits))
                    bounds.update(own, rounds, distances)
                    kept = np.flatnonzero(bounds.near(own, rounds, distances))
                    if len(kept) > 2 * limit * bounds.limits.size:  # many at one distance
                        kept = bounds.first(own, columns, rounds, distances)
                    return [(own[kept], columns[kept], distances[kept], rounds[kept])]

                def add(own: np.ndarray, columns: np.ndarray, distances: np.ndarray) -> None:
                    nonlocal fresh
                    rounds = when[own, number[columns]].astype(np.int64)
                    kept = bounds.near(own, rounds, distances)
                    hits.append((own[kept], columns[kept], distances[kept], rounds[kept]))
                    fresh += len(hits[-1][0])

                def visit(own: np.ndarray, columns: np.ndarray) -> None:
                    nonlocal scored
                    # Where the rounds want other hits than all of them, each round is cut to its best by itself.
                    plain = np.isfinite(bounds.farthest[own, 0]) & (bounds.farthest[own, 0] == bounds.farthest[own, -1])
                    some = own[plain]
                    for start in range(0, len(some), _VISITORS):
                        part = some[start : start + _VISITORS]
                        scored += len(part) * len(columns)
                        at, cols, distances = close(q_rows, q_units, rows[part], p_rows, p_units, columns, bounds.farthest[part, 0], rough)
                        add(np.searchsorted(rows, at), cols, distances)
                    if plain.all():
                        return
                    for part, inside in batches([(own[~plain], np.arange(len(columns)))], q_rows[rows], p_rows[columns]):
                        near = columns[inside]
                        scored += len(part) * len(near)
                        values = compared(q_rows[rows[part]], q_units[rows[part]], p_rows[near], p_units[near])
                        of = when[part[:, None], number[near]]
                        for one in np.unique(of[of >= 0]):
                            at, col = _smallest(np.where(of == one, values, np.inf), limit)
                            add(part[at], near[col], values[at, col])

                steps = [0, *range(min(LEAF, len(cols)), len(cols), _CLUSTER_ROWS), len(cols)]
                every = np.arange(len(rows))
                for columns in (cols[a:b] for a, b in zip(steps[:-1], steps[1:])):
                    clusters = slice(number[columns[0]], number[columns[-1]] + 1)
                    columns = np.sort(columns)  # the order of their ids
                    of = when[:, clusters]
                    reach = np.arccos(np.clip(1.0 - bounds.farthest, -1.0, 1.0)) + _ANGLE_MARGIN
                    if of.min() >= 0 and (least[:, clusters].max(axis=1) <= reach[:, -1]).all():
                        visit(every, columns)
                    else:
                        need = (of >= 0) & (least[:, clusters] <= np.take_along_axis(reach, np.maximum(of, 0).astype(np.int64), axis=1))
                        some = need.any(axis=1)
                        if need.mean() > 0.5 and of[some].min() >= 0:
                            visit(every[some], columns)
                        else:
                            for n in np.flatnonzero(need.any(axis=0)):
                                visit(np.flatnonzero(need[:, n]), columns[number[columns] == clusters.start + n])
                    if fresh > limit * len(rows) / 2:
                        hits, fresh = merged(), 0
                for own, *found in merged() if fresh > limit * len(rows) / 4 else hits:
                    done.append((rows[own], *found))

            for first in range(0, len(q_rows), step):
                asked = np.arange(first, min(first + step, len(q_rows)))
                when, least = chosen.rounds(requests, q_rows[asked], q_units[asked], own)
                for i, j in alike(q_rows[asked], p_rows[order]):
                    of_filter(asked[i], order[j], when[i], least[i])
            return *(np.concatenate(part) for part in zip(*done)), scored

        pairs = scored = 0
        for dim in np.unique(q_dims[q_dims > 0]) if mode != DISTANCE else ():
            p_rows, p_units = _unit_rows(p_vectors, np.flatnonzero(p_dims[by_id] == dim), dim, by_id)
            q_rows, q_units = _unit_rows(q_vectors, np.flatnonzero(q_dims == dim), dim)
            pairs += len(q_rows) * len(p_rows)
            if chosen is not None and len(q_rows) and len(p_rows):
                at, cols, distances, rounds, n = by_clusters(q_rows, q_units, p_rows, p_units)
                found.append((q_rows[at], p_rows[cols], distances, rounds))
                scored += n
                continue
            small, large = [], []
            for part in alike(q_rows, p_rows):
                (large if len(part[0]) * len(part[1]) > _LEAF_PAIRS and len(part[1]) > LEAF else small).append(part)
            for i, j in batches(small, q_rows, p_rows):
                at, cols, distances = close(q_rows, q_units, i, p_rows, p_units, j, worst[q_rows[i]])
                found.append((q_rows[at], p_rows[cols], distances, np.zeros(len(at), np.int64)))
                scored += len(i) * len(j)
            leaves = _leaves(p_units, np.column_stack([p["p_lat"][p_rows], p["p_lon"][p_rows]]), LEAF) if large else []
            for i, j in large:
                wanted = np.zeros(len(p_units), dtype=bool)
                wanted[j] = True
                own = [leaf[wanted[leaf]] for leaf in leaves if wanted[leaf].any()]
                at, cols, distances, n = by_leaves(q_rows[i], q_units[i], p_rows, p_units, own)
                found.append((q_rows[i[at]], p_rows[cols], distances, np.zeros(len(at), np.int64)))
                scored += n
        if counted:
            return pa.table({"pairs": pa.array([pairs], pa.int64()), "scored": pa.array([scored], pa.int64())})

        every, near = (np.arange(n if mode == DISTANCE else 0) for n in (len(q_dims), len(by_id)))
        asked, offered = (_on_sphere(side[lat], side[lon]) if len(rows) else None for side, lat, lon, rows in (
            (q, "q_lat", "q_lon", every), (p, "p_lat", "p_lon", near)))
        for i, j in batches(alike(every, near), every, near):
            rows, columns = every[i], near[j]
            # The nearest by the cosine of the distance, with a margin; only these are measured in kilometres.
            cosines = asked[rows] @ offered[columns].T
            cut = np.cos(np.minimum(worst[rows] / V.EARTH_RADIUS_KM, np.pi))
            if np.isfinite(worst[rows]).all():
                at, cols = np.divmod(np.flatnonzero(cosines >= cut[:, None] - _COSINE_MARGIN), len(columns))
                kept = passes(rows[at], columns[cols])
                at, cols = at[kept], cols[kept]
            else:
                cosines[~eligible(rows, columns)] = -np.inf
                if len(columns) > limit:
                    cut = np.maximum(cut, np.partition(cosines, len(columns) - limit, axis=1)[:, len(columns) - limit])
                at, cols = np.nonzero((cosines >= cut[:, None] - _COSINE_MARGIN) & np.isfinite(cosines))
            kilometres = _kilometres(q["q_lat"][rows[at]], q["q_lon"][rows[at]], p["p_lat"][columns[cols]], p["p_lon"][columns[cols]])
            kept = _first(at, cols, kilometres, limit)
            found.append((rows[at[kept]], columns[cols[kept]], kilometres[kept], np.zeros(len(kept), np.int64)))

        empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64), np.empty(0, np.int64))
        q_index, p_index, away, rounds = (np.concatenate(part) for part in zip(empty, *found))
        hits = {"row": pa.array(q_index), "away": pa.array(away), "round": pa.array(rounds)}
        return pa.table(hits | {name: places[name].take(pa.array(by_id[p_index])) for name in ("id", "p_lat", "p_lon")})

    return score


def group_kernel(mode: str, limit: int, request_rows: int, place_rows: int, counted: bool = False,
                 chosen: Chosen | None = None, packed: bool = False) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The scoring of one (request tile, place tile) group, block by block: the ``limit`` best of every request, with
    ``chosen`` also what is wanted of the rounds, and the round of each.

    They are a row each, or with ``packed`` the list ``hits`` of their request's one row.
    """
    score = block_kernel(mode, limit, counted)
    of_request = ["qid", "q_lat", "q_lon", "max_km"] + (["beyond"] if chosen is not None else [])

    def rows(asked: pa.Table, best: pa.Table) -> pa.Table:
        own = _numbers(best, "row")
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if packed and len(own) else np.arange(len(own))
        columns = {name: asked[name].take(pa.array(own[first])) for name in of_request}
        hits = {name: best[name].combine_chunks() for name in ("id", "p_lat", "p_lon")}
        hits["cos_dist"] = best["away"].combine_chunks() if mode == VECTOR else pa.nulls(best.num_rows, pa.float64())
        if chosen is not None:
            hits["round"] = best["round"].combine_chunks().cast(pa.int32())
        if packed:
            listed = pa.StructArray.from_arrays(list(hits.values()), names=list(hits))
            hits = {"hits": pa.ListArray.from_arrays(pa.array(np.r_[first, len(own)], pa.int32()), listed)}
        return pa.table(columns | hits | {"semantic": pa.array(np.full(len(first), mode == VECTOR))})

    def tile(requests: pa.Table, places: pa.Table) -> pa.Table:
        # Requests of one filter and neighbouring ones share blocks, and so do the places of a cluster.
        strip = np.floor(_numbers(requests, "q_lat") * 50)
        order = np.lexsort((_numbers(requests, "q_lon"), strip, _numbers(requests, "max_price"), _numbers(requests, "min_rating")))
        by_cluster = np.argsort(_numbers(places, "cluster"), kind="stable") if chosen is not None else None
        found = []
        for first in range(0, requests.num_rows, request_rows):
            asked = requests.take(pa.array(order[first : first + request_rows])).combine_chunks()
            worst = _numbers(asked, "worst") if chosen is not None else np.full(asked.num_rows, np.inf)
            wanted = Wanted(worst, limit, chosen.until(asked) if chosen is not None else None)
            best = None
            for start in range(0, places.num_rows, place_rows):
                part = places.slice(start, place_rows) if chosen is None else places.take(pa.array(by_cluster[start : start + place_rows]))
                hits = score(asked, part.combine_chunks(), chosen, wanted)
                if counted:
                    found.append(hits)
                else:
                    best = hits if best is None else pa.concat_tables([best, hits])
                    # What is farther than the last of these is no hit, in later blocks neither.
                    wanted.update(*(_numbers(best, name) for name in ("row", "round", "away")))
                    best = best.filter(pa.array(wanted.near(*(_numbers(best, name) for name in ("row", "round", "away")))))
                    if best.num_rows > 2 * limit * wanted.limits.size:  # many at one distance
                        best = best.take(pa.array(wanted.first(*(_numbers(best, name) for name in ("row", "id", "round", "away")))))
            if counted or best is None:
                continue
            found.append(rows(asked, best.take(pa.array(wanted.first(*(_numbers(best, name) for name in ("row", "id", "round", "away")))))))
        if found:
            return pa.concat_tables(found)
        if counted:
            return pa.schema({"pairs": pa.int64(), "scored": pa.int64()}).empty_table()
        nothing = pa.schema({"row": pa.int64(), "away": pa.float64(), "round": pa.int64(), "id": pa.int64(),
                             "p_lat": pa.float64(), "p_lon": pa.float64()})
        return rows(requests, nothing.empty_table())

    return tile


def _in_tiles(rows: DataFrame, cells: Column, own: str, other: str, directory: DataFrame,
               row_key: list[str], broadcast: bool, tile_key: list[Column | str] | None = None) -> DataFrame:
    """Key every row by cell and tile, once per tile of the other side; rows of one ``tile_key`` share a tile."""
    keys = [c for c in directory.columns if not c.endswith("_tiles") and c != "passed"]

    def in_cells(columns: list[str]) -> DataFrame:
        return rows.select(*columns, cells.alias("cell")).select(*columns, "cell.*")

    if broadcast:
        placed = in_cells([c for c in rows.columns if c not in keys]).join(F.broadcast(directory), keys)
    else:
        # Too many cells to broadcast: look the cells up with bare keys, then fetch the rows.
        placed = rows.drop(*keys).join(in_cells(row_key).join(directory, keys), row_key)
    placed = placed.withColumn(f"{own}_tile", F.pmod(F.xxhash64(F.lit(own), *(tile_key or row_key)), f"{own}_tiles"))
    replicas = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_tiles") - 1))
    return placed.withColumn(f"{other}_tile", replicas).drop("request_tiles", "place_tiles")


def unpacked(found: DataFrame) -> DataFrame:
    """A row per hit. The lists are brought together by request first, so what a hit has of its request is
    moved once per list; what groups the rows by ``qid`` afterwards need not move them again."""
    return found.repartition("qid").select(*(c for c in found.columns if c != "hits"), F.inline("hits"))


def _row_bytes(vector: str) -> Column:
    return F.coalesce(F.size(vector), F.lit(0)) * 4 + _ROW_BYTES


def blocked_hits(requests: DataFrame, places: DataFrame, request_cells: Column, place_cells: Column, *,
                 mode: str, limit: int, request_block: tuple[int, int] = REQUEST_BLOCK,
                 place_block: tuple[int, int] = PLACE_BLOCK, broadcast_cells: int = BROADCAST_CELLS,
                 counted: bool = False, chosen: Chosen | None = None, packed: bool = False,
                 together: list[Column | str] | None = None) -> DataFrame:
    """Hits per request and pair of tiles: at most ``limit`` rows of each pair, with ``packed`` one row with a
    list, or with ``counted`` a row per pair of blocks: its ``pairs`` of vectors, and how many were ``scored``.

    ``request_cells`` and ``place_cells`` are exploding expressions that yield one struct per
    cell. The directory of cells occupied on both sides is written once; it decides how
    many tiles a cell needs, drops the cells in which no place passes a request's filter, and is
    broadcast only when its row count allows it. ``chosen`` gives the clusters that a request reads; then
    requests carry ``worst``, a distance beyond which they want no hits, and ``beyond``, which their hits get,
    and places their ``cluster``. Places alike in ``together``, which must be few, go to one tile.
    """
    cell_requests = requests.select(_row_bytes("query_vector").alias("bytes"), request_cells.alias("cell"))
    keys = cell_requests.select("cell.*").columns
    request_counts = cell_requests.select("bytes", "cell.*").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_requests"), F.sum("bytes").alias("request_bytes"))
    cell_places = places.withColumn("passed", passed_filters()).select(
        "passed", _row_bytes("embedding").alias("bytes"), place_cells.alias("cell"))
    place_counts = cell_places.select("passed", "bytes", "cell.*").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_places"), F.sum("bytes").alias("place_bytes"), F.bit_or("passed").alias("passed"))
    directory = materialize(request_counts.join(place_counts, keys), "cells")
    several = F.least(F.ceil(F.col("n_requests") / F.lit(request_block[0])), F.lit(_TILES_PER_CELL))
    directory = directory.withColumns({
        "request_tiles": F.greatest(several, F.ceil(F.col("request_bytes") / F.lit(REQUEST_TILE_BYTES))),
        "place_tiles": F.ceil(F.col("place_bytes") / F.lit(PLACE_TILE_BYTES))})
    pairs = F.col("n_requests") * F.col("n_places").cast("double")
    rows = F.col("n_requests").cast("double") * F.col("place_tiles") + F.col("n_places") * F.col("request_tiles")
    size = directory.agg(F.count(F.lit(1)).alias("cells"), F.sum(pairs).alias("pairs"), F.sum(rows).alias("rows"),
                         F.sum(F.col("request_tiles") * F.col("place_tiles")).alias("groups")).first()
    small = size["cells"] <= broadcast_cells
    directory = directory.drop("n_requests", "n_places", "request_bytes", "place_bytes")
    # Tasks are sized by the pairs they score and the rows they receive, with work for every core.
    wanted = math.ceil(max((size["pairs"] or 0.0) / TASK_PAIRS, (size["rows"] or 0.0) / TASK_ROWS))
    tasks = max(requests.sparkSession.sparkContext.defaultParallelism, min(wanted, 2 * (size["groups"] or 0), MAX_TASKS))

    left = _in_tiles(requests, request_cells, "request", "place", directory, ["qid"], small)
    possible = F.col("filter_number").isNull() | (F.getbit("passed", F.coalesce("filter_number", F.lit(0))) == 1)
    left = left.where(possible).drop("passed", "filter_number")
    right = _in_tiles(places, place_cells, "place", "request", directory.drop("passed"), ["id"], small, together)
    group = [*keys, "request_tile", "place_tile"]
    left, right = (side.repartition(tasks, *group) for side in (left, right))
    qid_type = requests.schema["qid"].dataType.simpleString()
    beyond, number = ("", "") if chosen is None else ("beyond array<double>, ", ",round:int")
    schema = (f"qid {qid_type}, q_lat double, q_lon double, max_km double, {beyond}"
              f"hits array<struct<id:bigint,p_lat:double,p_lon:double,cos_dist:double{number}>>, semantic boolean")
    schema = "pairs bigint, scored bigint" if counted else schema
    kernel = group_kernel(mode, limit, request_block[1], place_block[1], counted, chosen, packed=not counted)
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(kernel, schema)
    return found if counted or packed else unpacked(found)
