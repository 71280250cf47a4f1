"""The catalog as base files and a log of changes: a write of ``k`` rows writes about ``k`` rows.

Under the root lie a base (laid out along a curve, see ``layout``), deltas, and commits. A commit is a small
numbered file that names the base and the deltas in force; readers take the newest one that is
complete, so what a failed write leaves behind is never seen, and a running reader keeps its files.

A delta holds whole rows (``row``, which replace every column but the vector, as an upsert does) or vectors
(``vector``). Reading joins the base with the latest change of each id on the way; the changes
are broadcast if their measured size allows it. ``compact`` writes them into a new base.

Commits are numbered by exclusive creation of a file. Two writers that meet retry on the other's
commit: changes of the same id are ordered by commit. A file system without exclusive creation needs
a single writer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tablescout import schemas
from tablescout.session import materialize
from tablescout.sources import layout

#: Changes are broadcast to the base's scan up to this many bytes; ids (eight bytes each) up to this many.
BROADCAST_BYTES, BROADCAST_IDS = 64 << 20, 2_000_000
#: Deltas are written into a new base when they hold more than this part of its rows.
COMPACT_SHARE = 0.1
_ATTEMPTS = 20

_COLUMNS = [f.name for f in schemas.PLACES.fields]
_REPLACED = [c for c in _COLUMNS if c not in ("id", "embedding")]
_DELTA = T.StructType([T.StructField("kind", T.StringType()), T.StructField("fresh", T.BooleanType()),
                       *(T.StructField(f.name, f.dataType) for f in schemas.PLACES.fields)])


@dataclass(frozen=True)
class Delta:
    """A folder of changes, with its rows and bytes in memory."""

    name: str
    rows: int
    size: int


@dataclass(frozen=True)
class Snapshot:
    """What a commit puts in force."""

    version: int = 0
    base: str | None = None
    base_rows: int = 0
    deltas: tuple[Delta, ...] = ()

    @property
    def delta_rows(self) -> int:
        return sum(d.rows for d in self.deltas)


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    own = jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, root: str) -> list[str]:
    path, files = _files(spark, f"{root}/log")
    if not files.exists(path):
        return []
    return sorted((s.getPath().getName() for s in files.listStatus(path) if s.getPath().getName().endswith(".json")), reverse=True)


def snapshot(spark: SparkSession, root: str) -> Snapshot:
    """The newest complete commit; an empty one where there is none."""
    return _newest(spark, root, _commits(spark, root))


def _newest(spark: SparkSession, root: str, names: list[str]) -> Snapshot:
    for name in names:
        row = spark.read.text(f"{root}/log/{name}", wholetext=True).first()
        try:
            found = json.loads(row[0]) if row else None
        except json.JSONDecodeError:
            found = None  # its writer was stopped
        if found:
            return Snapshot(found["version"], found["base"], found["base_rows"], tuple(Delta(**d) for d in found["deltas"]))
    return Snapshot()


def _commit(spark: SparkSession, root: str, change: Callable[[Snapshot], Snapshot | None]) -> bool:
    """Put ``change`` of the newest snapshot in force; it is asked again if another writer was faster."""
    for _ in range(_ATTEMPTS):
        names = _commits(spark, root)  # one look: a commit after it takes the number that is asked for below
        new = change(_newest(spark, root, names))
        if new is None:
            return False
        new = replace(new, version=max((int(n.removesuffix(".json")) for n in names), default=0) + 1)
        path, files = _files(spark, f"{root}/log/{new.version:020d}.json")
        try:
            stream = files.create(path, False)
        except Py4JJavaError:
            if files.exists(path):
                continue
            raise
        stream.write(bytearray(json.dumps(asdict(new)).encode()))
        stream.close()
        return True
    raise RuntimeError(f"{root}: other writers were faster {_ATTEMPTS} times")


def _fitted(places: DataFrame) -> DataFrame:
    """The catalog's columns in its types; columns that are absent are NULL, arrays empty."""
    def column(field: T.StructField):
        if field.name in places.columns:
            return F.col(field.name).cast(field.dataType.simpleString()).alias(field.name)
        return F.lit(None).cast(field.dataType.simpleString()).alias(field.name)

    return places.select(*map(column, schemas.PLACES.fields))


def _changes(spark: SparkSession, root: str, now: Snapshot) -> DataFrame:
    """The latest row and the latest vector of every changed id."""
    parts = [spark.read.schema(_DELTA).parquet(f"{root}/{d.name}").withColumn("place", F.lit(i)) for i, d in enumerate(now.deltas)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("id").agg(
        F.max_by(F.struct(*_REPLACED), F.when(F.col("kind") == "row", F.col("place"))).alias("row"),
        F.max_by("embedding", F.when(F.col("kind") == "vector", F.col("place"))).alias("vector"),
        F.bool_or("fresh").alias("fresh"))


def _merged(spark: SparkSession, root: str, now: Snapshot) -> DataFrame:
    if now.base is None:
        base = spark.createDataFrame([], schemas.PLACES)
    else:
        base = spark.read.schema(schemas.PLACES).parquet(f"{root}/{now.base}")
    if not now.deltas:
        return base
    changes = _changes(spark, root, now)
    beside = F.broadcast(changes) if sum(d.size for d in now.deltas) <= BROADCAST_BYTES else changes
    b, c = base.alias("b"), beside.alias("c")
    changed = [F.when(F.col("c.row").isNotNull(), F.col(f"c.row.{n}")).otherwise(F.col(f"b.{n}")).alias(n) for n in _REPLACED]
    old = b.join(c, F.col("b.id") == F.col("c.id"), "left").select(
        F.col("b.id").alias("id"), *changed, F.coalesce("c.vector", "b.embedding").alias("embedding"))
    new = changes.where(F.col("fresh")).select("id", *(F.col(f"row.{n}").alias(n) for n in _REPLACED), F.col("vector").alias("embedding"))
    return old.select(*_COLUMNS).unionByName(new.select(*_COLUMNS))


def read(spark: SparkSession, root: str) -> DataFrame:
    """The catalog as the newest commit has it."""
    return _merged(spark, root, snapshot(spark, root))


def _write_base(places: DataFrame, root: str, files: int | None) -> tuple[str, int]:
    name = f"base-{uuid.uuid4().hex}"
    return name, layout.write_layout(_fitted(places), f"{root}/{name}", files)


def replace_all(places: DataFrame, root: str, files: int | None = None) -> None:
    """A new base; every earlier change is out of force."""
    name, rows = _write_base(places, root, files)
    _commit(places.sparkSession, root, lambda now: Snapshot(base=name, base_rows=rows))


def load_if_empty(places: DataFrame, root: str, files: int | None = None) -> bool:
    """A base for a catalog without rows; False, and nothing is done, for any other."""
    spark = places.sparkSession
    now = snapshot(spark, root)
    if now.base_rows or now.delta_rows:
        return False
    name, rows = _write_base(places, root, files)
    return _commit(spark, root, lambda now: None if now.base_rows or now.delta_rows else Snapshot(base=name, base_rows=rows))


def _append(rows: DataFrame, root: str) -> int:
    """Write a delta and put it in force; returns its rows."""
    spark = rows.sparkSession
    name = f"delta-{uuid.uuid4().hex}"
    rows.select(*(F.col(f.name).cast(f.dataType.simpleString()).alias(f.name) for f in _DELTA.fields)).write.parquet(f"{root}/{name}")
    stored = spark.read.schema(_DELTA).parquet(f"{root}/{name}")
    texts = [f.name for f in _DELTA.fields if isinstance(f.dataType, T.StringType)]
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(200))
    width = width + 4 * F.greatest(F.coalesce(F.size("embedding"), F.lit(0)), F.lit(0))
    for lists in ("cuisines", "features"):
        width = width + F.coalesce(F.octet_length(F.array_join(lists, "  ")) + 16 * F.size(lists), F.lit(0))
    size = stored.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("size")).first()
    if size["rows"]:
        _commit(spark, root, lambda now: replace(now, deltas=(*now.deltas, Delta(name, size["rows"], size["size"]))))
    return size["rows"]


def upsert(new: DataFrame, root: str) -> int:
    """Rows of ``new`` inserted or replaced by id; vectors stay. Returns the rows written.

    The later input row wins inside one load. Which ids are new is found by a scan of the base's ids
    alone, so a reader need not look.
    """
    spark = new.sparkSession
    if "input_pos" not in new.columns:
        new = new.withColumn("input_pos", F.monotonically_increasing_id())
    last = Window.partitionBy("id").orderBy(F.desc("input_pos"))
    rows = materialize(_fitted(new.withColumn("_n", F.row_number().over(last)).where("_n = 1")), "upsert")
    ids = rows.select("id")
    known = _merged(spark, root, snapshot(spark, root)).select("id")
    few = rows.count() <= BROADCAST_IDS
    known = materialize(known.join(F.broadcast(ids) if few else ids, "id", "left_semi"), "known")
    known = known.select(F.col("id"), F.lit(True).alias("_known"))
    fresh = rows.join(F.broadcast(known) if few else known, "id", "left").withColumn("fresh", F.col("_known").isNull())
    return _append(fresh.withColumn("kind", F.lit("row")).withColumn("embedding", F.lit(None).cast("array<float>")), root)


def write_vectors(vectors: DataFrame, root: str) -> int:
    """Vectors of ``vectors(id, embedding)`` put in force; NULL ones are left out. Returns the rows written.

    Ids the catalog does not have get no row of their own.
    """
    rows = vectors.where(F.col("embedding").isNotNull()).select("id", "embedding")
    rest = [F.lit(None).cast(f.dataType.simpleString()).alias(f.name) for f in schemas.PLACES.fields if f.name not in ("id", "embedding")]
    return _append(rows.select("id", "embedding", *rest, F.lit("vector").alias("kind"), F.lit(False).alias("fresh")), root)


def compact(spark: SparkSession, root: str, share: float = COMPACT_SHARE, files: int | None = None) -> bool:
    """Write the changes into a new base if they are more than ``share`` of it; deltas that were added meanwhile stay."""
    seen = snapshot(spark, root)
    if not seen.deltas or seen.delta_rows <= share * seen.base_rows:
        return False
    name, rows = _write_base(_merged(spark, root, seen), root, files)

    def change(now: Snapshot) -> Snapshot | None:
        if now.base != seen.base or now.deltas[: len(seen.deltas)] != seen.deltas:
            return None  # another base came into force
        return Snapshot(base=name, base_rows=rows, deltas=now.deltas[len(seen.deltas) :])

    return _commit(spark, root, change)
