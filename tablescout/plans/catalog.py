"""Catalog jobs: cutting a sample from the raw export, loading the catalog, filling in vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablescout import fixed_values as V
from tablescout.operators import backfill, ingest, sampling
from tablescout.sources import catalog, store


def sample_export(spark: SparkSession, source: str, out: str, size: int = V.SAMPLE_SIZE,
                  multi_line: bool = True) -> DataFrame:
    """Write a sample of the raw export as a flat JSON catalog; returns the centre of the densest metro."""
    raw = catalog.read_raw_merchants(spark, source, multi_line)
    flat = ingest.flatten_merchants(ingest.usable(raw))
    sample = sampling.sample_catalog(flat, size, position="input_pos").orderBy("sample_order")
    catalog.write_json(sample.drop("densest", "sample_order", "input_pos"), out)
    return sampling.centroid(flat, "input_pos")


def refresh(spark: SparkSession, source: str, root: str, embedder: backfill.Embedder | None = None,
            only_if_empty: bool = True, multi_line: bool = True, **options) -> DataFrame:
    """Load the catalog if it is empty, then compute missing vectors; returns the current places.

    Places whose text could not be embedded stay pending for the next call.
    """
    ingest.ingest(spark, source, root, only_if_empty, multi_line)
    if embedder is not None:
        fill_vectors(spark, root, embedder, **options)
        store.compact(spark, root)
    return catalog.load_places(spark, root)


def fill_vectors(spark: SparkSession, root: str, embedder: backfill.Embedder, **options) -> int:
    """Vectors for the places that lack one; only these are written. Returns their number."""
    pending = backfill.pending(catalog.load_places(spark, root))
    return store.write_vectors(backfill.pending_vectors(pending, embedder, **options), root)
