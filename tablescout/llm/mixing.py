"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. A document's size is its number of words. Sources in code point order, NULL last, weigh
   ``weights`` in turn and share ``share`` of all words; no target exceeds ``most`` times its source, what is
   above is shared again by weight.
2. The mix is cut into blocks of ``block`` words; sources get whole blocks by the highest quotients
   of their targets. Documents of a source are dealt by hash over shards of bounded size, and the
   shards get their source's blocks by the highest quotients of their words.
3. A shard is a ring: its documents one after another in the order of a seeded hash, cut into equal blocks.
   The quota is whole rounds of the ring, and for the rest a run of blocks from a seeded block on. So
   documents are taken whole but for the two ends of a run.

All numbers are whole words, so reruns agree on any partitioning. Defined results: a NULL or blank
text has size 0 and nothing of it is taken. Rows that repeat a ``doc_id`` are documents of their own.
A NULL ``doc_id`` stays NULL. A source without words has the target 0. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablescout.llm.apportion import apportion
from tablescout.llm.common import as_identifier, identifier, small_side, text_mark
from tablescout.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 8
SHARD = 1 << 22
SEED = "mix-1"


def seeded(*values: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *(v.cast("string") for v in values)))


def number(digest: Column) -> Column:
    """A digest's first 60 bits."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``key, source_size, target`` of ``sources(key, source, source_size)``.

    Filled from the source with the smallest ceiling for its weight: while a source's ceiling is below
    what its weight would give, it gets the ceiling and the others share the rest.
    """
    everything = Window.partitionBy()
    names = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(names) - 1, F.lit(len(weights)))
    rows = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1))
    rows = rows.withColumns({"ceiling": F.lit(most) * F.col("source_size"), "wanted": F.lit(share) * F.sum("source_size").over(everything)})
    order = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    before, from_here = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("wanted") - F.coalesce(F.sum("ceiling").over(before), F.lit(0))) / F.sum("weight").over(from_here)
    rows = rows.withColumn("level", level)
    free = F.max(F.when(F.col("ceiling") > F.col("level") * F.col("weight"), F.col("level"))).over(everything)
    full = F.col("ceiling").cast("double")
    return rows.withColumn("free", free).select("key", "source_size", F.when(
        F.col("free").isNull(), full).otherwise(F.least(full, F.col("free") * F.col("weight"))).alias("target"))


def _source_key() -> Column:
    """The source as a text that is never NULL."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def _overlap(low: Column, high: Column) -> Column:
    """Words of a document that lie between two places of its ring."""
    return F.greatest(F.lit(0), F.least(F.col("at") + F.col("size"), high) - F.greatest(F.col("at"), low))


def plan(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST,
         block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """Per row of ``documents(doc_id, text, source)``: ``key, did, mark`` (source, identifier, digest of the text),
    ``size, source_size, target, rounds`` (whole copies), ``taken`` (words in all), and the words of a
    further, partial copy: ``head`` words from the start and ``tail_from, tail`` words from a place on."""
    sized = materialize(documents.select(
        identifier().alias("did"), text_mark().alias("mark"), F.col("source").cast("string").alias("source"), _source_key().alias("key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    sources = materialize(targets(sized.groupBy("key", "source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    wide = small_side(sources.withColumn("shards", F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / shard)), F.length("key"))
    digest = seeded(F.col("did"))
    placed = sized.join(wide, "key").withColumns({"digest": digest, "shard": F.pmod(number(digest), F.col("shards"))})

    rings = placed.groupBy("key", "shard").agg(F.sum("size").alias("ring")).where("ring > 0")
    blocks = F.sum("target").over(Window.partitionBy()) / block
    by_source = apportion(sources.select("key", F.col("target").alias("votes"), F.round(blocks).cast("long").alias("total"), F.lit(1).alias("all")),
                          ["all"], ["key"]).select("key", F.col("seats").alias("total"))
    by_shard = apportion(rings.withColumn("votes", F.col("ring")).join(by_source, "key"), ["key"], ["key", "shard"])
    rings = rings.join(by_shard, ["key", "shard"], "left").withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("ring") / block).cast("long")))
    rings = rings.withColumn("seats", F.least(F.coalesce("seats", F.lit(0)), most * F.col("blocks")))
    start = F.pmod(number(seeded(F.col("key"), F.col("shard"))), F.col("blocks"))
    rings = materialize(rings.select(
        "key", "shard", "ring", F.floor(F.col("seats") / F.col("blocks")).alias("rounds"),
        F.floor(F.pmod("seats", "blocks") * F.col("ring") / F.col("blocks")).alias("run"),
        F.floor(start * F.col("ring") / F.col("blocks")).alias("start")), "rings")

    order = Window.partitionBy("key", "shard").orderBy("digest", "did", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("at", F.coalesce(F.sum("size").over(order), F.lit(0))).join(
        small_side(rings, F.length("key") + 48), ["key", "shard"], "left")
    end = F.col("start") + F.col("run")
    head = F.coalesce(_overlap(F.lit(0), end - F.col("ring")), F.lit(0))  # the run's part behind the ring's end
    tail = F.coalesce(_overlap(F.col("start"), F.least(end, F.col("ring"))), F.lit(0))
    laid = laid.withColumns({"rounds": F.coalesce("rounds", F.lit(0)), "head": head, "tail": tail,
                             "tail_from": F.greatest(F.lit(0), F.coalesce("start", F.lit(0)) - F.col("at"))})
    return laid.select("key", "did", "mark", "size", "source_size", "target", "rounds", "head", "tail_from", "tail",
                       (F.col("rounds") * F.col("size") + F.col("head") + F.col("tail")).alias("taken"))


def digest(planned: DataFrame) -> DataFrame:
    return planned.select(as_identifier("did").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed(documents: DataFrame, **settings) -> DataFrame:
    """The mix itself, with the columns of ``documents``: a row per whole copy and per part taken.

    Parts hold their words and the blanks before them; ``n_chars`` follows if there is one. A document is
    its source, ``doc_id`` and text: rows that differ in one of them each give what is planned for them,
    also where ids are NULL or repeated. Of rows equal in all three, which may differ in other columns, the
    smallest one by its columns (maps aside) stands for all.
    """
    own = ["key", "did", "mark"]
    none = F.struct(F.lit(-1).cast("long").alias("low"), F.lit(0).cast("long").alias("n"))
    whole = F.when(F.col("rounds") > 0, F.array_repeat(none, F.col("rounds").cast("int"))).otherwise(F.array().cast("array<struct<low:bigint,n:bigint>>"))
    cuts = F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("head").alias("n")),
                   F.struct(F.col("tail_from").alias("low"), F.col("tail").alias("n")))
    parts = plan(documents, **settings).select(*own, "size", F.explode(F.concat(whole, F.filter(cuts, lambda c: c["n"] > 0))).alias("part"))
    every = [F.col(f"`{c}`") for c in documents.columns]
    order = [F.col(f"`{f.name}`") for f in documents.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = documents.select(F.struct(*every).alias("row"), F.struct(*order).alias("order"), _source_key().alias("key"),
                            identifier().alias("did"), text_mark().alias("mark"))
    rows = parts.join(rows.groupBy(*own).agg(F.min_by("row", "order").alias("row")), own)
    pieces = F.regexp_extract_all(F.col("row")["text"], F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    low, n = F.col("part")["low"], F.col("part")["n"]
    is_whole = (low < 0) | (n >= F.col("size"))
    text = F.when(is_whole, F.col("row")["text"]).otherwise(F.array_join(F.slice(pieces, low.cast("int") + 1, n.cast("int")), ""))
    changed = {"text": text}
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        changed["n_chars"] = F.when(is_whole, F.col("row")["n_chars"]).otherwise(F.length(text).cast(kind))
    return rows.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in documents.columns))
