"""Secret scans with an incremental ledger of content addresses.

A version of a text is named by the SHA-256 of its UTF-8 bytes. The ledger holds, for each blob and
rule version that was ever scanned, the spans found (also when there are none). A run scans a blob
only for the rule versions it has no entry for, once for all rows that hold it, and joins the
findings back to every row. With the ledger of an earlier run only new texts and new or changed
rules cost a scan. ``extend`` returns the ledger of all runs so far, so that every version a document
ever had stays addressed.

Spans are code points, end exclusive. Rules of one kind match leftmost and without overlap; a match
whose value is too short is dropped, but what it covered stays covered.

Defined results: NULL counts as the empty text. Rows that repeat a text share its blob, whatever
their ids; every row gets a result, a NULL ``doc_id`` included. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tablescout.llm.common import as_identifier, identifier, small_side, unpacked
from tablescout.llm.words import buffers
from tablescout.session import materialize

LEDGER = "blob binary, rule string, version int, spans array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``group`` of a match must have ``least`` characters or more; a text that
    contains none of ``needs`` (lower case) has no match."""

    name: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0
    needs: tuple[str, ...] = ()


BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, least=6, needs=("password", "passwd", "secret", "token", "api_key", "apikey")),
    # Whole runs, so the least length can stand in the pattern.
    Rule("access", r"AKIA[A-Z0-9]{16,}", needs=("akia",)),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", needs=("private key-----",)),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}", needs=("gho_", "ghp_", "ghr_", "ghs_", "ghu_")),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", needs=("xox",)),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", needs=("eyj",)),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/@]{1,64}@", needs=("://",)),
)


def find(rule: Rule, text: str, lowered: str) -> list[tuple[int, int]]:
    if rule.needs and not any(n in lowered for n in rule.needs):
        return []
    return [m.span() for m in re.finditer(rule.pattern, text, re.ASCII) if len(m[rule.group]) >= rule.least]


def _scanned(rules: tuple[Rule, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows: list[tuple] = []
            for blob, data, wanted in zip(batch["blob"].to_pylist(), unpacked(batch["packed"]), batch["rules"].to_pylist()):
                text = data.decode()
                lowered = text.lower()
                for rule in rules:
                    if f"{rule.name}:{rule.version}" in wanted:
                        spans = [{"start": a, "end": b} for a, b in find(rule, text, lowered)]
                        rows.append((blob, rule.name, rule.version, spans))
            kinds = (pa.binary(), pa.string(), pa.int32(), spans_type)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * 4, kinds)],
                                             names=["blob", "rule", "version", "spans"])

    return run


def _blob():
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def _addressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        offsets, data = buffers(batch["text"])
        texts = [memoryview(data)[offsets[i] : offsets[i + 1]] for i in range(len(offsets) - 1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([coder.compress(t) for t in texts], pa.binary())],
            names=["blob", "packed"])


def scan(documents: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger entries: for every blob of ``documents`` what ``ledger`` lacks.

    Texts travel compressed, one copy of a blob from each task; the copies meet before the scan.
    """
    blobs = documents.select("text").mapInArrow(_addressed, "blob binary, packed binary").groupBy("blob").agg(F.first("packed").alias("packed"))
    every = F.array(*(F.concat_ws(":", F.lit(r.name), F.lit(r.version)) for r in rules))
    if ledger is None:
        todo = blobs.withColumn("rules", every)
    else:
        pair = F.concat_ws(":", "rule", "version")
        held = ledger.where(F.array_contains(every, pair)).groupBy("blob").agg(F.collect_set(pair).alias("held"))
        todo = blobs.join(held, "blob", "left").select("blob", "packed", F.array_except(
            every, F.coalesce("held", F.array().cast("array<string>"))).alias("rules")).where(F.size("rules") > 0)
    return materialize(todo.mapInArrow(_scanned(rules), LEDGER), "ledger")


def extend(documents: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``ledger`` and the entries that ``documents`` add to it; what it held is not written again."""
    fresh = scan(documents, ledger, rules)
    return fresh if ledger is None else ledger.unionByName(fresh)


def spans_by_blob(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, spans`` (start, rank, end, kind; by start, then kind as listed) of the blobs with a finding."""
    ranks = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))))
    current = F.create_map(*(x for r in rules for x in (F.lit(r.name), F.lit(r.version))))
    live = ledger.where((F.size("spans") > 0) & (F.col("version") == F.element_at(current, F.col("rule"))))
    live = live.dropDuplicates(["blob", "rule", "version"])  # a ledger that was appended to twice
    each = F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), F.element_at(ranks, F.col("rule")).alias("rank"), s["end"].alias("end"), F.col("rule").alias("kind")))
    return live.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(each))).alias("spans"))


def find_secrets(documents: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, blob, spans`` per row of ``documents(doc_id, text)``; ``ledger`` holds earlier runs' entries.

    The findings are written before the join, so that a blob of very many rows (the empty text, a copied
    page) can be split among tasks.
    """
    findings = materialize(spans_by_blob(extend(documents, ledger, rules), rules), "findings")
    found = documents.select(identifier().alias("did"), _blob().alias("blob")).join(findings, "blob", "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return found.select(as_identifier("did").alias("doc_id"), "blob", F.coalesce("spans", none).alias("spans"))


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a checksum of their spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *(_count(k).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _masked(text, spans, mask: str):
    """The text with its spans (by start) replaced; spans that overlap become one."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(s, span):
        before = F.concat(s["done"], F.substring(text, s["at"] + 1, span["start"] - s["at"]), F.lit(mask))
        return F.when(span["end"] > s["at"], F.struct(
            F.when(span["start"] >= s["at"], before).otherwise(s["done"]).alias("done"), span["end"].alias("at"))).otherwise(s)

    return F.aggregate(spans, start, step, lambda s: F.concat(s["done"], F.substring(text, s["at"] + 1, F.length(text))))


def redact(documents: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """``documents`` with every finding replaced by ``mask``; ``n_chars`` follows if there is one.

    Texts without findings are untouched; a NULL text stays NULL. Other columns are carried along.
    """
    found = materialize(spans_by_blob(extend(documents, ledger, rules), rules), "findings")
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), _blob().alias("blob")).join(
        small_side(found, F.size("spans") * 32 + 32), "blob", "left")
    rows = rows.withColumn("clean", F.when(F.col("spans").isNotNull(), _masked(F.col("row")["text"], F.col("spans"), mask)).otherwise(F.col("row")["text"]))
    changed = {"text": F.col("clean")}
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("spans").isNull(), F.col("row")["n_chars"]).otherwise(F.length("clean").cast(kind))
    return rows.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in documents.columns))
