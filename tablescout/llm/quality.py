"""Quality rules combined by weak supervision.

Each rule votes for a document (1), against it (-1) or abstains (0). Expectation-maximisation over
all documents estimates, without labels, the share of good documents and how often each rule votes
for or against good and bad ones; a document's probability of being good follows from its votes. A
rule whose votes against hit what all the others favour comes to count little, and a vote never
counts for the opposite of what it says.

Documents are summed up by their pattern of votes (a table bounded by three to the power of the
number of rules), so a round of the estimation reads a few rows, whatever the corpus.

Defined results: NULL counts as the empty text; a text without words fails the base test. Each row
is judged by itself, so repeated rows get equal results. A NULL ``doc_id`` stays NULL. Other columns
are ignored. On an empty table the estimates stay at their starting values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tablescout.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: A word of letters, with the punctuation of a sentence around it.
PLAIN = r"(?<![^\x20\x09-\x0D])[(\"'\u2018\u201C]?[\p{L}\p{M}'\u2019-]+[.,;:!?\"'\u2019\u201D)]{0,2}(?![^\x20\x09-\x0D])"
LEAST_WORDS = 50
ROUNDS = 25
#: Starting values: share of good documents, and how often a rule votes (against, in favour) of good and of bad ones.
GOOD = 0.8
VOTES = {"good": (0.02, 0.9), "bad": (0.3, 0.8)}
#: The share of good documents stays inside these bounds, and no vote weighs more than this.
GOOD_BOUNDS, MOST_WEIGHT = (0.05, 0.95), 4.0


@dataclass(frozen=True)
class Rule:
    """Conditions under which a rule votes against and for a document."""

    name: str
    against: str
    favour: str


RULES = (
    Rule("length", "n_words < 50", "n_words >= 80"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines", "20 * n_dup_lines <= n_lines"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 15 * n_words"),
    Rule("word_length", "10 * word_chars < 25 * n_words or word_chars > 12 * n_words",
         "10 * word_chars >= 30 * n_words and word_chars <= 10 * n_words"),
    Rule("capitals", "10 * n_capitals > 3 * word_chars", "10 * n_capitals <= word_chars"),
    Rule("variety", "20 * n_kinds < n_words", "10 * n_kinds >= n_words"),
    Rule("plain_words", "10 * n_plain < 7 * n_words", "10 * n_plain >= 9 * n_words"),
    Rule("sentences", "60 * n_ends < n_words", "30 * n_ends >= n_words"),
    Rule("marks", "10 * n_marks > n_words", "50 * n_marks <= n_words"),
)


def _repeat_words(hashes: Column) -> Column:
    """Words in three-word windows that occur twice or more, from the hashes of the words."""

    def of_windows(windows: Column) -> Column:
        numbered = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
            _bound(numbered, lambda s: _covered(F.array_sort(F.transform(F.filter(
                s, lambda x, i: F.coalesce(F.get(s, i - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["w"] == x["w"], F.lit(False))),
                lambda x: x["i"])))))

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))

    return _bound(hashes, lambda h: _bound(windows(h), of_windows))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda's variable is never expanded into its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(starts: Column) -> Column:
    """Words covered by windows of three at sorted places."""
    def of(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return _bound(starts, of)


def features(documents: DataFrame, carried: Column | None = None) -> DataFrame:
    """``carried`` (as ``row``; the ``doc_id`` by default) and counts over the whole text of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    carried = F.col("doc_id") if carried is None else carried
    words = documents.select(carried.alias("row"), text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    hashed = words.select(
        "row", "text", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return hashed.select(
        "row", "n_words", "word_chars",
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _bound(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("kinds"))).alias("lines"),
        _repeat_words(F.col("hashes")).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("hashes")).cast("long").alias("n_kinds"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit(r"[!?]")).cast("long").alias("n_marks"),
        F.regexp_count("text", F.lit(PLAIN)).cast("long").alias("n_plain"),
        F.regexp_count("text", F.lit(r"[.!?](?![^\x20\x09-\x0D])")).cast("long").alias("n_ends"),
    ).withColumns({"n_lines": F.col("lines.all").cast("long"), "n_dup_lines": (F.col("lines.all") - F.col("lines.kinds")).cast("long")}).drop("lines")


def votes(rules: tuple[Rule, ...]) -> dict[str, Column]:
    return {f"vote_{r.name}": F.when(F.expr(r.against), -1).when(F.expr(r.favour), 1).otherwise(0) for r in rules}


def _weights(rates: dict[str, tuple[float, float]]) -> tuple[float, float]:
    """Log-odds that a vote against (never above 0) and in favour (never below 0) add."""
    against, favour = (math.log(g / b) for g, b in zip(rates["good"], rates["bad"]))
    return max(-MOST_WEIGHT, min(0.0, against)), min(MOST_WEIGHT, max(0.0, favour))


def posterior(rates: dict[str, dict[str, tuple[float, float]]], good: float) -> Column:
    """Probability of a good document, given its votes and the estimates."""
    odds = F.lit(math.log(good / (1 - good)))
    for name, own in rates.items():
        against, favour = _weights(own)
        odds = odds + F.when(F.col(name) == -1, against).when(F.col(name) == 1, favour).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def estimate(voted: DataFrame, names: list[str], rounds: int = ROUNDS) -> tuple[dict[str, dict[str, tuple[float, float]]], float]:
    """How often each rule votes (against, in favour) of good and bad documents, and the share of good ones."""
    patterns = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    patterns = materialize(patterns.orderBy(*names).coalesce(1), "patterns")
    rates, good = {v: dict(VOTES) for v in names}, GOOD
    for _ in range(rounds):
        scored = patterns.withColumn("p_good", posterior(rates, good)).withColumn("p_bad", 1 - F.col("p_good"))
        sums = {("all", c): F.sum(F.col("n") * F.col(f"p_{c}")) for c in VOTES}
        sums |= {(v, c, x): F.sum(F.col("n") * F.col(f"p_{c}") * (F.col(v) == x).cast("int")) for v in names for c in VOTES for x in (-1, 1)}
        row = dict(zip(sums, scored.agg(*sums.values()).first()))
        if row["all", "good"] is None:
            break
        # One document of the starting values keeps every rate above 0.
        new = {v: {c: tuple((row[v, c, x] + start) / (row["all", c] + 1) for x, start in zip((-1, 1), VOTES[c])) for c in VOTES} for v in names}
        share = row["all", "good"] / (row["all", "good"] + row["all", "bad"])
        share = min(max(share, GOOD_BOUNDS[0]), GOOD_BOUNDS[1])
        moved = max(abs(share - good), *(abs(x - y) for v in names for c in VOTES for x, y in zip(new[v][c], rates[v][c])))
        rates, good = new, share
        if moved < 1e-6:
            break
    return rates, good


def judge(documents: DataFrame, rules: tuple[Rule, ...] = RULES, least_words: int = LEAST_WORDS,
          carried: Column | None = None) -> DataFrame:
    """``row``, features, votes, ``base_failed``, ``probability`` and ``kept`` per row of ``documents(doc_id, text)``."""
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    voted = materialize(features(documents, carried).withColumn("base_failed", failed).withColumns(votes(rules)), "votes")
    names = [f"vote_{r.name}" for r in rules]
    judged = voted.withColumn("probability", posterior(*estimate(voted, names)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= 0.5))


def keep_good(documents: DataFrame, **settings) -> DataFrame:
    """The rows of ``documents`` that are kept, with all their columns."""
    judged = judge(documents, carried=F.struct(*(F.col(f"`{c}`") for c in documents.columns)), **settings)
    return judged.where("kept").select(*(F.col("row")[c].alias(c) for c in documents.columns))


def digest(judged: DataFrame) -> DataFrame:
    return judged.select(F.col("row").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")
