"""Rendered texts: place documents, query texts, template justifications, prompt lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tablescout import fixed_values as V

# Character classes of the two blank tests. The catalog and requests
# follow the JVM's notion of white space, the raw export the wider Unicode one.
_JVM_SPACE = r"\s\x1c-\x1f\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{2028}\x{2029}\x{205f}\x{3000}"
_UNICODE_SPACE = _JVM_SPACE + r"\x85\xa0\x{2007}\x{202f}"


def not_blank(text: Column) -> Column:
    """True/false, never NULL."""
    return F.coalesce(text.rlike(f"[^{_JVM_SPACE}]"), F.lit(False))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{_UNICODE_SPACE}]+|[{_UNICODE_SPACE}]+$", "")


def null_safe_array(items: Column) -> Column:
    """NULL becomes an empty array, NULL elements are dropped."""
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isNotNull())


def _listed(prefix: str, items: Column, suffix: str = "") -> Column:
    return F.when(
        F.size(items) > 0, F.concat(F.lit(prefix), F.array_join(items, ", "), F.lit(suffix))
    ).otherwise(F.lit(""))


def place_document() -> Column:
    """Text that stands for a place: ``name - cuisines in city, state. Features: f. description``."""
    state = F.when(F.col("state").isNotNull(), F.concat(F.lit(", "), "state")).otherwise("")
    area = F.when(F.col("city").isNotNull(), F.concat(F.lit(" in "), "city", state)).otherwise("")
    description = F.when(not_blank(F.col("description")), F.concat(F.lit(" "), "description")).otherwise("")
    return F.concat(
        "name", _listed(" - ", F.col("cuisines")), area, F.lit("."),
        _listed(" Features: ", F.col("features"), "."), description,
    )


def query_text() -> Column:
    taste = F.when(not_blank(F.col("preferred_cuisine")), F.col("preferred_cuisine")).otherwise("great")
    price = F.when(
        F.col("preferred_price_range") > 0,
        F.concat(F.lit(" around price level "), F.col("preferred_price_range").cast("string")),
    ).otherwise("")
    rating = F.when(
        F.col("minimum_rating") > 0,
        F.concat(F.lit(" with a rating of at least "), F.col("minimum_rating").cast("string")),
    ).otherwise("")
    return F.concat(F.lit("Looking for a "), taste, F.lit(" restaurant"), price, rating, F.lit("."))


def template_text(dist_km: Column) -> Column:
    """Justification used when nothing was generated."""
    rating = F.when(
        F.col("overall_rating") > 0,
        F.concat(F.lit(", rated "), F.format_string("%.1f", F.col("overall_rating")), F.lit("/5")),
    ).otherwise("")
    distance = F.when(
        dist_km.isNotNull(),
        F.concat(F.lit(", about "), F.format_string("%.1f", dist_km), F.lit(" km away")),
    ).otherwise("")
    return F.concat("name", _listed(" serves ", F.col("cuisines")), rating, distance, F.lit("."))


def short_description(text: Column) -> Column:
    """White space collapsed, cut after 240 UTF-16 units with an ellipsis.

    A pad character in front of every supplementary code point makes the code-point
    count equal the UTF-16 count; a pair split by the cut is dropped.
    """
    pad = "￿"
    flat = F.regexp_replace(text, r"\s+", " ")
    flat = F.regexp_replace(flat, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    units = F.regexp_replace(flat, r"([\x{10000}-\x{10FFFF}])", pad + "$1")
    cut = F.concat(F.replace(F.left(units, F.lit(V.PROMPT_DESCRIPTION_CHARS)), F.lit(pad), F.lit("")), F.lit("…"))
    return F.coalesce(F.when(F.length(units) <= V.PROMPT_DESCRIPTION_CHARS, flat).otherwise(cut), F.lit(""))


def candidate_line(dist_km: Column, cut: bool = True) -> Column:
    """One candidate in the prompt; without ``cut`` its description is at prompt size already."""
    return F.concat(
        F.lit("- "), "name",
        F.lit(" | cuisines: ["), F.array_join("cuisines", ", "), F.lit("]"),
        F.lit(" | rating: "), F.format_string("%.1f", F.coalesce("overall_rating", F.lit(0.0))),
        F.lit(" | price: "), F.coalesce("price_range", F.lit(0)).cast("string"),
        F.lit(" | "), F.format_string("%.2f", F.coalesce(dist_km, F.lit(0.0))), F.lit(" km\n  "),
        short_description(F.col("description")) if cut else F.col("description"),
    )


def fill_prompt(max_results: Column, candidates: Column) -> Column:
    """Literal replacements one after the other, so a placeholder typed by the diner is
    expanded by the steps that follow it."""
    taste = F.when(not_blank(F.col("preferred_cuisine")), F.col("preferred_cuisine")).otherwise("any")
    steps = (
        ("{{maxResults}}", max_results.cast("string")),
        ("{{preferredCuisine}}", taste),
        ("{{minimumRating}}", F.col("minimum_rating").cast("string")),
        ("{{preferredPriceRange}}", F.col("preferred_price_range").cast("string")),
        ("{{candidates}}", candidates),
    )
    text = F.lit(V.PROMPT_TEMPLATE)
    for placeholder, value in steps:
        text = F.replace(text, F.lit(placeholder), value)
    return text
