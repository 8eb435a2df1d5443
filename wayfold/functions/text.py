"""Text, list and number functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIST_SEPARATOR = "|||"


WHITE = " \t\n\r\x0b\f"


def strip(x: Column) -> Column:
    """x without white space at its ends."""
    return F.btrim(x, F.lit(WHITE))


def minute(iso: Column) -> Column:
    """YYYY-MM-DD HH:MM of an ISO timestamp text."""
    return F.regexp_replace(F.substring(iso, 1, 16), "^([^T]*)T", "$1 ")


def preview(x: Column, n: int) -> Column:
    """The first n characters and three dots, always."""
    return F.concat(F.substring(x, 1, n), F.lit("..."))


def first_words(x: Column, n: int = 8) -> Column:
    """The first n words, parted by single spaces."""
    return F.array_join(F.slice(F.split(x, " "), 1, n), " ")


def join_list(items: Column) -> Column:
    """A list as one text with a three-pipe separator."""
    return F.array_join(items, LIST_SEPARATOR)


def split_list(x: Column) -> Column:
    """The inverse of join_list; an empty text is an empty list."""
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, r"\|\|\|"))


def note_sections(body: Column) -> Column:
    """Headings of a note's sections; General where there are none."""
    found = F.regexp_extract_all(body, F.lit(r"##\s+([^\n]+)"), F.lit(1))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("General")))


def note_description(body: Column) -> Column:
    """The text between the first top heading and the first section."""
    return strip(F.regexp_extract(body, r"(?ms)^#\s+[^\n]+\n(.*?)(?=^##\s|\z)", 1))


def markdown_links(x: Column) -> Column:
    """[{title, url}] of the inline links."""
    pattern = F.lit(r"\[([^\]]+)\]\(([^)]+)\)")
    return F.arrays_zip(
        F.regexp_extract_all(x, pattern, F.lit(1)).alias("title"), F.regexp_extract_all(x, pattern, F.lit(2)).alias("url")
    )


def bare_urls(x: Column) -> Column:
    """All http(s) URLs of a text."""
    return F.regexp_extract_all(x, F.lit(r"https?://[^\s)\]]+"), F.lit(0))


def embedding_text(*columns: Column) -> Column:
    """What a row is embedded as: its texts joined by spaces, at most 1000 characters."""
    return F.substring(F.concat_ws(" ", *columns), 1, 1000)


def clamp(x: Column) -> Column:
    """x held to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def recency_score(distance: Column, age_days: Column) -> Column:
    """0.7 / (1 + distance) plus 0.3 fading to nothing over 30 days."""
    return 0.7 / (1 + distance) + 0.3 * F.greatest(F.lit(0.0), 1 - age_days / 30)


def percent(part: Column, total: Column) -> Column:
    """Percent with one decimal; 0 of nothing."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round(100.0 * part / total, 1))


def hashed_embedding(x: Column, width: int = 64) -> Column:
    """A deterministic offline embedding: counts of word hashes by cell, scaled to length 1."""
    cells = F.transform(F.filter(F.split(F.lower(x), r"\W+"), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(width)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter(cells, lambda c: c == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c))
    return F.transform(counts, lambda c: F.when(norm > 0, c / norm).otherwise(F.lit(0.0)))


def navigation(message: Column) -> Column:
    """Struct of what a log line tells of a navigation; null if it tells of none or names no url."""
    says = lambda *words: F.greatest(*[F.contains(message, F.lit(w)) for w in words], F.lit(False))
    named = lambda what: F.nullif(F.regexp_extract(message, rf"(?i){what}[:\s]+([^\s,]+)", 1), F.lit(""))
    kind = F.when(says("back", "forward"), "back_forward").when(says("reload"), "reload").otherwise("navigate")
    return F.when(
        says("navigation", "visit", "page_load") & named("url").isNotNull(),
        F.struct(
            named("url").alias("url"), named("referrer").alias("referrer"), kind.alias("navigation_type"),
            says("pushState", "replaceState", "spa").alias("is_spa"), says("new_tab", 'target="_blank"').alias("is_new_tab"),
        ),
    )
