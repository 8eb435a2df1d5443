"""Features of raw HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip
from .url import host


def title(html: Column, url: Column) -> Column:
    """Text of the first title element, trimmed; the host where there is none."""
    t = strip(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]+)</title>", 1))
    return F.when(t != "", t).otherwise(host(url))


def meta_description(html: Column) -> Column:
    """Content of the description meta element whose name comes first; null if none."""
    return F.nullif(
        F.regexp_extract(html, r"""(?i)<meta[^>]*name=["']description["'][^>]*content=["']([^"']+)["']""", 1), F.lit("")
    )


def text(html: Column) -> Column:
    """Visible text: scripts, styles and tags go, white space collapses."""
    t = F.regexp_replace(html, r"(?is)<script\b.*?</script>", "")
    t = F.regexp_replace(t, r"(?is)<style\b.*?</style>", "")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def word_count(plain: Column) -> Column:
    """Words of a text; 0 for an empty one."""
    return F.size(F.filter(F.split(plain, r"\s+"), lambda w: w != ""))


def has_code(html: Column) -> Column:
    """Whether there is a code or pre element, a fence, or a class that names code."""
    return html.rlike(r"<code\b|<pre\b|```|class=\"[^\"]*code[^\"]*\"")


def link_density(html: Column, words: Column) -> Column:
    """Links for each word; 0 without words."""
    links = F.regexp_count(html, F.lit(r"(?i)<a\b[^>]*>"))
    return F.when(words > 0, links / words).otherwise(F.lit(0.0))


def features(html: Column, url: Column) -> Column:
    """All of the above as one struct, with the first 500 characters as a sample."""
    plain = text(html)
    words = word_count(plain)
    return F.struct(
        title(html, url).alias("title"),
        meta_description(html).alias("meta_description"),
        F.substring(plain, 1, 500).alias("content_sample"),
        words.alias("word_count"),
        has_code(html).alias("has_code_blocks"),
        link_density(html, words).alias("link_density"),
    )
