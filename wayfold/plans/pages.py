"""Scalar features of pages, notes and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html, jsonx, text, url
from ..sources.tables import page_features, table
from .registry import query

HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1))"
TITLE = r"trim(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1))"
TEXT = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), "
    r"'(?is)<style\b.*?</style>', '', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
)
WORDS = f"len(list_filter(string_split_regex({TEXT}, '\\s+'), lambda w: w <> ''))"
TRACKERS = ", ".join(f"'{p}'" for p in url.TRACKING_PARAMETERS)
SAMPLE_META = """concat('<html><head><META charset="x"><meta name="Description" content="About page ', page_id, '"></head>', html)"""
SAMPLE_CODE = """CASE page_id % 5 WHEN 0 THEN '<pre>x</pre>' WHEN 1 THEN 'a ``` b' WHEN 2 THEN '<div class="my-code">' WHEN 3 THEN '<CODE>' ELSE '<coder>' END"""


@query(f"SELECT page_id, CASE WHEN {TITLE} <> '' THEN {TITLE} ELSE {HOST} END AS title FROM pages")
def title_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html"), F.col("url")).alias("title"))


@query(f"""
    SELECT page_id, nullif(regexp_extract(html, '(?i)<meta[^>]*name=["'']description["''][^>]*content=["'']([^"'']+)["'']', 1), '') AS plain,
           nullif(regexp_extract({SAMPLE_META}, '(?i)<meta[^>]*name=["'']description["''][^>]*content=["'']([^"'']+)["'']', 1), '') AS planted
    FROM pages
""")
def meta_description(spark, sf_dir):
    planted = F.concat(F.lit('<html><head><META charset="x"><meta name="Description" content="About page '), F.col("page_id").cast("string"), F.lit('"></head>'), "html")
    return table(spark, sf_dir, "pages").select("page_id", html.meta_description(F.col("html")).alias("plain"), html.meta_description(planted).alias("planted"))


@query(f"SELECT page_id, CAST({WORDS} AS INTEGER) AS word_count, CAST(length({TEXT}) AS INTEGER) AS chars, substr({TEXT}, 1, 500) AS content_sample FROM pages")
def html_to_text_stats(spark, sf_dir):
    plain = html.text(F.col("html"))
    return table(spark, sf_dir, "pages").select(
        "page_id", html.word_count(plain).alias("word_count"), F.length(plain).alias("chars"), F.substring(plain, 1, 500).alias("content_sample")
    )


@query(f"""
    SELECT page_id, regexp_matches(html, '<code\\b|<pre\\b|```|class="[^"]*code[^"]*"') AS has_code,
           regexp_matches({SAMPLE_CODE}, '<code\\b|<pre\\b|```|class="[^"]*code[^"]*"') AS planted FROM pages
""")
def code_block_flag(spark, sf_dir):
    k = F.col("page_id") % 5
    planted = F.when(k == 0, "<pre>x</pre>").when(k == 1, "a ``` b").when(k == 2, '<div class="my-code">').when(k == 3, "<CODE>").otherwise("<coder>")
    return table(spark, sf_dir, "pages").select("page_id", html.has_code(F.col("html")).alias("has_code"), html.has_code(planted).alias("planted"))


@query(f"""
    SELECT page_id, round(CASE WHEN {WORDS} > 0 THEN len(regexp_extract_all(html, '(?i)<a\\b[^>]*>')) / CAST({WORDS} AS DOUBLE) ELSE 0 END, 9) AS link_density
    FROM pages
""")
def link_density(spark, sf_dir):
    return page_features(spark, sf_dir).select("page_id", F.round("link_density", 9).alias("link_density"))


@query(f"SELECT page_id, {HOST} AS host FROM pages")
def url_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", url.host(F.col("url")).alias("host"))


def _clean(query_text: str) -> str:
    kept = f"list_filter(string_split({query_text}, '&'), lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ({TRACKERS}))"
    joined = f"replace(array_to_string(list_transform({kept}, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&'), '%20', '+')"
    return f"CASE WHEN coalesce({joined}, '') = '' THEN '' ELSE '?' || {joined} END"


_MORE = "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || '?utm_source=feed&q=a%20b&flag' WHEN 2 THEN 'HTTPS://User@Host.Example:443?fbclid=1#frag' ELSE 'not-a-url?gclid=1&z=2' END"
_PART = r"regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', {})"


@query(f"""
    WITH t AS (SELECT page_id, {_MORE} AS u FROM pages), p AS (
        SELECT page_id, u, lower({_PART.format(1)}) AS scheme, lower(regexp_replace({_PART.format(2)}, '^.*@', '')) AS authority,
               {_PART.format(3)} AS path, substr({_PART.format(4)}, 2) AS q, {_PART.format(5)} AS frag,
               regexp_extract(u, '^([^?#]*)', 1) AS base, regexp_extract(u, '\\?([^#]*)', 1) AS q2
        FROM t
    )
    SELECT page_id, CASE WHEN scheme IN ('http', 'https') AND authority <> '' THEN
               scheme || '://' || regexp_replace(authority, CASE scheme WHEN 'https' THEN ':443$' ELSE ':80$' END, '')
               || CASE path WHEN '' THEN '/' ELSE path END || {_clean('q')} || CASE frag WHEN '#' THEN '' ELSE frag END
           ELSE base || {_clean('q2')} END AS url
    FROM p
""")
def url_normalize(spark, sf_dir):
    k = F.col("page_id") % 4
    u = (
        F.when(k == 0, F.col("url")).when(k == 1, F.concat("url", F.lit("?utm_source=feed&q=a%20b&flag")))
        .when(k == 2, "HTTPS://User@Host.Example:443?fbclid=1#frag").otherwise("not-a-url?gclid=1&z=2")
    )
    return table(spark, sf_dir, "pages").select("page_id", url.normalize(u).alias("url"))


@query(f"""
    WITH p AS (SELECT page_id, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) AS kv FROM pages)
    SELECT page_id, split_part(kv, '=', 1) AS parameter FROM p WHERE split_part(kv, '=', 1) IN ({TRACKERS})
""")
def url_tracking_params(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(url.tracking_parameters(F.col("url"))).alias("parameter"))


NOTE = "CASE doc_id % 3 WHEN 0 THEN text ELSE '# ' || source || chr(10) || 'About ' || lang || chr(10) || '## First ' || doc_id || chr(10) || substr(text, 1, 50) || chr(10) || '## Second' || chr(10) END"


@query(f"""
    WITH n AS (SELECT doc_id, {NOTE} AS body FROM documents)
    SELECT doc_id, coalesce(nullif(array_to_string(regexp_extract_all(body, '##\\s+([^\\n]+)', 1), '|||'), ''), 'General') AS sections,
           trim(CASE doc_id % 3 WHEN 0 THEN '' ELSE regexp_extract(body, '^#\\s+[^\\n]+\\n([^\\n]*)', 1) END) AS description
    FROM n
""")
def note_sections(spark, sf_dir):
    nl, tail = F.lit("\n"), F.lit("\n## Second\n")
    note = F.concat(F.lit("# "), "source", nl, F.lit("About "), "lang", F.lit("\n## First "), F.col("doc_id").cast("string"), nl, F.substring("text", 1, 50), tail)
    n = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(note).alias("body"))
    return n.select(
        "doc_id", text.join_list(text.note_sections(F.col("body"))).alias("sections"), text.note_description(F.col("body")).alias("description")
    )


@query("SELECT doc_id, substr(text, 1, 150) || '...' AS preview FROM documents")
def preview_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text"), 150).alias("preview"))


LINKS = "'See [page ' || page_id || '](' || url || ') and [x](y) or ' || url || ' end'"


@query(f"""
    SELECT page_id, array_to_string(regexp_extract_all({LINKS}, '\\[([^\\]]+)\\]\\(([^)]+)\\)', 1), '|') AS titles,
           array_to_string(regexp_extract_all({LINKS}, '\\[([^\\]]+)\\]\\(([^)]+)\\)', 2), '|') AS urls,
           array_to_string(regexp_extract_all({LINKS}, 'https?://[^\\s)\\]]+'), '|') AS bare
    FROM pages
""")
def markdown_links(spark, sf_dir):
    x = F.concat(F.lit("See [page "), F.col("page_id").cast("string"), F.lit("]("), "url", F.lit(") and [x](y) or "), "url", F.lit(" end"))
    links = table(spark, sf_dir, "pages").select("page_id", text.markdown_links(x).alias("l"), text.bare_urls(x).alias("b"))
    return links.select(
        "page_id", F.array_join("l.title", "|").alias("titles"), F.array_join("l.url", "|").alias("urls"), F.array_join("b", "|").alias("bare")
    )


@query("""
    SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE array_to_string(string_split(lang || ' ' || source, ' '), '; ') END AS intentions,
           CAST(CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 2 END AS INTEGER) AS n FROM documents
""")
def json_intentions_roundtrip(spark, sf_dir):
    items = F.when(F.col("doc_id") % 4 != 0, F.array("lang", "source"))
    stored = table(spark, sf_dir, "documents").select("doc_id", jsonx.encode_list(items).alias("j"))
    back = jsonx.decode_list(F.col("j"))
    return stored.select("doc_id", F.array_join(back, "; ").alias("intentions"), F.size(back).alias("n"))


@query("""
    SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE role END AS title, CASE WHEN turn % 4 = 3 THEN NULL ELSE turn END AS n FROM conversations
""")
def lenient_json(spark, sf_dir):
    whole = F.to_json(F.struct(F.col("role").alias("title"), F.col("turn").alias("n")))
    k = F.col("turn") % 4
    said = (
        F.when(k == 0, whole).when(k == 1, F.concat(F.lit("Sure:\n```json\n"), whole, F.lit("\n```\nDone.")))
        .when(k == 2, F.concat(F.lit("The answer is "), whole, F.lit(" I think."))).otherwise("no object {here")
    )
    v = jsonx.lenient(said)
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.try_variant_get(v, "$.title", "string").alias("title"), F.try_variant_get(v, "$.n", "bigint").alias("n")
    )


@query("""
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN lang ELSE lang || '|||' || source END AS joined,
           CAST(doc_id % 3 AS INTEGER) AS n FROM documents
""")
def pipe_list(spark, sf_dir):
    k = F.col("doc_id") % 3
    items = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array("lang")).otherwise(F.array("lang", "source"))
    joined = text.join_list(items)
    return table(spark, sf_dir, "documents").select("doc_id", joined.alias("joined"), F.size(text.split_list(joined)).alias("n"))


@query("SELECT doc_id, md5(substr(concat_ws(' ', source, lang, text), 1, 1000)) AS embedded FROM documents")
def embed_text_concat(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.embedding_text(F.col("source"), F.col("lang"), F.col("text"))).alias("embedded"))


@query("""
    SELECT conv_id, string_agg(role || ': ' || text, '; ' ORDER BY turn) AS transcript, count(*) AS turns FROM conversations GROUP BY conv_id
""")
def conversation_transcript(spark, sf_dir):
    said = F.sort_array(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("s"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(said.alias("t"), F.count("*").alias("turns")).select(
        "conv_id", F.array_join("t.s", "; ").alias("transcript"), "turns"
    )


@query(f"""
    WITH c AS (SELECT {HOST} AS host, count(*) AS n FROM pages GROUP BY 1)
    SELECT host, n, round(100.0 * n / CAST(sum(n) OVER () AS BIGINT), 1) AS percent FROM c
""")
def percent_histogram(spark, sf_dir):
    c = table(spark, sf_dir, "pages").groupBy(url.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n")).first()[0] or 0
    return c.select("host", "n", text.percent(F.col("n"), F.lit(total)).alias("percent"))
