import base64

import pytest
import zstandard
from pyspark.sql import functions as F

from wayfold.functions import codec, html, jsonx, text, url


def one(spark, expression, *values):
    row = spark.createDataFrame([values], ", ".join(f"x{i} string" for i in range(len(values))))
    return row.select(expression(*[F.col(f"x{i}") for i in range(len(values))])).first()[0]


@pytest.mark.parametrize(("raw", "clean"), [
    ("https://example.com?utm_source=test&fbclid=123&page=1", "https://example.com/?page=1"),
    ("https://example.com/page?utm_source=test#section", "https://example.com/page#section"),
    ("not-a-url", "not-a-url"),
    ("HTTP://Example.COM:80/A?b=1&b=2&REF=x", "http://example.com/A?b=1&b=2&REF=x"),
    ("https://e.com:8443/?q=a%20b&flag&&gclid=1", "https://e.com:8443/?q=a+b&flag="),
    ("/rel?utm_medium=a&k=v#h", "/rel?k=v"),
    ("https://e.com/#", "https://e.com/"),
])
def test_normalize(spark, raw, clean):
    assert one(spark, url.normalize, raw) == clean


def test_tracking_list():
    assert len(url.TRACKING_PARAMETERS) == len(set(url.TRACKING_PARAMETERS)) == 134


def test_host(spark):
    assert one(spark, url.host, "https://User:pw@Sub.Example.com:8080/x") == "sub.example.com"
    assert one(spark, url.host, "no url at all") is None


def test_html(spark):
    page = '<html><TITLE lang="x">\n A &amp; B </TITLE><meta name="description" content="It is"><script>var a="<p>";</script><style>p{}</style><p>One  two</p><a href=x>l</a><abbr>q</abbr>'
    f = one(spark, lambda h, u: html.features(h, u), page, "https://e.com/")
    assert (f.title, f.meta_description, f.word_count, f.has_code_blocks) == ("A &amp; B", "It is", 7, False)
    assert f.link_density == pytest.approx(1 / 7)
    assert one(spark, html.title, "<p>", "https://E.com/x") == "e.com"
    assert one(spark, html.meta_description, "<meta content='x' name='description'>") is None
    assert one(spark, lambda h: html.word_count(html.text(h)), "") == 0
    for s, flag in (("<code>", True), ("<CODE>", False), ("<coder>", False), ("```", True), ('<a class="x code-y">', True)):
        assert one(spark, html.has_code, s) is flag


def test_notes(spark):
    body = "# Title\nAbout it\nmore\n## One\nx\n### Two\n"
    assert one(spark, text.note_sections, body) == ["One", "Two"]
    assert one(spark, text.note_description, body) == "About it\nmore"
    assert one(spark, text.note_sections, "plain") == ["General"] and one(spark, text.note_description, "# A\nall the rest") == "all the rest"


def test_lists_and_text(spark):
    assert one(spark, lambda x: text.split_list(x), "") == []
    assert one(spark, lambda x: text.split_list(text.join_list(F.split(x, ","))), "a,b") == ["a", "b"]
    assert one(spark, text.minute, "2024-01-02T03:04:05Z") == "2024-01-02 03:04"
    assert one(spark, lambda x: text.preview(x, 3), "ab") == "ab..."
    assert one(spark, lambda x: text.first_words(x, 2), "a b c") == "a b"
    assert [tuple(x) for x in one(spark, text.markdown_links, "[a](b) x [c d](http://e)")] == [("a", "b"), ("c d", "http://e")]
    assert one(spark, lambda x: text.percent(F.lit(1), x.cast("int")), "0") == 0.0
    assert one(spark, lambda x: text.recency_score(x.cast("double"), F.lit(1.0)), "0.8") == pytest.approx(0.7 / 1.8 + 0.3 * 29 / 30)
    e = one(spark, lambda x: text.hashed_embedding(x, 8), "some words some")
    assert sum(v * v for v in e) == pytest.approx(1.0) and one(spark, lambda x: text.hashed_embedding(x, 4), "") == [0.0] * 4


@pytest.mark.parametrize(("said", "n"), [
    ('{"n": 1}', 1), ('x ```json\n{"n": {"m": 2}, "k": 1}\n``` y', None), ('so {"n": 3} it is', 3), ("nothing {here", None), ("```\n{\"n\": 4}\n```", 4),
])
def test_lenient_json(spark, said, n):
    assert one(spark, lambda x: F.try_variant_get(jsonx.lenient(x), "$.n", "int"), said) == n


def test_json_lists(spark):
    assert one(spark, jsonx.decode_list, None) == [] and one(spark, jsonx.decode_list, '["a","b"]') == ["a", "b"]


def test_payload(spark):
    packed = base64.b64encode(zstandard.compress("é <p>".encode())).decode()
    assert one(spark, codec.decode_payload, packed) == "é <p>"
    assert one(spark, codec.decode_payload, "plain <html>") == "plain <html>" and one(spark, codec.decode_payload, None) is None
