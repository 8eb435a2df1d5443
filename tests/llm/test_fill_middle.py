import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from wayfold.llm.fill_middle import cut_text, draws, fill_in_middle, restored

from .conftest import CLASHING

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text, seed=1, sentinels=("<P>", "<S>", "<M>")):
    """(n, form, prefix_chars, middle_chars, output) by regular expression."""
    text = text or ""
    units = TOKEN.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = sentinels
    if not text or any(x in text for x in sentinels) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


def results(df):
    return sorted(
        ((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.fim_text, r.back) for r in df.withColumn("back", restored()).collect()),
        key=repr,
    )


def expected(df, **options):
    return sorted(((r.doc_id, r.text, *brute(r.doc_id, r.text, **options), r.text or "") for r in df.collect()), key=repr)


@given(st.text(alphabet=st.sampled_from(list("abZ <>PSM\n\t09éß日😀̀\x00"))), st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)))
def test_one_text(text, doc_id):
    *rest, output = cut_text(text, draws(1, doc_id), ("<P>", "<S>", "<M>"), 10, 20)
    assert (*rest, output.decode()) == brute(doc_id, text)


def test_matches_brute_force(docs):
    assert results(fill_in_middle(docs)) == expected(docs)
    assert {r.form for r in fill_in_middle(docs).select("form").collect()} == {"plain", "psm", "spm"}


def test_other_sentinels_and_seed(docs):
    own = ("␂pre␃", "␂suf␃", "␂mid␃")
    got = fill_in_middle(docs, seed=7, sentinels=own).withColumn("back", restored(sentinels=own)).collect()
    assert all(r.back == r.text for r in got)
    assert {(r.doc_id, r.fim_text) for r in got} == {(r.doc_id, brute(r.doc_id, r.text, 7, own)[-1]) for r in docs.collect()}
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "[S]", "<M>"), ("<P<", "<S>", "<M>"), ("<P", "<PS", "<M")):
        with pytest.raises(ValueError, match="sentinel"):
            fill_in_middle(docs, sentinels=bad)


def test_texts_with_sentinels_and_half_sentinels(spark):
    texts = ["a <P> b", "x<S>", "<M>", "<<<", "<P<S<M", "<", ">P>S>M>", "ab<P", "S><M", "P><S", "😀<" * 50]
    df = spark.createDataFrame([(i, t) for i in range(60) for t in texts], "doc_id long, text string")
    assert results(fill_in_middle(df)) == expected(df)


def test_odd_rows(odd_docs, no_docs):
    df = odd_docs.withColumnsRenamed({"size": "n", "shard": "fim_text", "slot": "form"})
    got = fill_in_middle(df)
    assert got.columns == [c for c in df.columns if c not in ("n", "fim_text", "form")] + ["n", "form", "prefix_chars", "middle_chars", "fim_text"]
    assert results(got) == expected(odd_docs)
    assert set(CLASHING) - {"size", "shard", "slot"} <= set(got.columns)
    assert fill_in_middle(no_docs).count() == 0


def test_shares_of_forms(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "'one two three' AS text")
    share = {r.form: r["count"] / 20_000 for r in fill_in_middle(df).groupBy("form").count().collect()}
    assert share["plain"] == pytest.approx(0.1, abs=0.01)
    assert share["spm"] == pytest.approx(0.18, abs=0.01)
