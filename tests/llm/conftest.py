import pytest

CLASHING = "size shard slot same nth group_size bands key rep kept component_id mix_taken mix_size n_lines flags gone good score _u _source _id _text c0 count members".split()
LONG = "wort " * 60_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, texts and metadata; empty, blank and very long texts; repeats; clashing columns."""
    base = [
        (None, "a text without an id", "en", "s1", 20), (1, None, "en", "s1", None), (2, "", None, "s2", 0), (3, " \t\n ", "en", None, 4),
        (4, LONG, "de", "s2", len(LONG)), (5, "same words here again", "en", "s1", 21), (6, "same words here again", "en", "s1", 21),
        (6, "same words here again", "en", "s1", 21), (7, "Same Words here\tagain", "en", None, 21), (8, "ü é 日本 \x0b x", "fr", "ß", 9),
    ]
    rows = [(*r, *[i] * len(CLASHING)) for i, r in enumerate(base)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHING))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
