"""Line deduplication by winnowing over line hashes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, neutral, release, word_count

#: Least words of a repeated run that is deleted; the weight of a winnowing window.
RUN_WORDS = 50
#: A word and the white space before it.
SPACED_WORD = r"[\x20\x09-\x0D]*" + WORD


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """With a document's key: _id, null first, and _text, the text's hash."""
    return docs.withColumns({
        "_id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long")),
        "_text": F.xxhash64(text_col),
    })


def _agree(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    at = F.array_position(same, False)
    return F.when(at == 0, n.cast("long")).otherwise(at - 1).cast("int")


def _windows(lines: DataFrame, least: int) -> DataFrame:
    """The windows: from each line on, the fewest lines that hold `least` words.

    A line weighs its words, one at least, so a window and its two contexts hold
    `least` lines at most. `before` and `after` are the hashes of the lines next to the
    window, nearest first, as far as they hold fewer than `least` words. `at` is the line that
    the window selects: the one of least hash, the last of equal ones.
    """
    last = F.size("run") - F.array_position(F.reverse("run"), F.array_min("run")).cast("int")
    doc = Window.partitionBy("_id", "_text")
    to_here = doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    held = doc.orderBy("from").rangeBetween(0, least - 1)
    return (
        lines.withColumn("to", F.sum("weight").over(to_here))
        .withColumn("from", F.col("to") - F.col("weight"))
        .withColumn("next", F.collect_list("h").over(doc.orderBy("to").rangeBetween(1, least - 1)))
        .withColumns({
            "run": F.collect_list("h").over(held),
            "words": F.sum("weight").over(held),
            "after": F.last("next").over(held),
            "before": F.reverse(F.collect_list("h").over(doc.orderBy("from").rangeBetween(1 - least, -1))),
        })
        .where(F.col("words") >= least)
        .select(
            "_id", "_text", "pos", "run", "before", "after", F.array_min("run").alias("mark"), (F.col("pos") + last).alias("at"),
            F.xxhash64("run").alias("whole"),
        )
    )


def selected(windows: DataFrame) -> DataFrame:
    """The fingerprints: each line that any window selects, once: _id, _text, at, mark."""
    return windows.select("_id", "_text", "at", "mark").dropDuplicates(["_id", "_text", "at"])


def repeated_lines(docs: DataFrame, least: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(documents with keys, flags): flags holds for each affected document an array of `gone`."""
    text = F.col(text_col)
    keyed = _keyed(docs, id_col, text_col)
    lines = (
        keyed.where(text.isNotNull())
        .select("_id", "_text", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
        .select("_id", "_text", "pos", F.xxhash64("line").alias("h"), F.greatest(F.lit(1), word_count(F.col("line"))).alias("weight"))
        .repartition("_id", "_text")
        .groupBy("_id", "_text", "pos").agg(F.min("h").alias("h"), F.min("weight").alias("weight"))
    )
    windows = _windows(lines, least)
    met = cut(selected(windows).groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"))
    open_ = windows.join(met, "mark", "left_semi")
    twice = open_.groupBy("mark", "whole").agg(F.count("*").alias("n")).where("n > 1").select("mark", "whole")
    again = open_.join(twice, ["mark", "whole"], "left_semi")
    place = F.struct("_id", "_text", "pos")
    first = again.groupBy("mark", "whole").agg(
        F.min(place).alias("first"),
        F.min_by(F.struct("run", "before", "after"), place).alias("there"),
    )
    runs = (
        again.join(first, ["mark", "whole"])
        .where((F.col("first") != place) & (F.col("run") == F.col("there.run")))
        .select(
            "_id", "_text",
            (F.col("pos") - _agree(F.col("before"), F.col("there.before"))).alias("a"),
            (F.col("pos") + F.size("run") - 1 + _agree(F.col("after"), F.col("there.after"))).alias("b"),
        )
    )
    gone = runs.distinct().select("_id", "_text", F.explode(F.sequence("a", "b")).alias("pos"), F.lit(True).alias("gone"))
    flags = (
        lines.select("_id", "_text", "pos", F.lit(False).alias("gone"))
        .unionByName(gone.distinct())
        .repartition("_id", "_text")
        .groupBy("_id", "_text", "pos").agg(F.max("gone").alias("gone"))
        .groupBy("_id", "_text").agg(F.sort_array(F.collect_list(F.struct("pos", "gone"))).alias("flags"), F.max("gone").alias("any"))
        .where("any").select(F.col("_id").alias("_id2"), F.col("_text").alias("_text2"), "flags")
    )
    return keyed, flags


def dedup_lines(
    docs: DataFrame, least: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Delete later repeats of runs of lines; returns the input's columns plus n_lines and n_removed.

    Winnowing: a window is the fewest lines from a line on that hold `least` words. It
    selects the line of least hash in it, the last of equal ones, and the lines that any
    window selects are the document's fingerprints. A repeated run of `least`
    words holds a window, and equal windows select the same line of it, so no
    such run is missed, not even a single line. Fingerprints that stand at one place only
    go. The windows that select the others are joined on the fingerprint
    and a hash of the window, so that a frequent short line does not pair unrelated
    places, each with the first one only: the least (id, text hash, line). The
    windows are compared line by line, and the match is extended both ways over the
    lines that both documents share there. The lines of a match are deleted from the
    later place. So each deleted line still stands at an earlier place, and repeats
    of fewer words stay.

    Lines are parted by line feeds and compared by 64-bit hashes. Null texts stay
    null (n_lines 0). A text all of whose lines go becomes empty; no row is dropped.
    Repeats inside a document count. A null id comes before all others. Rows that
    repeat an id and a text are one document: they come out alike. Rows that share only
    the id are documents of their own. A very long text's lines, with up to 3 x `least` hashes
    for each, are sorted by one task, which spills. Existing columns n_lines and n_removed are
    replaced. An empty table gives an empty result.
    """
    rows, name = neutral(docs.drop("n_lines", "n_removed"))
    target, text_col = text_col, name[text_col]
    keyed, flags = repeated_lines(rows, least, name[id_col], text_col)
    lines = F.split(F.col(text_col), "\n")
    left = F.filter(lines, lambda _, i: ~F.get(F.col("flags"), i)["gone"])
    own = F.coalesce(F.col("_text"), F.lit(0))
    return (
        keyed.join(flags, (F.col("_id") == F.col("_id2")) & (own == F.col("_text2")), "left")
        .withColumns({
            "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)),
            "n_removed": F.coalesce(F.size(F.filter("flags", lambda x: x["gone"])), F.lit(0)),
            "_left": F.when(F.col("flags").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n")),
        })
        .select(
            *[F.col("_left" if k == target else v).alias(k) for k, v in name.items()],
            "n_lines", F.greatest("n_removed", F.lit(0)).alias("n_removed"),
        )
    )


def _paired(rows: DataFrame, name: str, step: int, f) -> DataFrame:
    """The array `name`, each element joined by `f` with the one `step` places on; `step` elements fewer."""
    n = F.size(name) - step
    return rows.withColumn(name, F.zip_with(F.slice(name, F.lit(1), n), F.slice(name, F.lit(1 + step), n), f))


def _grams(rows: DataFrame, least: int, text_col: str) -> tuple[DataFrame, int]:
    """Arrays by the first word of each window of `least` words, and how many grams a window has.

    `whole` is the window's hash; `mark` the least hash of the grams in it. Grams are
    of the largest power of two words below `least`, as hashes of hashes, so an array
    takes log2(least) passes and not `least`.
    """
    gram = 1 << ((least - 1).bit_length() - 1)
    out = rows.withColumn("whole", F.transform(F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))).where(
        F.size("whole") >= least
    )
    step = 1
    while step < gram:
        out, step = _paired(out, "whole", step, lambda x, y: F.xxhash64(x, y)), 2 * step
    out = out.withColumn("mark", F.col("whole"))
    size, held = least - gram + 1, 1
    while held < size:
        step = min(held, size - held)
        out, held = _paired(out, "mark", step, lambda x, y: F.least(x, y)), held + step
    return _paired(out, "whole", least - gram, lambda x, y: F.xxhash64(x, y)), size


def repeated_passages(keyed: DataFrame, least: int, text_col: str) -> DataFrame:
    """The windows of `least` words that stand at an earlier place: _id, _text, pos (of the first word).

    A run of windows with one mark is a row. Equal windows have equal marks, so only the
    windows of marks that occur again are looked at one by one. Each is compared with
    the least (id, text hash, word) that has its hash; in one document it counts only
    if the two do not overlap.
    """
    spark = keyed.sparkSession
    grams, size = _grams(keyed.where(F.col(text_col).isNotNull()).select("_id", "_text", text_col), least, text_col)
    last = F.size("mark") - 1
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice("mark", F.lit(1), last))
    turns = F.filter(
        F.transform(
            F.zip_with("mark", before, lambda x, y: F.when(y.isNull() | (x != y), x)),
            lambda x, i: F.struct(x.alias("mark"), i.alias("a")),
        ),
        lambda r: r["mark"].isNotNull(),
    )
    runs = (
        grams.select("_id", "_text", last.alias("last"), turns.alias("turns"))
        .withColumn("run", F.explode(F.zip_with(
            "turns", F.slice("turns", F.lit(2), F.size("turns")),
            lambda x, y: F.struct(x["mark"].alias("mark"), x["a"].alias("a"), (y["a"] - 1).alias("b")),
        )))
        .select("_id", "_text", "run.mark", "run.a", F.coalesce("run.b", "last").alias("b"))
        .groupBy("_id", "_text", "a").agg(F.min("mark").alias("mark"), F.min("b").alias("b"))
    )
    runs = cut(runs)
    release(spark)
    # one gram is in `size` windows, so a longer run holds its mark twice
    times = F.sum(F.when(F.col("b") - F.col("a") >= size, 2).otherwise(1))
    twice = cut(runs.groupBy("mark").agg(times.alias("n")).where("n > 1").select("mark"))
    spans = (
        runs.join(twice, "mark", "left_semi").groupBy(F.col("_id").alias("_id2"), F.col("_text").alias("_text2"))
        .agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    )
    asked = keyed.select("_id", "_text", text_col).join(spans, (F.col("_id") == F.col("_id2")) & (F.col("_text") == F.col("_text2")))
    windows, _ = _grams(asked, least, text_col)
    windows = (
        windows.select("_id", "_text", F.explode("spans").alias("span"), "whole")
        .select(
            "_id", "_text", F.col("span.a").alias("a"),
            F.posexplode(F.slice("whole", F.col("span.a") + 1, F.col("span.b") - F.col("span.a") + 1)).alias("i", "whole"),
        )
        .select("_id", "_text", (F.col("a") + F.col("i")).alias("pos"), "whole")
    )
    windows = cut(windows)
    release(spark)
    place = F.struct("_id", "_text", "pos")
    first = cut(
        windows.groupBy("whole").agg(F.min(place).alias("first"), F.max(place).alias("latest"))
        .where(F.col("first") != F.col("latest")).select("whole", "first")
    )
    own = (F.col("first._id") == F.col("_id")) & (F.col("first._text") == F.col("_text"))
    return windows.join(first, "whole").where(~own | (F.col("pos") - F.col("first.pos") >= least)).select("_id", "_text", "pos").distinct()


def dedup_passages(
    docs: DataFrame, least: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Delete later repeats of passages of `least` words, wherever in lines they begin and end.

    Returns the input's columns plus n_removed, the words deleted. Words are compared
    exactly, white space between them is not. A word goes with the white space before
    it. Every window of `least` words that stands at an earlier place, by (id, text
    hash, word), goes from the later one; in one document, two places that overlap are
    one. Windows are compared by 64-bit hashes; windows that only arise where words
    went are not looked at again.

    Null texts stay null; a text all of whose words go keeps only the white space after
    them; no row is dropped. Null ids and repeated rows are treated as in
    `dedup_lines`. An existing column n_removed is replaced. `docs` is read several
    times, so pass a checkpointed frame.
    """
    rows, name = neutral(docs.drop("n_removed"))
    target, text_col = text_col, name[text_col]
    keyed = _keyed(rows, name[id_col], text_col)
    gone = cut(
        repeated_passages(keyed, least, text_col).groupBy(F.col("_id").alias("_id2"), F.col("_text").alias("_text2"))
        .agg(F.sort_array(F.collect_list("pos")).alias("starts"))
    )
    release(docs.sparkSession)
    end = lambda i: F.when(i == 0, 0).otherwise(F.get("starts", i - 1) + least)
    tail = F.element_at("starts", -1) + least
    kept = F.flatten(F.transform("starts", lambda s, i: F.slice("_words", end(i) + 1, F.greatest(F.lit(0), s - end(i)))))
    kept = F.concat(kept, F.slice("_words", tail + 1, F.greatest(F.lit(0), F.size("_words") - tail)))
    found = keyed.join(gone, (F.col("_id") == F.col("_id2")) & (F.col("_text") == F.col("_text2")), "left")
    return (
        found.withColumn("_words", F.when(F.col("starts").isNotNull(), F.regexp_extract_all(text_col, F.lit(SPACED_WORD), F.lit(0))))
        .withColumn("_kept", F.when(F.col("starts").isNotNull(), kept))
        .select(
            *[
                (F.when(F.col("starts").isNull(), F.col(v)).otherwise(
                    F.concat(F.array_join("_kept", ""), F.substr(F.col(v), F.length(F.array_join("_words", "")) + 1))
                ) if k == target else F.col(v)).alias(k)
                for k, v in name.items()
            ],
            F.coalesce(F.size("_words") - F.size("_kept"), F.lit(0)).alias("n_removed"),
        )
        .withColumn("n_removed", F.greatest("n_removed", F.lit(0)))
    )


def with_lengths(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """n_chars of the texts from which lines went, if there is such a column."""
    if chars_col not in docs.columns:
        return docs
    return docs.withColumn(chars_col, F.when(F.col("n_removed") > 0, F.length(text_col).cast("long")).otherwise(F.col(chars_col)))


#: The same result in DuckDB SQL, on whole lines instead of hashes.
SQL = r"""
    WITH l AS (
        SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS pos,
               unnest(string_split(text, chr(10))) AS line
        FROM documents WHERE text IS NOT NULL
    ), w AS (
        SELECT *, greatest(1, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS weight FROM l
    ), c AS (
        SELECT *, CAST(sum(weight) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS t FROM w
    ), e AS (
        SELECT *, t - weight AS f, list(line) OVER (PARTITION BY doc_id ORDER BY t RANGE BETWEEN 1 FOLLOWING AND 49 FOLLOWING) AS nxt
        FROM c
    ), win AS (
        SELECT doc_id, pos,
               list(line) OVER h AS run, sum(weight) OVER h AS words, last_value(nxt) OVER h AS aft,
               list_reverse(list(line) OVER (PARTITION BY doc_id ORDER BY f RANGE BETWEEN 49 PRECEDING AND 1 PRECEDING)) AS bef
        FROM e WINDOW h AS (PARTITION BY doc_id ORDER BY f RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
    ), anchors AS (
        SELECT * FROM win WHERE words >= 50
    ), r AS (
        SELECT *, row_number() OVER g AS n, first_value(bef) OVER g AS bef1, first_value(aft) OVER g AS aft1
        FROM anchors WINDOW g AS (PARTITION BY run ORDER BY doc_id, pos)
    ), x AS (
        SELECT doc_id,
               pos - coalesce(len(list_filter(range(1, 1 + least(len(bef), len(bef1))), lambda i: bef[1:i] = bef1[1:i])), 0) AS a,
               pos + len(run) - 1 + coalesce(len(list_filter(range(1, 1 + least(len(aft), len(aft1))), lambda i: aft[1:i] = aft1[1:i])), 0) AS b
        FROM r WHERE n > 1
    ), gone AS (
        SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos FROM x
    ), kept AS (
        SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) AS txt, count(*) AS n
        FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos
        WHERE g.pos IS NULL GROUP BY l.doc_id
    )
    SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.txt, '') END AS text,
           CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS INTEGER) AS n_lines,
           CAST(coalesce(len(string_split(d.text, chr(10))) - coalesce(k.n, 0), 0) AS INTEGER) AS n_removed
    FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
