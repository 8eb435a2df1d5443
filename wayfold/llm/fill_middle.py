"""Fill-in-the-middle transformation of texts, and its inverse."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import neutral, ship

#: What opens prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
_KINDS = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("fim_text", pa.string())]
_NEW = [k for k, _ in _KINDS]


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a document: the head of the SHA-256 of `seed:id`; no digits for a null id."""
    own = "" if doc_id is None else doc_id
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{own}".encode()).digest()[:16])


def token_edges(points: np.ndarray) -> np.ndarray:
    """Where tokens begin, in code points, and where the last one ends.

    A token is a run of ASCII letters or one other character, so one begins
    everywhere but between two letters.
    """
    letter = ((points | 32) - np.uint32(97)) < 26
    inner = np.flatnonzero(~(letter[1:] & letter[:-1])) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def cut_text(text: str, h: Sequence[int], sentinels: Sequence[str], plain_percent: int, spm_percent: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output as UTF-8) of one text."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    edges = token_edges(points)
    n = len(edges) - 1
    if not n or h[2] % 100 >= 100 - plain_percent or any(s in text for s in sentinels):
        return n, "plain", None, None, text.encode()
    ranks = h[0] % (n + 1), h[1] % (n + 1)
    a, b = edges[min(ranks)], edges[max(ranks)]
    prefix, middle, suffix = (x.tobytes().decode("utf-32-le").encode() for x in (points[:a], points[a:b], points[b:]))
    p, s, m = (x.encode() for x in sentinels)
    if h[3] % 100 < spm_percent:
        return n, "spm", int(a), int(b - a), b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", int(a), int(b - a), b"".join((p, prefix, s, suffix, m, middle))


def _checked(sentinels: Sequence[str]) -> tuple[str, str, str]:
    """Sentinels that no neighbouring text can complete: each has its first character at its start only, and all share it."""
    p, s, m = sentinels
    if len({p, s, m}) < 3 or not all(len(x) > 1 and x[0] == p[0] and x.count(p[0]) == 1 for x in (p, s, m)):
        raise ValueError("sentinels must differ and share a first character that stands nowhere else in them")
    if any(x != y and y.startswith(x) for x in (p, s, m) for y in (p, s, m)):
        raise ValueError("no sentinel may begin another")
    return p, s, m


def fill_in_middle(
    docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, sentinels: Sequence[str] = SENTINELS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Cut each text at two places between tokens and move its middle to the end.

    Returns the columns of `docs` plus n (tokens: runs of ASCII letters, or one other
    code point), form, prefix_chars, middle_chars and fim_text. A document's places and form
    depend on `seed` and its id alone. `plain_percent` of the texts stay as they are, as do empty
    ones and those that hold a sentinel; of the others `spm_percent` put the suffix first (spm),
    the rest the prefix (psm). `restored` gives the texts back.

    A text is decoded to an array of code points, the places where tokens begin are those not between two letters,
    and the chosen ones cut the array. No row leaves its partition. A null text counts as empty and comes
    out as an empty plain fim_text. A null id draws as an id without digits; rows that repeat an id
    are cut by the same numbers. A very long text is held whole by one task, at some 20 bytes a code point.
    Columns of `docs` with the new names are replaced. An empty table gives an empty result.
    """
    sentinels = _checked(sentinels)
    ship(docs.sparkSession)
    rows, name = neutral(docs.drop(*(c for c in docs.columns if c in _NEW)))

    def run(ids: pa.Array, texts: pa.Array) -> pa.Array:
        out = [
            cut_text(text.as_py() or "", draws(seed, own), sentinels, plain_percent, spm_percent)
            for own, text in zip(ids.to_pylist(), texts, strict=True)
        ]
        columns = zip(*out, strict=True) if out else [[] for _ in _KINDS]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, _KINDS, strict=True)], names=_NEW)

    run.__annotations__ = {"ids": pa.Array, "texts": pa.Array, "return": pa.Array}
    cut = F.arrow_udf(run, "n long, form string, prefix_chars long, middle_chars long, fim_text string")
    return rows.withColumn("_f", cut(F.col(name[id_col]).cast("long"), F.col(name[text_col]).cast("string"))).select(
        *[F.col(v).alias(k) for k, v in name.items()], "_f.*"
    )


def restored(output: Column | str = "fim_text", form: Column | str = "form", sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that `output` was made of, by column functions alone.

    A text that holds a sentinel is plain, and sentinels share a first character that they hold once, so the first
    place of each in an output is its own. Null in either column gives null.
    """
    p, s, m = _checked(sentinels)
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def between(opens: str, closes: str | None) -> Column:
        begin = F.instr(output, opens) + len(opens)
        end = F.instr(output, closes) if closes else F.length(output) + 1
        return F.substring(output, begin, end - begin)

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).when(form == "plain", output)


#: The op11 query in DuckDB SQL.
SQL = r"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
               sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
        FROM documents
    ), r AS (
        SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3,
               CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4,
               CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS y
        FROM d
    ), f AS (
        SELECT doc_id, t, n,
               CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
                    WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form,
               array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m,
               array_to_string(u[greatest(x, y) + 1:], '') AS s
        FROM r
    )
    SELECT doc_id, n, form,
           CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
                            ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM f
"""
