"""Sequence packing by minimum bin slack over the multiset of piece lengths."""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gapless_rank, ship

WINDOW = 1024
#: Entries of a worker's cache of rare words; later ones are encoded anew each time.
CACHE = 400_000
#: Characters of the longest word that the cache keeps.
CACHED_CHARS = 64
_STATE: dict = {}

#: Texts of these characters only go through the faster encoder of the same merges: there both
#: libraries' character classes are the same.
PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\u00a1-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]*")
#: No token crosses these places: before a single space between two other characters.
BREAK = re.compile(r"(?<=\S)(?= \S)")
#: How the vocabulary's pre-tokenizer parts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _of_the_fast_kind(tokenizer) -> bool:
    """Whether the file describes exactly what the faster encoder does.

    That is byte-level pairs parted by `PATTERN`, no normaliser, no marks inside or at the end of words, no way round
    the merges, and merges in the order of the ids that they make.
    """
    spec = json.loads(tokenizer.to_str())
    model, parts, vocab = spec["model"], spec["pre_tokenizer"] or {}, spec["model"]["vocab"]
    plain = (
        model.get("type") == "BPE" and not spec["normalizer"] and not spec["truncation"]
        and parts.get("type") == "ByteLevel" and not parts.get("add_prefix_space") and parts.get("use_regex", True)
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "fuse_unk", "ignore_merges"))
    )
    if not plain:
        return False
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    singles = [i for token, i in vocab.items() if len(token) == 1]
    return len(singles) == 256 and all(a < b for a, b in zip(made, made[1:])) and min(made, default=1 << 31) > max(singles)


def _fast_encoder(tokenizer):
    """The same byte-level vocabulary in a faster library; None if it is not of that kind.

    A token's string names each byte by a printable character: itself where it is
    printable, else the next character from 256 on. A merge's rank is its id.
    """
    import tiktoken

    if not _of_the_fast_kind(tokenizer):
        return None
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}
    added = {x.content for x in tokenizer.get_added_tokens_decoder().values()}
    try:
        ranks = {bytes(byte_of[c] for c in token): i for token, i in tokenizer.get_vocab().items() if token not in added}
        return tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    except (KeyError, ValueError):
        return None


def _tokenizer(path: str) -> dict:
    if _STATE.get("path") != path:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
        _STATE.update(path=path, tokenizer=tokenizer, added=added, words={}, fast=_fast_encoder(tokenizer))
    return _STATE


def _fast(text: str) -> np.ndarray:
    return np.array(_STATE["fast"].encode_ordinary(text), dtype="<u4")


def _whole(texts: list[str]) -> list[np.ndarray]:
    encoded = _STATE["tokenizer"].encode_batch_fast(texts, add_special_tokens=False)
    return [np.array(e.ids, dtype="<u4") for e in encoded]


def _mixed(texts: list[str]) -> list[np.ndarray]:
    """Texts with rare characters: runs of plain words go the fast way, each rare word is encoded once and looked up afterwards."""
    known = _STATE["words"]
    split = [[(bool(k), list(g)) for k, g in groupby(BREAK.split(t), PLAIN.fullmatch)] for t in texts]
    new = list({w for runs in split for plain, words in runs if not plain for w in words if w not in known})
    fresh = dict(zip(new, _whole(new), strict=True))
    known.update(islice(((w, x) for w, x in fresh.items() if len(w) <= CACHED_CHARS), max(0, CACHE - len(known))))
    return [
        np.concatenate([
            part for plain, words in runs
            for part in ([_fast("".join(words))] if plain else [fresh[w] if w in fresh else known[w] for w in words])
        ])
        for runs in split
    ]


def encode_arrays(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Each text's ids, equal to encoding it whole.

    The faster encoder takes texts of `PLAIN` characters. Others fall apart at `BREAK`, since the
    vocabulary's pre-tokenizer lets a token hold a space only as its first character. A
    text that holds an added token goes to the vocabulary's own library whole.
    """
    state = _tokenizer(path)
    out, rare, own = [], [], []
    for i, t in enumerate(texts):
        t = t or ""
        out.append(None)
        if not state["fast"] or any(x in t for x in state["added"]):
            own.append((i, t))
        elif PLAIN.fullmatch(t):
            out[i] = _fast(t)
        else:
            rare.append((i, t))
    for part, encode in ((own, _whole), (rare, _mixed)):
        for (i, _), ids in zip(part, encode([t for _, t in part]), strict=True):
            out[i] = ids
    return out


def encode_texts(texts: list[str | None], path: str):
    """Yield each text's ids as little-endian 32-bit bytes."""
    for ids in encode_arrays(texts, path):
        yield ids.astype("<u4", copy=False).tobytes()


def token_pieces(docs: DataFrame, path: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Each document's ids, then id 0, cut into full windows and one rest.

    (doc_id, start, length, ids_crc32, doc_tokens), with `with_ids` also the ids as an array.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        kinds += ", ids array<int>"
    out = pa.schema(fields)
    end = np.zeros(1, dtype="<u4")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                parts = [x for ids in encode_arrays(batch.column(1).to_pylist(), path) for x in (ids, end)]
                flat = np.concatenate(parts).astype("<u4", copy=False)
                tokens = np.array([len(x) + 1 for x in parts[::2]], dtype=np.int64)
                pieces = -(-tokens // window)
                doc = np.repeat(np.arange(len(tokens)), pieces)
                start = window * (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
                length = np.minimum(window, tokens[doc] - start)
                edge = np.concatenate([[0], np.cumsum(length)])  # pieces follow each other as the ids do
                raw = memoryview(flat.view(np.uint8))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens[doc]))]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(flat.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return docs.mapInArrow(run, kinds)


def closest_fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset of lengths whose sum is the closest to `room` from below.

    Bit s of a bitset says that some multiset sums to s. Copies of a length enter in
    powers of two. The bitset before each such step is kept, and walking back
    over the steps tells which of them the best sum took.
    """
    mask, bits, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            k = min(k, left)
            steps.append((bits, k, length))
            bits |= (bits << (k * length)) & mask
            left -= k
            k *= 2
        if bits >> room & 1:
            break
    total, used = bits.bit_length() - 1, {}
    for before, k, length in reversed(steps):
        if not before >> total & 1:
            total -= k * length
            used[length] = used.get(length, 0) + k
    return used


def plan_windows(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: copies in a window}) until every piece has a place.

    Each window starts from the longest piece left, and `closest_fill` picks what goes
    with it. The pattern is applied as often as the counts allow, so the work
    depends on the number of different lengths, not on the number of pieces.
    """
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    lengths = sorted(left)
    while lengths:
        seed = lengths[-1]
        left[seed] -= 1
        pattern = closest_fill(window - seed, left)
        left[seed] += 1
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(left[k] // c for k, c in pattern.items())
        for k, c in pattern.items():
            left[k] -= times * c
            if not left[k]:
                del lengths[bisect_left(lengths, k)], left[k]
        out.append((times, pattern))
    return out


def pack(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack all documents into windows of `window` tokens with little padding.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and with `with_ids` the ids. Only the counts of the at most
    `window` different lengths reach the driver; pieces of a length are numbered
    without gaps, and the number finds the window in the plan.

    A null or empty text is one piece, the id 0 alone. Rows are packed one by one, so
    null ids, repeated ids and repeated rows are allowed. A very long text is encoded whole
    by one task and cut afterwards. Other columns are ignored. An empty table gives an empty result. `path` is the vocabulary's file.
    """
    ship(docs.sparkSession)
    pieces = cut(token_pieces(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), path, window, with_ids))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    keys, base, per, offset = [], [], [], []
    taken = dict.fromkeys(counts, 0)
    sequence = 0
    for times, pattern in plan_windows(counts, window):
        at = 0
        for length in sorted(pattern, reverse=True):
            keys.append(length << 44 | taken[length])
            base.append(sequence)
            per.append(pattern[length])
            offset.append(at)
            taken[length] += times * pattern[length]
            at += length * pattern[length]
        sequence += times
    order = np.argsort(np.array(keys, dtype=np.int64))
    keys, base, per, offset = (np.array(x, dtype=np.int64)[order] for x in (keys, base, per, offset))
    names = [*pieces.columns, "sequence_id", "offset"]

    def place(batches):
        for batch in batches:
            length, nth = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "nth"))
            key = length << 44 | nth
            i = np.searchsorted(keys, key, side="right") - 1
            window_nth, copy = np.divmod(key - keys[i], per[i])
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(base[i] + window_nth), pa.array(offset[i] + copy * length)], names=names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return gapless_rank(pieces, ["length"], ["doc_id", "start", "ids_crc32"], "nth").mapInArrow(place, kinds)
