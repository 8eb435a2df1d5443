import json
import random
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from wayfold.llm import packing, unigram_count

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "a  b", " lead", "trail ", "x\n y", "it's  <|endoftext|> z<|endoftext|>q <|endoftext|>", "\t\ta b\n\n\nc", "é ü x  y 日本", "a b\x1c c d"]


def ids_of(texts):
    return [np.array(e.ids, dtype="<u4").tobytes() for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t'é.<|>1日 ", max_size=30), max_size=6))
def test_ids_equal_encoding_whole(texts):
    assert list(packing.encode_texts(texts, BPE)) == ids_of(texts)


@pytest.mark.parametrize(("name", "fast"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_every_vocabulary_file_as_its_own_library(name, fast):
    """The faster encoder stands in only for the vocabulary that it equals."""
    path = public_tokenizers.path(name)
    texts = [*ODD, "Mixed CASE words, cafe\u0301 and e\u0301", "don't  stop", "naïve Straße 12.5%"]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert list(packing.encode_texts(texts, path)) == want
    assert bool(packing._STATE["fast"]) == fast


def test_marks_that_the_faster_encoder_lacks(tmp_path):
    """A prefix space, a normaliser, merges out of order: all encoded as the file says."""
    spec = json.loads(Tokenizer.from_file(BPE).to_str())
    changes = {
        "space": lambda s: s["pre_tokenizer"].update(add_prefix_space=True),
        "lower": lambda s: s.update(normalizer={"type": "Lowercase"}),
        "order": lambda s: s["model"]["merges"].reverse(),
        "whole": lambda s: s["model"].update(ignore_merges=True),
    }
    for name, change in changes.items():
        own = json.loads(json.dumps(spec))
        change(own)
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(own))
        want = [np.array(e.ids, dtype="<u4").tobytes() for e in Tokenizer.from_file(str(path)).encode_batch(ODD, add_special_tokens=False)]
        assert list(packing.encode_texts(ODD, str(path))) == want
        assert packing._STATE["fast"] is None
    packing._STATE.clear()


def test_full_cache_changes_nothing(monkeypatch):
    texts = [*ODD, "some words that fill a small cache and some more words", "more words again"]
    want = ids_of(texts)
    packing._STATE.clear()
    monkeypatch.setattr(packing, "CACHE", 3)
    assert list(packing.encode_texts(texts, BPE)) == want == list(packing.encode_texts(texts, BPE))
    packing._STATE.clear()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9), st.integers(0, 40))
def test_closest_fill_is_the_best_subset(lengths, room):
    counts = {x: lengths.count(x) for x in lengths}
    used = packing.closest_fill(room, counts)
    assert all(c <= counts[x] for x, c in used.items())
    best = max(sum(c) for n in range(len(lengths) + 1) for c in combinations(lengths, n) if sum(c) <= room)
    assert sum(x * c for x, c in used.items()) == best


def test_plan_places_every_piece():
    counts = {x: random.Random(x).randint(0, 900) for x in range(1, 1025)}
    left = dict(counts)
    for times, pattern in packing.plan_windows(counts):
        assert sum(x * c for x, c in pattern.items()) <= 1024 and times > 0
        for x, c in pattern.items():
            left[x] -= times * c
    assert not any(left.values())


def check_packs(docs):
    rows = packing.pack(docs, BPE, with_ids=True).collect()
    by = {}
    for r in rows:
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        by.setdefault(r.sequence_id, []).append(r)
    for s in by.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    src = docs.select("doc_id", "text").collect()
    want = sorted(x + b"\0\0\0\0" for x in ids_of([r.text or "" for r in src]))
    whole, pieces = [], sorted(rows, key=lambda r: (str(r.doc_id), r.start))
    if len({r.doc_id for r in src}) == len(src):
        for i in {r.doc_id for r in src}:
            own = [r for r in pieces if r.doc_id == i]
            assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1]) and all(r.doc_tokens == sum(x.length for x in own) for r in own)
            whole.append(np.array([t for r in own for t in r.ids], dtype="<u4").tobytes())
        assert sorted(whole) == want
    assert sum(r.length for r in rows) == sum(map(len, want)) // 4
    return by


def test_packs_whole_table(docs):
    by = check_packs(docs)
    used = sum(r.length for s in by.values() for r in s)
    assert used >= 0.97 * 1024 * len(by)


def test_packs_odd_rows(odd_docs, no_docs):
    check_packs(odd_docs)
    check_packs(odd_docs.dropDuplicates(["doc_id"]))
    assert packing.pack(no_docs, BPE).count() == 0


# ----------------------------------------------------------------- unigram counts
VOCABULARY = unigram_count.load_vocabulary(PIECES)
MODEL, COUNTER = models.Unigram(VOCABULARY, 0, True), unigram_count.PieceCounter(VOCABULARY)


@settings(max_examples=300, deadline=None)
@given(st.text(min_size=1, max_size=25).filter(lambda s: not set(s) & set(" \t\n\r\x0b\x0c")))
def test_counts_equal_the_tokenizer(word):
    assert COUNTER.count(word)[0] == len(MODEL.tokenize(unigram_count.MARK + word))


def test_ties_equal_the_tokenizer():
    rng = random.Random(7)
    for _ in range(200):
        pieces = {"<unk>", unigram_count.MARK, *("".join(rng.choices("ab", k=rng.randint(1, 4))) for _ in range(8))}
        v = [("<unk>", 0.0), *((p, -float(rng.randint(1, 3))) for p in sorted(pieces - {"<unk>"}))]
        model, counter = models.Unigram(v, 0, False), unigram_count.PieceCounter(v)
        word = "".join(rng.choices("ab", k=12))
        if {"a", "b"} <= pieces:
            assert counter.count(word)[0] == len(model.tokenize(unigram_count.MARK + word))


def test_token_counts(odd_docs, no_docs, docs):
    for d in (odd_docs, docs):
        got = sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in unigram_count.token_counts(d, PIECES).collect())
        want = []
        for r in d.select("doc_id", "text").collect():
            words = [w.decode() for w in (r.text or "").encode().split()]
            known = {w: len(MODEL.tokenize(unigram_count.MARK + w)) for w in set(words)}
            want.append((str(r.doc_id), len(words), sum(known[w] for w in words)))
        assert got == sorted(want)
    assert unigram_count.token_counts(no_docs, PIECES).count() == 0


def test_control_pieces_are_ordinary_text(spark):
    silent = unigram_count.silent_pieces(PIECES)
    counter = unigram_count.PieceCounter(VOCABULARY, silent)
    spelled = {w: counter.count(w)[0] for w in ("<s>", "<unk>", "<0x41>")}
    assert spelled["<s>"] >= 3 and spelled["<unk>"] >= 3 and spelled["<0x41>"] >= 4
    kept = [(p, s) for p, s in VOCABULARY if p not in silent or p == "<unk>"]
    plain = models.Unigram(kept, next(i for i, (p, _) in enumerate(kept) if p == "<unk>"), False)
    for w in ("<s>", "a<s>b", "words", "<0x41>"):
        assert counter.count(w)[0] == len(plain.tokenize(unigram_count.MARK + w))
    got = unigram_count.token_counts(spark.createDataFrame([(1, "<s> <0x41>")], "doc_id long, text string"), PIECES).first()
    assert got.n_tokens == spelled["<s>"] + spelled["<0x41>"]


def test_scores_of_whole_texts(docs):
    """best_score and n_words, word by word in plain Python."""
    counter = unigram_count.PieceCounter(VOCABULARY, unigram_count.silent_pieces(PIECES))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in unigram_count.token_counts(docs, PIECES).collect():
        words = [w.decode() for w in (text[r.doc_id] or "").encode().split()]
        assert r.n_words == len(words) and abs(r.best_score - sum(counter.count(w)[1] for w in words)) < 1e-6 * max(1, len(words))
