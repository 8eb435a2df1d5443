"""Token counts with a count-only Viterbi over a unigram vocabulary."""

from __future__ import annotations

import math

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

MARK = "▁"
#: What an unknown character scores below the vocabulary's least score.
UNKNOWN_PENALTY = 10.0
#: Entries of a worker's word cache; later words are counted anew each time.
CACHE = 400_000
_STATE: dict = {}


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file by id. Their log-probabilities follow Zipf's law in the id.

    The public vocabularies are of the merge kind, whose scores are only ranks; the rule
    -ln(id + 1) gives the unigram scores without any training.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), -math.log(i + 1)) for i in range(model.get_piece_size())]


def silent_pieces(path: str) -> set[str]:
    """Pieces that no text matches: the unknown one, control pieces, and the names of single bytes."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return {m.id_to_piece(i) for i in range(m.get_piece_size()) if m.is_control(i) or m.is_byte(i) or m.is_unknown(i) or m.is_unused(i)}


class PieceCounter:
    """Counts the pieces of a word's best segmentation without building it. Pieces in `silent` match nothing."""

    def __init__(self, vocabulary: list[tuple[str, float]], silent: set[str] = frozenset()):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece not in silent:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.words: dict[bytes, tuple[int, float]] = {}

    def count(self, word: str) -> tuple[int, float]:
        """(pieces, best score) of the marked word.

        Matches come by their ends, those with one end from the longest to the
        shortest, that is by ascending start. A later candidate must be strictly
        better, which is the tokenizer's rule for ties. A character that is no piece
        itself may be unknown at the penalty, tried last; it counts as its UTF-8 bytes.
        """
        s = MARK + word
        n = len(s)
        best, pieces = [0.0] * (n + 1), [0] * (n + 1)
        done = 0
        score, number, single = -math.inf, 0, False

        def close(upto: int) -> None:
            nonlocal done, score, number, single
            while done < upto:
                done += 1
                if not single and (x := best[done - 1] + self.unknown) > score:
                    score, number = x, pieces[done - 1] + len(s[done - 1].encode())
                best[done], pieces[done] = score, number
                score, number, single = -math.inf, 0, False

        for end, (length, weight) in self.automaton.iter(s):
            if end > done:
                close(end)
            start = end + 1 - length
            x = best[start] + weight
            if x > score:
                score, number = x, pieces[start] + 1
            if length == 1:
                single = True
        close(n)
        return pieces[n], best[n]

    def look_up(self, word: bytes) -> tuple[int, float]:
        got = self.words.get(word)
        if got is None:
            got = self.count(word.decode())
            if len(self.words) < CACHE:
                self.words[word] = got
        return got

    def text(self, text: bytes) -> tuple[int, int, float]:
        """(words, tokens, score) of a text."""
        words = text.split()  # bytes part at space and 0x09-0x0D only
        get, tokens, score = self.words.get, 0, 0.0
        for w in words:
            n, x = get(w) or self.look_up(w)
            tokens += n
            score += x
        return len(words), tokens, score


def _counter(path: str) -> PieceCounter:
    if path not in _STATE:
        _STATE[path] = PieceCounter(load_vocabulary(path), silent_pieces(path))
    return _STATE[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens and best_score of each document.

    A text is parted at runs of space and 0x09-0x0D; each word, marked at its start,
    is segmented on its own, as no piece crosses a word's start. best_score is the
    sum of its words' best scores.

    A text that spells a control piece's name, such as <s>, is ordinary text. Null and empty texts
    have no tokens; a very long text is counted whole by one task, word by word. Null ids and repeated rows are counted like
    others, other columns are ignored, and an empty table gives an empty result.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("best_score", pa.float64())])

    def run(batches):
        counter = _counter(path)
        for batch in batches:
            rows = [counter.text(x or b"") for x in batch.column(1).cast(pa.large_binary()).to_pylist()]
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(out)[1:], strict=True))], schema=out)

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_tokens long, best_score double"
    )
