"""Token counts: a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary pieces that occur in a text; dynamic programming
over their ends carries the best score and its piece count, without keeping any path. Tie rules
of the tokenizer: at an end, the piece that starts first wins among equals; a character that no
one-character piece matches may be an unknown, which costs 10 less than the least score and counts
one token for each of its UTF-8 bytes (byte fallback). Spaces become U+2581, and one leads
the text.

No piece has U+2581 after another character, so a text splits before each such mark that follows
one, and where all scores are whole numbers (sums in doubles are exact then) the stretches
are independent and a bounded memo keeps them. For other vocabularies the whole text is one stretch.

Edge cases: null or empty text has 0 tokens and score 0; repeated rows get equal results; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terselake.llm import common

MARK = "▁"
UNKNOWN_COST = 10.0
_STRETCH = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Stretches in the memo, and the length beyond which one is not kept.
_MEMO, _LONGEST = 400_000, 200


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[tuple[str, float], ...]
    least: float  # of all scores, those of control pieces included


def sentencepiece_vocabulary(path: str) -> Vocabulary:
    """The text pieces and scores of a SentencePiece model, read as a unigram vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(sp.get_piece_size())
    pieces = [(sp.id_to_piece(k), sp.get_score(k)) for k in every if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
    return Vocabulary(tuple(pieces), min(sp.get_score(k) for k in every))


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = frozenset(p for p, _ in vocabulary.pieces if len(p) == 1)
        self.unknown = vocabulary.least - UNKNOWN_COST
        self.splits = all(s == int(s) for _, s in vocabulary.pieces) and self.unknown == int(self.unknown) and not any(MARK in p.lstrip(MARK) for p, _ in vocabulary.pieces)
        self.memo = common.BoundedMemo(self.best, _MEMO)

    def best(self, text: str) -> tuple[float, int]:
        """(score, count) of the best segmentation of a marked text."""
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        done = 0  # ends settled so far
        single, unknown = self.single, self.unknown
        top, tokens = float("-inf"), 0

        def settle(end: int, top: float, tokens: int) -> None:
            ch = text[end - 1]
            if ch not in single and (s := score[end - 1] + unknown) > top:
                top, tokens = s, count[end - 1] + len(ch.encode("utf-8", "surrogatepass"))
            score[end], count[end] = top, tokens

        for last, (size, value) in self.automaton.iter(text):  # by end; of one end the longest first
            end = last + 1
            if end != done + 1:
                if top != float("-inf") or done < end - 1:
                    while done < end - 1:
                        done += 1
                        settle(done, top, tokens)
                        top, tokens = float("-inf"), 0
            s = score[end - size] + value
            if s > top:
                top, tokens = s, count[end - size] + 1
        while done < n:
            done += 1
            settle(done, top, tokens)
            top, tokens = float("-inf"), 0
        return score[n], count[n]

    def count(self, text: str) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        marked = MARK + text.replace(" ", MARK)
        if not self.splits:
            return self.best(marked)
        score, tokens = 0.0, 0
        memo = self.memo
        for stretch in _STRETCH.findall(marked):
            s, c = memo[stretch] if len(stretch) <= _LONGEST else self.best(stretch)
            score += s
            tokens += c
        return score, tokens


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, score`` of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the vocabulary, whatever the data

    def run(batch: pa.RecordBatch):
        counter = common.kept_in_worker(sent.value, lambda: Counter(sent.value))
        found = [counter.count(t) for t in common.texts_of(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for _, c in found], pa.int64()), pa.array([s for s, _ in found], pa.float64())], ["doc_id", "n_tokens", "score"])

    return common.map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_tokens long, score double")
