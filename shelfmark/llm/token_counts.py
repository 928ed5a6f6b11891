"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates all pieces that end at each character; dynamic
programming carries, for each end, the best score and the number of pieces of the path that
has it, never the path itself. Ties go as in the tokenizers library: at equal score the piece
that starts earlier stays, and a character that no single-character piece covers may be an
unknown one, scored below every piece, tried last. Unknown stretches count as their bytes if
the vocabulary has byte pieces, else as one.

The pieces and scores of a public sentencepiece file are taken as a unigram vocabulary. A
text is scored as its stretches of spaces and following characters where no token can join the
end of one with the beginning of the next (checked on loading; else as a whole), so their best
paths add up. Equal stretches are scored once per run.

Rows: a null text is empty and counts 0. Repeated rows count each on their own, other columns
pass through whatever their names, an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.llm.common import PIECE_BPE, slices, vocabulary_path

SPACE = "▁"
#: How far below the worst piece the library scores an unknown character (fixed value).
UNKNOWN_PENALTY = 10.0
RUN_CHARS = 2_000_000
KEPT_STRETCHES = 500_000


class Unigram:
    """A unigram vocabulary that counts."""

    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool):
        self.scores = dict(pieces)
        self.byte_pieces = byte_pieces
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY
        self.single = {p for p in self.scores if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        joined = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.scores)
        # Nor may an unknown stretch that is one token go on past a space.
        joined |= not byte_pieces and SPACE not in self.single
        self.stretches = re.compile(".+" if joined else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", re.DOTALL).findall
        self.kept: dict[str, int] = {}

    def count(self, text: str) -> int:
        """Pieces of the best path through a stretch."""
        n = len(text)
        # For each end: best score, pieces before an open unknown stretch, its bytes (or -1).
        best: list[tuple[float, int, int]] = [(0.0, 0, -1)] + [(0.0, -1, -1)] * n
        single = self.single

        def close(end: int) -> None:
            """The last resort of a character: to be unknown."""
            if text[end - 1] in single:
                return
            score, count, unknown = best[end - 1]
            score += self.unknown
            if best[end][1] < 0 or score > best[end][0]:
                size = len(text[end - 1].encode()) if self.byte_pieces else 1
                if unknown < 0:
                    best[end] = (score, count + size, 0)
                else:  # the stretch goes on: its bytes add up, or it stays one token
                    best[end] = (score, count + (size if self.byte_pieces else 0), 0)

        done = 0
        for last, (length, score) in self.automaton.iter(text):
            end = last + 1
            while done < last:
                done += 1
                close(done)
            score += best[end - length][0]
            if best[end][1] < 0 or score > best[end][0]:
                best[end] = (score, best[end - length][1] + 1, -1)
        while done < n:
            done += 1
            close(done)
        return best[n][1]

    def total(self, text: str) -> int:
        """Pieces of a whole text, with a space put before it."""
        if not text:
            return 0
        kept, found = self.kept, 0
        for stretch in self.stretches(SPACE + text.replace(" ", SPACE)):
            count = kept.get(stretch)
            if count is None:
                count = kept[stretch] = self.count(stretch)
            found += count
        return found


def from_sentencepiece(path: str) -> Unigram:
    """Pieces and scores of a sentencepiece file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    return Unigram(pieces, any(model.is_byte(i) for i in range(model.get_piece_size())))


@cache
def loaded(path: str) -> Unigram:
    """The vocabulary, read once per worker."""
    return from_sentencepiece(path)


def counted(text: Column, path: str | None = None) -> Column:
    """The number of pieces of each whole text."""
    path = path or vocabulary_path(PIECE_BPE)

    @F.pandas_udf("bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(path)
        for batch in batches:
            counts: list[int] = []
            for texts in slices(batch, RUN_CHARS):
                if len(model.kept) > KEPT_STRETCHES:
                    model.kept.clear()
                counts += map(model.total, texts)
            yield pd.Series(counts, dtype="int64")

    return run(text)
