"""Fill-in-middle transformation with a sparse index of multibyte characters.

A run of texts is one buffer of UTF-8 bytes. Only its multibyte characters are recorded: where
each begins and how many bytes beyond one it takes. A binary search in these places converts a
cut between code points and bytes; between two of them a cut moves by plain arithmetic, so
ASCII text needs no entry at all. Units are found in the bytes, cuts are reported in code
points, and the pieces are sliced from the bytes.

Rows: a null text is an empty one, and an empty text, like one that contains a mark, stays
plain. A null key is hashed as an empty one. Repeated rows give the same result, other columns
pass through untouched, whatever their names: the result is one struct column. An empty table
gives an empty table. A text of any length is cut as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = tuple(mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))
#: Bytes of text that share one buffer; a longer text has a buffer of its own.
RUN_BYTES = 4_000_000


class MultibyteIndex:
    """Places and excess bytes of the multibyte characters of a UTF-8 buffer."""

    def __init__(self, buffer: np.ndarray):
        self.byte_at = np.flatnonzero(buffer >= 0xC0)
        first = buffer[self.byte_at]
        extra = 1 + (first >= 0xE0) + (first >= 0xF0)
        #: Excess bytes before the k-th multibyte character; the last entry counts all.
        self.excess = np.concatenate(([0], np.cumsum(extra, dtype=np.int64)))
        self.point_at = self.byte_at - self.excess[:-1]

    def points(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before each byte place (that of a character's first byte, or the end)."""
        return cuts - self.excess[np.searchsorted(self.byte_at, cuts)]

    def bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Bytes before each code point."""
        return cuts + self.excess[np.searchsorted(self.point_at, cuts)]


class Run:
    """Texts laid end to end, with their ends in bytes and their units."""

    def __init__(self, texts: list[bytes], unit: str):
        self.texts = texts
        self.buffer = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate(([0], self.ends[:-1]))
        self.index = MultibyteIndex(self.buffer)
        if unit == "word":
            places = self._word_starts()
            self.first = np.searchsorted(places, self.starts)
            self.n_units = np.searchsorted(places, self.ends) - self.first
            self.places = np.append(places, len(self.buffer))
        elif unit == "character":
            self.places = None
            self.first = self.index.points(self.starts)
            self.n_units = self.index.points(self.ends) - self.first
        else:
            raise ValueError(f"units are 'word' or 'character', not {unit!r}")

    def _word_starts(self) -> np.ndarray:
        """Bytes where a run of ASCII letters or any other character begins."""
        letter = ((self.buffer | 0x20) - np.uint8(ord("a"))) < 26
        inside = np.zeros(len(letter), bool)
        inside[1:] = letter[1:] & letter[:-1]
        inside[self.starts[self.starts < self.ends]] = False  # another text's letters end before
        return np.flatnonzero(~inside & ((self.buffer & 0xC0) != 0x80))

    def cuts(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte places, and code points since the text's start, after so many units of each text."""
        if self.places is None:
            at = self.index.bytes(self.first + units)
        else:
            at = np.where(units < self.n_units, self.places[np.minimum(self.first + units, len(self.places) - 1)], self.ends)
        return at, self.index.points(at) - self.index.points(self.starts)


def _arranged(run: Run, numbers: list[np.ndarray], plain_from: int, spm_below: int) -> pd.DataFrame:
    h1, h2, h3, h4 = numbers
    one, two = h1 % (run.n_units + 1), h2 % (run.n_units + 1)
    low, low_points = run.cuts(np.minimum(one, two))
    high, high_points = run.cuts(np.maximum(one, two))
    forms, outputs = [], []
    for text, start, a, b, to_plain, to_spm in zip(
        run.texts, run.starts.tolist(), low.tolist(), high.tolist(), h3 % 100 >= plain_from, h4 % 100 < spm_below
    ):
        if not text or to_plain or any(mark in text for mark in MARKS):
            forms.append("plain")
            outputs.append(text)
            continue
        prefix, middle, suffix = text[: a - start], text[a - start : b - start], text[b - start :]
        parts = (SUFFIX, suffix, PREFIX, prefix) if to_spm else (PREFIX, prefix, SUFFIX, suffix)
        forms.append("spm" if to_spm else "psm")
        outputs.append(b"".join((parts[0].encode(), parts[1], parts[2].encode(), parts[3], MARKS[2], middle)))
    plain = np.array([form == "plain" for form in forms], bool)
    return pd.DataFrame(
        {
            "n": run.n_units,
            "form": forms,
            "prefix_chars": pd.array(low_points, "Int64"),
            "middle_chars": pd.array(high_points - low_points, "Int64"),
            "output": [text.decode("utf-8", "replace") for text in outputs],
        }
    ).assign(
        prefix_chars=lambda rows: rows["prefix_chars"].mask(plain),
        middle_chars=lambda rows: rows["middle_chars"].mask(plain),
    )


def transformed(text: Column, key: Column, unit: str = "word", plain_from: int = 90, spm_below: int = 20) -> Column:
    """struct<n, form, prefix_chars, middle_chars, output> for each text.

    A unit is a run of ASCII letters or any other character (``word``), or any ``character``;
    ``n`` counts them. The digest of ``key`` (a string) gives four numbers: the smaller of the
    first two modulo n + 1 is the units of the prefix, the larger those before the suffix; the
    third modulo 100 leaves a text plain from ``plain_from`` on; the fourth below ``spm_below``
    puts the suffix first. Character counts are null where the text stays plain.
    """
    digest = F.sha2(F.coalesce(key, F.lit("")), 256)
    numbers = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]

    @F.pandas_udf("struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, *drawn in batches:
            drawn = [series.to_numpy(np.int64) for series in drawn]
            done = 0
            for part in _runs(texts):
                those = [series[done : done + len(part)] for series in drawn]
                done += len(part)
                yield _arranged(Run(part, unit), those, plain_from, spm_below)

    return run(text.cast("binary"), *numbers)


def _runs(texts: pd.Series) -> Iterator[list[bytes]]:
    """The texts of a batch in order, null as empty; one empty run for an empty batch."""
    run: list[bytes] = []
    size = 0
    for text in texts:
        run.append(text or b"")
        size += len(run[-1])
        if size >= RUN_BYTES:
            yield run
            run, size = [], 0
    if run or not len(texts):
        yield run


def restored(output: Column, form: Column) -> Column:
    """The text that ``transformed`` was given, rebuilt from its output and form.

    No mark stands inside the pieces, and none can arise where a piece meets a mark.
    """
    pieces = F.split(output, "<[PSM]>")
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(pieces[1], pieces[3], pieces[2]))
        .when(form == "spm", F.concat(pieces[2], pieces[3], pieces[1]))
    )
