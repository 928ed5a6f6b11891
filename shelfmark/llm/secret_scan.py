"""Secret scans: fixed formats, and values that are hard to guess after credential words.

A value in credential context is cut at minimum cost into dictionary words, dates, repeats,
keyboard walks and brute-force characters; the cost is the decimal logarithm of the guesses
that an attacker who knows these patterns needs. Values that cost at least ``LEAST_COST`` are
reported, unless fixed formats cover them whole. The words are those of a public vocabulary,
whose order gives their ranks. A value in quotes ends at the closing one in its line; any other
ends at a space, at a tag, and at a comma, semicolon or quote that ends it by what follows.

Rows: a null text is empty and has no spans. Repeated rows are scanned each on their own,
other columns pass through whatever their names (the result is one struct column), an empty
table gives an empty one.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.llm.common import WORD_BPE, slices, vocabulary_path

#: Kinds in the order in which spans at one start are listed.
KINDS = ("assign", "access", "hex", "value")
LEAST_COST = 10.0

ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a shorter run would be dropped
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|private|auth|account)[_-]?key|bearer|credentials?)"""
    r"""["']?(?:[ \t]*+(?::|=>?|->)[ \t]*+|[ \t]++is[ \t]++)"""
    r"""(?:"((?:\\.|[^"\\\n]){6,}+)"(?![A-Za-z0-9])|'((?:\\.|[^'\\\n]){6,}+)'(?![A-Za-z0-9])|["']?+((?:[^\s"'<>,;]"""
    # Quotes, commas, semicolons and brackets inside a value, not those that end it.
    r"""|["'](?![\s"',;:)\]}<>]|\Z)|[,;](?![\s"',;<]|\Z|[A-Z_][\w.-]{0,63}["']?[ \t]{0,8}[:=])"""
    r"""|<(?!\s|\Z|!--|/?[A-Z][A-Z0-9-]{0,30}(?:[\s/][^<>\n]{0,200})?>)|>(?![\s<]|\Z)){6,}+))""",
    re.I | re.A,
)
CLOSERS = {")": "(", "]": "[", "}": "{"}
#: Rows of a keyboard; neighbours in a row, and keys above each other, are one step apart.
KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
#: What stands for letters in disguised words.
DISGUISE = str.maketrans("@4301!$57", "aaeoiisst")
#: A year, a date from the year on, and one from the day on; with four or two digits of the year.
DATES = [
    re.compile(pattern, re.A)
    for pattern in (
        r"(?:19|20)\d\d",
        r"(?:19|20)\d\d([-./]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])",
        r"(?:0[1-9]|[12]\d|3[01])([-./]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d",
        r"(?:0[1-9]|[12]\d|3[01])([-./]?)(?:0[1-9]|1[0-2])\1\d\d",
    )
]
#: Least characters of a word and of a walk.
WORD_CHARS, WALK_CHARS = 3, 4
#: No character costs less by brute force.
LEAST_CHARACTER = 1.0
#: What another part costs that an attacker has to think of.
JOINT = math.log10(2)


def _neighbours() -> frozenset[tuple[str, str]]:
    pairs = set()
    for r, row in enumerate(KEYBOARD):
        for c, key in enumerate(row):
            near = [row[c + 1 : c + 2]] + [KEYBOARD[r + 1][k : k + 1] for k in (c - 1, c) if r + 1 < len(KEYBOARD) and k >= 0]
            for other in filter(None, near):
                pairs |= {(key, other), (other, key)}
    return frozenset(pairs)


NEIGHBOURS = _neighbours()


class Words:
    """Logarithm of the rank of each whole word of a vocabulary, and how long words can be."""

    def __init__(self, words: list[str]):
        self.costs = {w: math.log10(rank) for rank, w in enumerate(words, 2)}
        self.longest: dict[str, int] = {}
        for w in self.costs:
            head = w[:WORD_CHARS]
            self.longest[head] = max(len(w), self.longest.get(head, 0))


@cache
def loaded_words(path: str) -> Words:
    """The whole words of a vocabulary file, in its order."""
    with open(path, encoding="utf-8") as file:
        vocab = json.load(file)["model"]["vocab"]
    words = [t.removesuffix("</w>") for t in sorted(vocab, key=vocab.get) if t.endswith("</w>")]
    return Words([w for w in words if len(w) >= WORD_CHARS and w.isalpha()])


def brute_cost(character: str) -> float:
    """Logarithm of the characters that one like this is picked from."""
    if character.isdigit():
        return LEAST_CHARACTER
    if character.isalpha():
        return math.log10(26)
    return math.log10(33)


class Stretches:
    """Where the stretch around a place ends in which each character equals the one a unit before.

    Places are asked for in ascending order, so a stretch is walked through once.
    """

    def __init__(self, value: str, unit: int):
        self.value, self.unit, self.end = value, unit, 0

    def end_from(self, i: int) -> int:
        value, unit = self.value, self.unit
        if i + unit >= self.end:
            j, n = i + unit, len(value)
            while j < n and value[j] == value[j - unit]:
                j += 1
            self.end = j
        return self.end


def guess_cost(value: str, words: Words, bound: float = math.inf) -> float:
    """Decimal logarithm of the guesses for a value, by its cheapest segmentation.

    Infinite where that is not below ``bound``: no cost is negative, so places that cost as
    much are left alone, and so are repeats whose unit alone costs as much. Under a bound the
    work grows in proportion to the value; without one it grows with the square.

    A repeat may end after any number of turns. Of two starts of one stretch, whole units
    apart, the later is left out where the earlier reaches all its ends at no higher cost.
    """
    n, lower = len(value), value.lower()
    if len(lower) != n:  # a letter whose small form is longer
        lower = value
    plain = lower.translate(DISGUISE)
    forms = [(lower, 0.0)] if plain == lower else [(lower, 0.0), (plain, JOINT)]
    units = min(n // 2, int(min(bound, n) / LEAST_CHARACTER))
    stretches = [Stretches(value, unit) for unit in range(1, units + 1)]
    starts: dict[tuple[int, int, int], list[int]] = {}  # of repeats, by unit, stretch and residue
    best = [0.0] + [math.inf] * n
    furthest = 0
    for i in range(n):
        if i > furthest:
            break
        so_far = best[i]
        if so_far >= bound:
            continue
        here = so_far + (JOINT if i else 0.0)

        def offer(end: int, cost: float) -> None:
            nonlocal furthest
            if cost < best[end]:
                best[end] = cost
                if cost < bound and end > furthest:
                    furthest = end

        # Brute force continues at no cost for a new part.
        offer(i + 1, so_far + brute_cost(value[i]))
        for form, extra in forms:
            for j in range(i + WORD_CHARS, min(n, i + words.longest.get(form[i : i + WORD_CHARS], 0)) + 1):
                cost = words.costs.get(form[i:j])
                if cost is not None:
                    capitals = sum(c.isupper() for c in value[i:j])
                    offer(j, here + cost + extra + (JOINT * min(capitals, j - i - capitals + 1) if capitals else 0.0))
        for date in DATES:
            if found := date.match(value, i):
                end = found.end()
                offer(end, here + (math.log10(120) if end - i == 4 else math.log10(120 * 366)))
        unit_cost = 0.0
        for unit, stretch in enumerate(stretches, 1):
            if i + unit >= n:
                break
            unit_cost += brute_cost(value[i + unit - 1])
            if here + unit_cost >= bound:
                break
            end = stretch.end_from(i)
            if end - i < max(2 * unit, 3):
                continue
            own = starts.setdefault((unit, end, i % unit), [])
            if any(so_far - best[k] >= math.log10(((i - k) // unit + 2) / 2) for k in own):
                continue
            own.append(i)
            for times in range(2, (end - i) // unit + 1):
                if unit * times >= 3:
                    offer(i + unit * times, here + unit_cost + math.log10(times))
        turns = 0
        for j in range(i + 1, n):
            if (lower[j - 1], lower[j]) not in NEIGHBOURS:
                break
            if j - i >= 2:
                turns += ord(lower[j]) - ord(lower[j - 1]) != ord(lower[j - 1]) - ord(lower[j - 2])
            if j - i + 1 >= WALK_CHARS:
                cost = here + math.log10(36) + math.log10(j - i + 1) + turns * math.log10(4)
                if cost >= bound:
                    break
                offer(j + 1, cost)
    return best[n] if best[n] < bound else math.inf


def value_place(match: re.Match[str]) -> tuple[int, int]:
    """Where the value of a context match lies, without brackets that were opened before it."""
    start, end = match.span(match.lastindex)
    if match.lastindex == 3:
        value = match[3]
        counts = {c: value.count(c) for pair in CLOSERS.items() for c in pair}
        while end > start and (last := value[end - start - 1]) in CLOSERS and counts[last] > counts[CLOSERS[last]]:
            counts[last] -= 1
            end -= 1
    return start, end


def spans_of(text: str, words: Words, least: float) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(start, end, kind) of the fixed formats, and of the values that the cost adds."""
    base = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base.sort(key=order)
    starts, ends = [], []  # of what fixed spans cover, joined where they meet
    for start, end, _ in base:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    added = []
    for m in CONTEXT.finditer(text):
        start, end = value_place(m)
        before = bisect_right(starts, start)
        covered = before and ends[before - 1] >= end
        if not covered and end - start >= 6 and guess_cost(text[start:end], words, least) >= least:
            added.append((start, end, "value"))
    return base, sorted(base + added, key=order)


def scanned(text: Column, path: str | None = None, least: float = LEAST_COST) -> Column:
    """struct<base, spans>: arrays of (kind, start, end) in code points, end exclusive."""
    path = path or vocabulary_path(WORD_BPE)
    spans = "array<struct<kind: string, start: bigint, end: bigint>>"

    @F.pandas_udf(f"base: {spans}, spans: {spans}")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = loaded_words(path)
        as_rows = lambda found: [{"kind": k, "start": a, "end": b} for a, b, k in found]
        for batch in batches:
            found = [spans_of(t, words, least) for texts in slices(batch, 1 << 30) for t in texts]
            yield pd.DataFrame({"base": [as_rows(b) for b, _ in found], "spans": [as_rows(s) for _, s in found]})

    return run(text)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
