"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of (role, text) to one string. For every turn the
prefix that ends before it and the prefix that ends with it are rendered and compared: what
the second adds is the turn's span. If the second does not begin with the first, the template
has rewritten history; the row says how many characters it took back. The place of an
assistant's text inside its span is found by rendering the prefix with two other texts in its
place and seeing where the outputs part and meet again.

Every prefix is rendered whole, so the template may number turns, move or repeat messages,
demand an order of roles or drop old turns; the task holds one conversation and its work grows
with the square of the conversation's length.

A template may promise to look back at most so many turns (``looks_back``). Then a long
conversation is rendered in runs: after ``RUN_TURNS`` turns or ``RUN_CHARS`` characters the
prefixes begin with the last turns promised and those that these look back to. Inside a run
prefixes are rendered and compared as ever; where a run begins, its last turns must render as
they did in the run before, else the promise is broken and the job stops. The task holds a run
and its work grows with the length. A conversation of one run is rendered by whole prefixes.

Rows: turns are ordered by turn, then role, then text (null first, then as empty); rows that
repeat a turn are turns of their own. A null text or role is empty. Null conversation ids
form one conversation. Other columns are left out; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
START, END = "<|im_start|>", "<|im_end|>"
#: Turns, and characters of output, after which a template that looks back so far begins a run.
RUN_TURNS = 32
RUN_CHARS = 1_000_000
PIECE = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    """A text without ``<|``: a backslash goes between, one more where some stand there."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    """What ``escape`` was given."""
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """A role on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    """What ``escape_role`` was given."""
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def looks_back(turns: int) -> Callable[[Callable[[list[Turn]], str]], Callable[[list[Turn]], str]]:
    """A promise: no output of a turn depends on, or changes, what lies more turns before it."""

    def promise(template: Callable[[list[Turn]], str]) -> Callable[[list[Turn]], str]:
        template.looks_back = turns
        return template

    return promise


def marked(role: str, text: str) -> str:
    """A turn between marks, control strings inside it escaped."""
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


@looks_back(0)
def chat_markup(turns: list[Turn]) -> str:
    """The default template: marked turns, one after the other."""
    return "".join(marked(role, text) for role, text in turns)


def parsed(piece: str) -> Turn:
    """The turn that a span of the default template was made from."""
    role, text = PIECE.fullmatch(piece).groups()
    return unescape_role(role), unescape(text)


def shared_start(a: str, b: str) -> int:
    """Characters that both strings begin with."""
    most = min(len(a), len(b))
    return bisect_left(range(1, most + 1), True, key=lambda k: a[:k] != b[:k])


def text_place(template: Callable[[list[Turn]], str], before: list[Turn], role: str, out: str) -> tuple[int, int]:
    """Where the last turn's text lies in ``out``, found with two other texts in its place."""
    a, b = template([*before, (role, "a")]), template([*before, (role, "b")])
    head = shared_start(a, b)
    tail = shared_start(a[head:][::-1], b[head:][::-1])
    if out[:head] != a[:head] or (tail and out[-tail:] != a[-tail:]) or head + tail > len(out):
        raise ValueError("the template does not set a turn's text between the same strings")
    return head, len(out) - tail


class Prefixes:
    """The prefixes of one conversation, rendered and compared as its turns come."""

    def __init__(self, template: Callable[[list[Turn]], str], loss_role: str):
        self.template, self.loss_role = template, loss_role
        self.looks_back = getattr(template, "looks_back", None)
        self.before: list[Turn] = []
        self.kept = 0  # turns that an earlier run has rendered already
        self.last, self.at = "", 0

    def add(self, role: str, text: str) -> tuple[str, int, int, int | None, int | None, int]:
        """span, start, end, loss_start, loss_end and taken_back of the next turn."""
        out = self.template([*self.before, (role, text)])
        base = len(self.last) if out.startswith(self.last) else shared_start(self.last, out)
        start, taken_back = self.at, len(self.last) - base
        loss_start = loss_end = None
        if role == self.loss_role:
            first, end = text_place(self.template, self.before, role, out)
            loss_start, loss_end = start + first - base, start + end - base
        self.at += len(out) - base
        self.before.append((role, text))
        self.last = out
        if self.looks_back is not None:
            self._begin_run(max(1, self.looks_back))
        return out[base:], start, self.at, loss_start, loss_end, taken_back

    def _begin_run(self, turns: int) -> None:
        """Go on with the last turns alone, once there are many."""
        many = len(self.before) - self.kept >= max(RUN_TURNS, 2 * turns) or len(self.last) > RUN_CHARS
        if not many or len(self.before) <= 2 * turns:
            return
        self.before = self.before[-2 * turns :]
        self.kept = len(self.before)
        head, rendered = self.template(self.before[:-turns]), self.template(self.before)
        if not self.last.endswith(rendered[shared_start(head, rendered) :]):
            raise ValueError("the template looks back further than it promises")
        self.last = rendered


def formatted(
    conversations: DataFrame,
    template: Callable[[list[Turn]], str] | None = None,
    loss_role: str = "assistant",
) -> DataFrame:
    """A row for each turn, those of a conversation in order in one partition.

    ``span`` is what the turn adds, [start, end) its place in the conversation's output in
    code points, [loss_start, loss_end) that of a text under the loss mask (else null), and
    ``taken_back`` the characters of earlier output that the template rewrote at this turn.
    The template is ``chat_markup`` unless given.
    """
    template = template or chat_markup
    kind = conversations.schema["conv_id"].dataType.simpleString()
    turn_kind = conversations.schema["turn"].dataType.simpleString()
    ordered = (
        conversations.select(
            "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: object = run  # no id
        prefixes = Prefixes(template, loss_role)
        for batch in batches:
            rows = []
            for conv_id, turn, role, text in zip(batch["conv_id"], batch["turn"], batch["role"], batch["text"]):
                conv_id = None if pd.isna(conv_id) else conv_id
                if conv_id != current:
                    current, prefixes = conv_id, Prefixes(template, loss_role)
                rows.append((conv_id, None if pd.isna(turn) else turn, role, *prefixes.add(role, text)))
            yield pd.DataFrame(rows, columns=COLUMNS).astype(
                {"conv_id": object, "turn": object, "loss_start": "Int64", "loss_end": "Int64"}
            )

    return ordered.mapInPandas(
        run,
        f"conv_id {kind}, turn {turn_kind}, role string, span string, start bigint, end bigint, "
        "loss_start bigint, loss_end bigint, taken_back bigint",
    )


COLUMNS = ["conv_id", "turn", "role", "span", "start", "end", "loss_start", "loss_end", "taken_back"]


class Digest:
    """Counts and digests of one conversation, read back from its spans."""

    def __init__(self, conv_id: object):
        self.conv_id = conv_id
        self.n = self.chars = self.loss_chars = self.taken_back = 0
        self.whole, self.loss = hashlib.sha256(), hashlib.sha256()
        self.readable = True

    def add(self, row: tuple) -> None:
        self.n += 1
        self.chars += len(row.span) - row.taken_back
        self.taken_back += row.taken_back
        # Where history was rewritten, the spans are not the output any more.
        self.readable = self.readable and not row.taken_back and PIECE.fullmatch(row.span) is not None
        if not self.readable:
            return
        role, text = parsed(row.span)
        self.whole.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
        if not pd.isna(row.loss_start):
            under = unescape(row.span[int(row.loss_start) - row.start : int(row.loss_end) - row.start])
            self.loss_chars += len(under)
            self.loss.update(under.encode("utf-8", "replace"))

    def row(self) -> tuple:
        read = (self.whole.hexdigest(), self.loss_chars, self.loss.hexdigest()) if self.readable else (None, None, None)
        return (self.conv_id, self.n, *read, self.chars, self.taken_back)


def digests(turns: DataFrame) -> DataFrame:
    """One row for each conversation, read back from the spans of the default template.

    ``taken_back`` are the characters that the template rewrote in all. What cannot be read
    back, because history was rewritten or a span has another form, is null. ``turns`` comes
    from ``formatted``, whose partitions and order it relies on.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "taken_back"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: Digest | None = None
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                conv_id = None if pd.isna(row.conv_id) else row.conv_id
                if current is None or conv_id != current.conv_id:
                    if current:
                        rows.append(current.row())
                    current = Digest(conv_id)
                current.add(row)
            yield pd.DataFrame(rows, columns=names).astype({"conv_id": object, "loss_chars": "Int64"})
        if current:
            yield pd.DataFrame([current.row()], columns=names).astype({"conv_id": object, "loss_chars": "Int64"})

    return turns.mapInPandas(
        run,
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint, taken_back bigint",
    )
