"""Quality rules: counts over whole texts, and lines labelled as content or boilerplate.

A linear-chain conditional random field scores each line by its form (symbols, capitals,
table bars, repeats, digits, ends of sentences, words of notices) and each step from line to
line. Viterbi decoding gives the best sequence of labels for the whole text; the share of words
in content lines decides whether the text is kept.

The weights are fitted on all lines of all documents with a quality label; without labels
fixed default weights are used. A document's label says nothing about a single line. It bounds
the expected share of boilerplate lines: at most ``GOOD_SHARE`` in a good document, at least
``BAD_SHARE`` in a bad one. Which lines those are is latent, but for the seeds: a line that
stands between different neighbours in several documents is boilerplate. The fit
draws the model's line marginals to those closest to them that meet the bounds and the seeds
(posterior regularisation; one number per document shifts all its lines). Documents are dealt
into blocks by a hash, each block is fitted in a task, and the weights are the blocks' mean
(parameter mixing). Both labels are dealt on their own, the rarer one into several blocks at
once where it would not go round; seeds are counted over all documents.

Rows: a null text has no words, fails the base rule and is not kept. Labels of null quality
or for unknown documents are passed over. Repeated rows are judged each on their own and count
once in the fit, ties between the labels of a line go to content, other columns pass through whatever their names,
an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import Numbered, slices, stored

CONTENT_SHARE = 0.5
#: Bounds of the expected share of boilerplate lines that a document's label sets.
GOOD_SHARE, BAD_SHARE = 0.1, 0.9
#: Different pairs of neighbours in which a line is a seed.
SEED_CONTEXTS = 3
#: About so many texts, or lines if those are more, are fitted at a time; a label with fewer texts
#: than the last goes whole into every block.
BLOCK_TEXTS, BLOCK_LINES, LEAST_TEXTS = 4_000, 400_000, 200
#: Scores are not told apart beyond this.
LARGEST = 300.0
FEATURES = (
    "bias", "symbols", "capitals", "bars", "exclamations", "seen", "repeats", "digits", "short", "sentence", "length", "empty",
    "notice",
)
#: Words of licences, menus and notices (fixed values).
NOTICES = frozenset(
    b"copyright licence license licensed rights reserved cookie cookies privacy policy terms subscribe newsletter login "
    b"register menu home share click advertisement sitemap navigation skip".split()
)

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(0x41, 0x5B))
LETTERS = UPPER + bytes(range(0x61, 0x7B))
DIGITS = bytes(range(0x30, 0x3A))
PUNCTUATION = b".,;:!?()[]\"'"
SPACES = b" \t\n\x0b\x0c\r"
TAILS = bytes(range(0x80, 0xC0))  # bytes of a character after its first


@dataclass
class LineField:
    """Weights of a chain with two labels: content 0, boilerplate 1."""

    weights: np.ndarray = field(
        # What each feature says for boilerplate, where nothing could be fitted.
        default_factory=lambda: np.array([-2.0, 6, 4, 6, 4, 2, 4, 2, 0.5, -0.5, 0, 0, 14])
    )
    steps: np.ndarray = field(default_factory=lambda: np.array([[0.5, -0.5], [-0.5, 0.5]]))

    def decode(self, lines: np.ndarray) -> list[int]:
        """The best label sequence for the feature rows of one text."""
        if not len(lines):
            return []
        scores = (lines @ self.weights).tolist()
        (stay, leave), (enter, remain) = self.steps.tolist()
        content, boiler, back = 0.0, scores[0], []
        for score in scores[1:]:
            a, b = content + stay, boiler + enter
            c, d = content + leave, boiler + remain
            back.append((0 if a >= b else 1, 0 if c >= d else 1))
            content, boiler = (a if a >= b else b), (c if c >= d else d) + score
        label = 0 if content >= boiler else 1
        labels = [label]
        for choice in reversed(back):
            label = choice[label]
            labels.append(label)
        return labels[::-1]


def missing(data: bytes, drop: bytes) -> int:
    """How many bytes of ``data`` are among ``drop``."""
    return len(data) - len(data.translate(None, drop))


def line_features(lines: list[bytes], words: list[list[bytes]]) -> np.ndarray:
    """One row of features for each line."""
    rows, seen = [], set()
    for line, found in zip(lines, words):
        n = len(found)
        if not n:
            rows.append((1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0))
            continue
        size = sum(map(len, found))
        letters = missing(line, LETTERS)
        rows.append(
            (
                1,
                min(1.0, missing(line, SYMBOLS) / n),
                missing(line, UPPER) / letters if letters else 0,
                min(1.0, line.count(b"|") / n),
                min(1.0, line.count(b"!") / n),
                line in seen,
                1 - len(set(found)) / n,
                missing(line, DIGITS) / size,
                n < 4,
                found[-1][-1:] in (b".", b"!", b"?"),
                min(2.0, size / n / 10),
                0,
                min(1.0, sum(w.lower().strip(PUNCTUATION) in NOTICES for w in found) ** 2 / n),
            )
        )
        seen.add(line)
    return np.array(rows, np.float64).reshape(-1, len(FEATURES))


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three words that the text has at least twice."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pairs = ids[:-1] * n + ids[1:]
    if n >= 1 << 21:  # keep the product of three numbers below 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * n + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


def _split(text: str) -> tuple[bytes, list[bytes], list[list[bytes]]]:
    data = text.encode("utf-8", "replace")
    lines = data.split(b"\n")
    return data, lines, [line.split() for line in lines]


def judged(text: Column, model: LineField, share: float = CONTENT_SHARE) -> Column:
    """A struct of the counts of a text, its line labels (C or B) and the verdicts."""

    def one(text: str) -> tuple:
        data, lines, by_line = _split(text)
        words = [w for found in by_line for w in found]
        seen: set[bytes] = set()
        repeats = 0
        for line, found in zip(lines, by_line):
            if found:
                repeats += line in seen
                seen.add(line)
        labels = model.decode(line_features(lines, by_line))
        n, again = len(words), repeated_words(words)
        content = sum(len(found) for found, label in zip(by_line, labels) if not label)
        failed = n < 50 or 100 * again > 50 * n
        return (
            n,
            len(data) - missing(data, SPACES) - missing(data, TAILS),
            missing(data, SYMBOLS),
            repeats,
            again,
            "".join("CB"[label] for label in labels),
            content / n if n else 0.0,
            failed,
            not failed and content >= share * n,
        )

    kinds = {
        "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint",
        "line_labels": "string", "content_share": "double", "base_failed": "boolean", "kept": "boolean",
    }

    @F.pandas_udf(", ".join(f"{name}: {kind}" for name, kind in kinds.items()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([one(t) for texts in slices(batch, 1 << 30) for t in texts], columns=list(kinds))

    return run(text)


def line_hashes(lines: list[bytes], words: list[list[bytes]]) -> np.ndarray:
    """A number for each line, zero without words."""
    return np.array([xxhash.xxh64_intdigest(line) >> 1 if found else 0 for line, found in zip(lines, words)], np.int64)


def fitted(documents: DataFrame, labels: DataFrame) -> LineField:
    """Weights fitted on all lines of all documents with a label."""
    texts = stored(_described(documents, labels), "quality-lines")
    sizes = {r.bad: r for r in texts.groupBy("bad").agg(F.count("*").alias("texts"), F.sum("n").alias("lines")).collect()}
    if len(sizes) < 2:
        return LineField()
    blocks = max(-(-sum(r.texts for r in sizes.values()) // BLOCK_TEXTS), -(-sum(r.lines for r in sizes.values()) // BLOCK_LINES))

    def fit_block(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("h")
        bad = block["bad"].to_numpy()
        lines = [np.frombuffer(made, "<f4").reshape(-1, len(FEATURES)).astype(float) for made in block["features"]]
        seeded = [np.zeros(len(x), bool) for x in lines]
        for known, at in zip(seeded, block["at"]):
            known[at if at is not None else []] = True
        model = fit(lines, bad, seeded)
        return pd.DataFrame({"n": [len(block)], "weights": [[*model.weights, *model.steps.ravel()]]})

    parts = F.lit(blocks)
    for r in sizes.values():
        parts = F.when(F.col("bad") == r.bad, min(blocks, max(1, r.texts // LEAST_TEXTS))).otherwise(parts)
    among = F.sequence(F.pmod("h", parts.cast("bigint")), F.lit(blocks - 1).cast("bigint"), parts.cast("bigint"))
    dealt = texts.drop("hashes").join(_seeded(texts), "h", "left").select("h", "bad", "features", "at", F.explode(among).alias("block"))
    # Eighteen numbers for each block.
    found = dealt.groupBy("block").applyInPandas(fit_block, "n bigint, weights array<double>").collect()
    total = sum(r.n for r in found)
    # Exactly rounded sums do not depend on their order.
    mean = np.array([math.fsum(w * r.n / total for w, r in zip(of, found)) for of in zip(*(r.weights for r in found))])
    return LineField(mean[: len(FEATURES)], mean[len(FEATURES) :].reshape(2, 2))


def _described(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """h, bad, n, and features and hashes of the lines, of each labelled document; repeated rows are one."""

    @F.pandas_udf("struct<features: binary, hashes: array<bigint>>")
    def described(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for texts in slices(batch, 1 << 30):
                for text in texts:
                    _, split, words = _split(text)
                    out.append((line_features(split, words).astype("<f4").tobytes(), line_hashes(split, words)))
            yield pd.DataFrame(out, columns=["features", "hashes"], dtype=object)

    judged = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # Described before the join, which then moves features and no texts.
    made = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), described("text").alias("lines"))
    bad = (1 - F.col("quality").cast("int")).alias("bad")
    found = made.join(judged, "doc_id").dropDuplicates(["doc_id", "h"])
    return found.select("h", bad, F.size("lines.hashes").alias("n"), "lines.*")


def _seeded(texts: DataFrame) -> DataFrame:
    """h and at: the places of its lines that stand between different neighbours in several texts."""
    worded = F.array_remove("hashes", 0)
    nothing = F.array(F.lit(0).cast("bigint"))
    before = F.slice(F.concat(nothing, worded), F.lit(1), F.size(worded)).alias("before")
    after = F.concat(F.slice(worded, F.lit(2), F.size(worded)), nothing).alias("after")
    places = texts.where(F.size(worded) > 0).select(F.inline(F.arrays_zip(worded.alias("line"), before, after)).alias("line", "before", "after"))
    found = places.distinct().groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= SEED_CONTEXTS).select("line")
    return (
        texts.select("h", F.posexplode("hashes").alias("place", "line"))
        .join(found, "line")
        .groupBy("h")
        .agg(F.collect_list("place").alias("at"))
    )


def seeds(texts: list[np.ndarray], contexts: int = SEED_CONTEXTS) -> list[np.ndarray]:
    """For each text which of its lines stand between different neighbours in several texts.

    A copied passage brings its neighbours along, a notice or a menu does not.
    """
    places: dict[int, set[tuple[int, int]]] = {}
    for hashes in texts:
        padded = [0, *(h for h in hashes.tolist() if h), 0]
        for before, line, after in zip(padded, padded[1:], padded[2:]):
            places.setdefault(line, set()).add((before, after))
    return [np.array([len(places.get(h, ())) >= contexts for h in hashes.tolist()], bool) for hashes in texts]


class Chains:
    """Texts side by side, the longest first, for sums over label sequences: the plain way, a step for each line."""

    def __init__(self, texts: list[np.ndarray]):
        self.order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        self.lengths = np.array([len(texts[i]) for i in self.order])
        self.active = [int((self.lengths > t).sum()) for t in range(int(self.lengths[0]))]
        self.rows = [np.stack([texts[i][t] for i in self.order[:n]]) for t, n in enumerate(self.active)]

    def beside(self, values: list[np.ndarray]) -> list[np.ndarray]:
        """One value for each line, arranged like the rows."""
        return [np.array([values[i][t] for i in self.order[:n]]) for t, n in enumerate(self.active)]

    def marginals(self, scores: list[np.ndarray], steps: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Probability of boilerplate for each line, and of the four label pairs of each step.

        ``scores`` say for each line how much boilerplate outweighs content.
        """
        forward: list[np.ndarray] = []
        for t, score in enumerate(scores):
            here = np.stack([np.zeros(len(score)), score], axis=1)
            if t:
                before = forward[-1][: len(score)]
                here += np.logaddexp(before[:, :1] + steps[0], before[:, 1:] + steps[1])
            forward.append(here)
        single: list[np.ndarray] = [np.empty(0)] * len(scores)
        pairs: list[np.ndarray] = [np.empty((0, 2, 2))] * len(scores)
        ahead = np.zeros((0, 2))
        for t in range(len(scores) - 1, -1, -1):
            behind = np.zeros((len(scores[t]), 2))
            behind[: len(ahead)] = ahead
            joint = forward[t] + behind
            norm = np.logaddexp(joint[:, 0], joint[:, 1])
            single[t] = np.exp(joint[:, 1] - norm)
            here = behind + np.stack([np.zeros(len(joint)), scores[t]], axis=1)
            if t:
                before = forward[t - 1][: len(joint)]
                pairs[t] = np.exp(before[:, :, None] + steps + here[:, None, :] - norm[:, None, None])
                ahead = np.logaddexp(steps[:, 0] + here[:, :1], steps[:, 1] + here[:, 1:])
        return single, pairs


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2x2 matrices; their axes come before the last one."""
    return a[..., :, :1, :] * b[..., :1, :, :] + a[..., :, 1:, :] * b[..., 1:, :, :]


def running(matrices: np.ndarray) -> np.ndarray:
    """The products of all 2x2 matrices up to each place, each scaled by some number.

    ``matrices`` has the shape (2, 2, places). Runs of places go side by side, then each is
    multiplied by what stands before it, so that few steps do for a text of any length.
    """
    places = matrices.shape[2]
    length = min(64, math.isqrt(places))
    runs = -(-places // length)
    spare = np.broadcast_to(np.eye(2)[:, :, None], (2, 2, runs * length - places))
    made = np.concatenate([matrices, spare], axis=2).reshape(2, 2, runs, length).transpose(3, 0, 1, 2).copy()
    for t in range(length):
        if t:
            made[t] = _times(made[t - 1], made[t])
        made[t] /= made[t].reshape(4, runs).max(axis=0)
    if runs > 1:
        made[..., 1:] = _times(running(made[-1][:, :, :-1]), made[..., 1:])
    return made.transpose(1, 2, 3, 0).reshape(2, 2, -1)[:, :, :places]


def chances(scores: np.ndarray, first: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``Chains.marginals`` gives, for the lines of texts of any length one after the other.

    ``first`` marks the first line of each text. It has no pair, and its matrix forgets what came before.
    """
    matrices = np.where(first, 1.0, np.exp(steps)[:, :, None])
    matrices[:, 1] *= np.exp(np.clip(scores, -LARGEST, LARGEST))
    forward = running(matrices)[0]
    backward = np.ones_like(forward)
    if len(scores) > 1:
        backward[:, :-1] = running(matrices.transpose(1, 0, 2)[:, :, :0:-1]).sum(axis=0)[:, ::-1]
    joint = forward * backward
    single = joint[1] / joint.sum(axis=0)
    pairs = np.zeros_like(matrices)
    pairs[:, :, 1:] = forward[:, None, :-1] * matrices[:, :, 1:] * backward[None, :, 1:]
    pairs[:, :, 1:] /= pairs[:, :, 1:].sum(axis=(0, 1))
    pairs[:, :, first] = 0
    return single, pairs


def fit(
    texts: list[np.ndarray],
    bad: np.ndarray,
    seeded: list[np.ndarray] | None = None,
    rounds: int = 150,
    ridge: float = 1e-3,
) -> LineField:
    """Weights whose marginals meet the bounds of the labels and the seeds as closely as they can.

    ``bad`` is 1 for texts labelled bad. Each round shifts every text towards its bound and the
    weights towards the shifted marginals.
    """
    lengths, bad, x = np.array([len(t) for t in texts]), np.asarray(bad), np.concatenate(texts)
    starts, text = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(texts)), lengths)
    first = np.zeros(len(x), bool)
    first[starts] = True
    known = np.concatenate(seeded) if seeded is not None else np.zeros(len(x), bool)
    free = np.maximum(np.bincount(text, ~known), 1)
    total = float(len(x))
    # What the texts say little of stays near the default.
    prior = LineField() if texts[0].shape[1] == len(FEATURES) else LineField(np.zeros(texts[0].shape[1]))
    w, steps = prior.weights.copy(), prior.steps.copy()
    # Both kinds of text weigh the same, however rare one is.
    mass = np.where(bad == 1, 0.5 / max(1, (bad == 1) @ lengths), 0.5 / max(1, (bad == 0) @ lengths)) * total
    shift = np.where(bad == 1, 2.0, -2.0)
    speed_w, speed_s = np.zeros_like(w), np.zeros_like(steps)
    for _ in range(rounds):
        scores = x @ w
        own, own_pairs = chances(scores, first, steps)
        wanted, wanted_pairs = chances(scores + shift[text] + 30.0 * known, first, steps)
        grad_w = ((wanted - own) * mass[text]) @ x
        grad_s = (wanted_pairs - own_pairs) @ mass[text]
        # The shift pulls towards the bound and never beyond what the label says.
        share = np.bincount(text, wanted * ~known) / free
        shift = np.where(
            bad == 1, np.clip(shift + 2 * (BAD_SHARE - share), 0, 8), np.clip(shift + 2 * (GOOD_SHARE - share), -8, 0)
        )
        speed_w = 0.9 * speed_w + grad_w / total - ridge * (w - prior.weights)
        speed_s = 0.9 * speed_s + grad_s / total - 100 * ridge * (steps - prior.steps)
        w, steps = w + 0.5 * speed_w, steps + 0.1 * speed_s
    return LineField(w, steps)


def kept_documents(documents: DataFrame, model: LineField) -> DataFrame:
    """The documents that the rules keep, columns as they were."""
    numbered = Numbered(documents)
    judgement = judged(F.col(numbered.name("text")), model)
    return numbered.back(numbered.rows.withColumn("rules", judgement).where("rules.kept"))
