"""Quality classifier from weak labels.

Eight heuristic labellers vote good, bad or abstain on every document. Expectation-maximisation over the
counts of all vote patterns estimates how often each labeller is right when it votes, with
no true label used; classes count as equally likely before any vote. The posterior of a document's pattern then is its soft label,
and a linear scorer over hashed word shapes (and pairs of neighbouring shapes) is trained
on the soft labels of all documents. The threshold is the score that keeps nearly all of
what the posterior calls good.

Everything that is gathered has a fixed size: at most 3**8 patterns, two vectors of ``BINS`` weights,
and a histogram of scores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from splicelake.llm.common import short_batches, summed_vectors, text_of

BINS = 1 << 14
LABELLERS = ("symbols", "capitals", "repeats", "runs", "doubled_marks", "bars", "sentence_ends", "lower_starts")
#: Share of the good mass (by posterior) that may fall below the threshold.
LOSS = 0.001
#: Scores are log odds per word, held in steps of 1/64 between -16 and 16.
STEP, SPAN = 1 / 64, 16.0

# Byte classes: 0 space, 1 upper, 2 lower, 3 digit, 4 sentence end, 5 comma and the like, 6 other symbol, 7 beyond ASCII.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[128:] = 7
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(c) for c in ".?!"]] = 4
_CLASS[[ord(c) for c in ",;:'\"()-"]] = 5


@dataclass
class Words:
    """Per word of a batch: hashed shape and pair of shapes; per text: votes and first word."""

    features: np.ndarray  # words x 2
    first: np.ndarray  # texts + 1
    votes: np.ndarray  # texts x labellers, -1 0 1


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


def read_words(texts: Sequence[str]) -> Words:
    """Shapes and votes of whole texts, all at once."""
    parts = [t.encode() + b"\n" for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    kind = _CLASS[data]
    space = kind == 0
    before = np.concatenate([[True], space[:-1]])
    start, end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    size = end - start
    text_ends = np.cumsum([0] + [len(p) for p in parts])
    first = np.searchsorted(start, text_ends)
    upper, symbol, ends = (_sums(kind == k) for k in (1, 6, 4))
    letters = _sums((kind == 1) | (kind == 2) | (kind == 7))
    doubled = _sums(np.concatenate([[False], (data[1:] == data[:-1]) & ((kind[1:] == 4) | (kind[1:] == 6))]))
    # A word equals the one before it: same length and the same bytes at both ends and in the middle.
    same = np.zeros(len(start), bool)
    if len(start) > 1:
        mid, prior_mid = (start + size // 2)[1:], (start + size // 2)[:-1]
        same[1:] = (size[1:] == size[:-1]) & (data[start[1:]] == data[start[:-1]]) & (data[mid] == data[prior_mid])
        same[1:] &= data[end[1:] - 1] == data[end[:-1] - 1]
        same[first[:-1][first[:-1] < len(start)]] = False
    inner_upper = upper[end] - upper[np.minimum(start + 1, end)] if len(start) else size
    word_symbols = symbol[end] - symbol[start]
    bucket = np.minimum(np.maximum(size, 1).astype(np.float64), 64)
    shape = kind[start].astype(np.int64)
    for value, width in (
        (kind[end - 1], 8), (inner_upper > 0, 2), (np.minimum(word_symbols, 3), 4), (same, 2), (np.log2(bucket).astype(np.int64), 8),
    ):
        shape = shape * width + np.asarray(value, np.int64)
    mixed = (shape * 0x9E3779B1) >> 7
    pair = np.zeros(len(shape), np.int64)
    pair[1:] = (shape[1:] * 0x85EBCA6B + shape[:-1] * 0xC2B2AE35) >> 7
    features = np.stack([mixed % BINS, pair % BINS], axis=1)

    def per_text(values: np.ndarray) -> np.ndarray:
        sums = _sums(values)
        return (sums[first[1:]] - sums[first[:-1]]).astype(np.float64)

    span = lambda c: (c[text_ends[1:]] - c[text_ends[:-1]]).astype(np.float64)
    words = np.maximum(first[1:] - first[:-1], 1).astype(np.float64)
    chars = np.maximum(np.array([len(p) - 1 for p in parts], np.float64), 1)
    bars = per_text((size == 1) & (data[start] == ord("|")))
    has_words = first[1:] > first[:-1]

    def vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        return np.where(~has_words, 0, np.where(bad, -1, np.where(good, 1, 0)))

    ended = per_text(kind[end - 1] == 4) / words
    capital, marked, alike = span(upper) / np.maximum(span(letters), 1), span(symbol) / chars, per_text(same) / words
    run = per_text(same & np.concatenate([[False], same[:-1]])[: len(same)]) / words
    double, barred, low = span(doubled) / words, bars / words, per_text((kind[start] == 2) | (kind[start] == 7)) / words
    never = np.zeros(len(words), bool)
    plain = (alike < 0.1) & (marked < 0.02)  # good votes are for prose without odd marks or repeated words
    votes = np.stack(
        [
            vote(never, marked > 0.03),
            vote(never, capital > 0.3),
            vote(never, alike > 0.15),
            vote(never, run > 0.08),
            vote(never, double > 0.1),
            vote(never, barred > 0.05),
            vote((ended > 0.02) & (ended < 0.3) & plain, (ended < 0.004) & (words > 60)),
            vote((low > 0.7) & plain, low < 0.3),
        ],
        axis=1,
    )
    return Words(features, first, votes)


def pattern_codes(votes: np.ndarray) -> np.ndarray:
    """One number per vote pattern, base 3."""
    return (votes + 1) @ (3 ** np.arange(votes.shape[1]))


def estimate_accuracies(codes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """Estimated share of good documents, accuracy of each labeller's bad and good votes, and P(good) per pattern.

    Expectation-maximisation for votes that are independent given the class; an abstention says
    nothing. Labellers are held to be better than chance: each accuracy has a prior of
    9 right votes in 10 and stays between 0.8 and 0.999. The share is reported, not fed back:
    fed back, the larger class takes over the votes of the smaller one.
    """
    n = len(LABELLERS)
    votes = (codes[:, None] // 3 ** np.arange(n)) % 3 - 1
    right, good = np.full((n, 2), 0.9), np.full(len(codes), 0.5)
    for _ in range(rounds):
        old = good
        gain = np.log(right / (1 - right))
        odds = ((votes == 1) * gain[:, 1] - (votes == -1) * gain[:, 0]).sum(1)
        good = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        if np.abs(good - old).max(initial=0) < 1e-9:
            break
        for side, sure in ((0, 1 - good), (1, good)):
            cast = (votes == 2 * side - 1) * counts[:, None]
            right[:, side] = (90 + (cast * sure[:, None]).sum(0)) / (100 + cast.sum(0))
        right = np.clip(right, 0.8, 0.999)
    return float((counts * good).sum() / max(counts.sum(), 1)), right, good


@dataclass(frozen=True)
class QualityModel:
    share_good: float
    accuracies: np.ndarray  # labeller x (bad votes, good votes)
    posterior: np.ndarray  # by pattern code
    weights: np.ndarray  # by feature bin
    threshold: float

    def score(self, words: Words) -> np.ndarray:
        """Mean weight of a text's word shapes; a few words are too little to tell, so 4 neutral ones count too."""
        sums = np.concatenate([[0.0], np.cumsum(self.weights[words.features].sum(1))])
        n = words.first[1:] - words.first[:-1]
        return (sums[words.first[1:]] - sums[words.first[:-1]]) / (n + 4)


def _batches(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in lists of about ``most`` characters."""
    out, size = [], 0
    for t in texts:
        out.append(t)
        size += len(t)
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


def _tables(docs: DataFrame, make) -> dict[int, np.ndarray]:
    """Sum the small vectors that ``make(texts)`` gives as {key: vector}, over all documents."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for texts in _batches(b.column(0).to_pylist()):
                for k, v in make(texts).items():
                    total[k] = total[k] + v if k in total else v
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int32()), pa.array([total[k].astype("<f8").tobytes() for k in keys], pa.binary())], names=["k", "v"]
        )

    return summed_vectors(docs.select(text_of()).mapInArrow(per_task, "k int, v binary"), "<f8", "<f8")


def threshold_step(good: np.ndarray, bad: np.ndarray, loss: float) -> int:
    """The score bin below which documents go, from the good and bad mass of every bin.

    At most ``loss`` of the good mass lies below. Within that the bin is the last at which the bad mass
    below exceeds the good mass below by most, so a few good documents among many bad ones move nothing.
    """
    below = np.cumsum(good) - good
    most = int(np.flatnonzero(below <= loss * max(good.sum(), 1e-9)).max())
    gain = np.concatenate([[0.0], np.cumsum(bad - good)])[: most + 1]
    return most - int(gain[::-1].argmax())


def fit_quality(docs: DataFrame, loss: float = LOSS) -> QualityModel:
    """Fit labellers, scorer and threshold on all documents; three passes, none gathers texts."""
    short_batches(docs.sparkSession)
    patterns = 3 ** len(LABELLERS)

    def count(texts: list[str]) -> dict[int, np.ndarray]:
        return {0: np.bincount(pattern_codes(read_words(texts).votes), minlength=patterns).astype(float)}

    counts = _tables(docs, count).get(0, np.zeros(patterns))
    codes = np.flatnonzero(counts)
    share, table, good = estimate_accuracies(codes, counts[codes])
    posterior = np.full(patterns, 0.5)
    posterior[codes] = good

    def learn(texts: list[str]) -> dict[int, np.ndarray]:
        words = read_words(texts)
        per_word = np.repeat(posterior[pattern_codes(words.votes)], np.diff(words.first))
        # A long text counts as much as one of 200 words, so that no text decides alone.
        weight = np.repeat(np.minimum(1.0, 200 / np.maximum(np.diff(words.first), 1)), np.diff(words.first))
        return {
            k: sum(np.bincount(words.features[:, j], weight * p, BINS) for j in range(2))
            for k, p in ((1, per_word), (0, 1 - per_word))
        }

    sums = _tables(docs, learn)
    like = [(sums.get(k, np.zeros(BINS)) + 0.5) for k in (0, 1)]
    weights = np.log(like[1] / like[1].sum()) - np.log(like[0] / like[0].sum())
    model = QualityModel(share, table, posterior, weights, -SPAN)

    def spread(texts: list[str]) -> dict[int, np.ndarray]:
        words = read_words(texts)
        p = posterior[pattern_codes(words.votes)]
        at = np.clip((model.score(words) + SPAN) / STEP, 0, 2 * SPAN / STEP).astype(int)
        return {1: np.bincount(at, p, int(2 * SPAN / STEP) + 1), 0: np.bincount(at, 1 - p, int(2 * SPAN / STEP) + 1)}

    held = _tables(docs, spread)
    if not held:
        return model
    step = threshold_step(held[1], held[0], loss)
    return QualityModel(share, table, posterior, weights, step * STEP - SPAN)


def apply_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """All columns of ``docs`` and ``quality_votes`` (pattern), ``quality_posterior, quality_score, quality_keep``.

    A document stays if its score reaches the threshold. Null and empty texts and texts without
    words give no evidence and stay. Columns of these names are replaced; other columns, ids
    and repeated rows are not looked at. An empty table gives an empty result.
    """
    short_batches(docs.sparkSession)
    docs = docs.drop("quality_votes", "quality_posterior", "quality_score", "quality_keep")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few 100 KB, whatever the corpus
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            votes, scores, some = [], [], []
            for texts in _batches([t or "" for t in b.column("text").to_pylist()]):
                words = read_words(texts)
                votes.append(pattern_codes(words.votes))
                scores.append(m.score(words))
                some.append(np.diff(words.first) > 0)
            code, s, w = (np.concatenate(x) if x else np.empty(0) for x in (votes, scores, some))
            code = code.astype(np.int64)
            added = [pa.array(code, pa.int32()), pa.array(m.posterior[code]), pa.array(s.astype(float)), pa.array((s >= m.threshold) | ~w.astype(bool))]
            names = [*b.schema.names, "quality_votes", "quality_posterior", "quality_score", "quality_keep"]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=names)

    added = "quality_votes int, quality_posterior double, quality_score double, quality_keep boolean"
    return docs.mapInArrow(score, f"{schema}, {added}")


def good_documents(docs: DataFrame, model: QualityModel | None = None) -> DataFrame:
    """The documents that the classifier keeps, with their own columns."""
    model = model or fit_quality(docs)
    return apply_quality(docs, model).filter("quality_keep").select(*docs.columns)
