"""Operator 2: a quality classifier without labels of its own.

Overlapping heuristics each vote for good, for bad, or abstain. How far each can be trusted is estimated by
expectation-maximisation of a model in which votes are independent given the unknown class. It runs on the
counts of the vote patterns of all documents, of which there are at most three to the number of heuristics,
so every document takes part and the driver holds a bounded table. The posterior of each pattern is the label
with which a linear scorer is trained, on a bounded sample of about `most_rows` documents with at most
`longest` characters: its features are the relative frequencies of a document's tokens and token shapes,
hashed. The scorer then judges every document.

Cases: null and wordless texts have the posterior of their votes (all heuristics but `size` abstain), score 0
and are not kept; equal rows are judged one by one; if all documents vote alike they have one posterior and
the scorer follows it; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm import texts as T

HEURISTICS = ("size", "capitals", "symbols", "tails", "bare_marks", "repeats", "pairs", "top_word", "sentences", "word_length")
FEATURES = 1 << 16
SCHEMA = "doc_id long, votes string, posterior double, score double, keep boolean"

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_CAPITAL = np.array([65 <= i <= 90 for i in range(256)])
_LETTER = np.array([i >= 128 or 65 <= i <= 90 or 97 <= i <= 122 for i in range(256)])
_PLAIN = _LETTER | np.array([48 <= i <= 57 for i in range(256)])
_STOP = np.isin(np.arange(256), list(b".!?"))
_SHAPE = bytes(
    65 if 65 <= i <= 90 else 97 if i >= 128 or 97 <= i <= 122 else 57 if 48 <= i <= 57 else i for i in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.S)


def _vote(value: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, -1, np.where(good, 1, 0)).astype(np.int8)


class Tokens:
    """The tokens (between white space) of a slice of texts."""

    def __init__(self, some: list[bytes | None]):
        whole, self.texts = T.joined(some)
        self.data = np.frombuffer(whole, np.uint8)
        self.start, self.end = T.runs(~_SPACE[self.data])
        self.words, self.number = T.distinct(self.data, self.start, self.end)
        self.first = np.searchsorted(self.start, self.texts)
        self.n = np.diff(self.first)
        self.text = np.repeat(np.arange(len(some)), self.n)
        opens = np.zeros(len(self.start), bool)
        opens[self.first[:-1][self.n > 0]] = True
        self.again = np.zeros(len(self.start), bool)
        self.again[1:] = (self.number[1:] == self.number[:-1]) & ~opens[1:]

    def per_text(self, of_byte: np.ndarray) -> np.ndarray:
        """How many bytes of each text are in the class."""
        sums = np.concatenate(([0], np.cumsum(of_byte[self.data])))
        return sums[self.texts[1:]] - sums[self.texts[:-1]]

    def mean(self, of_token: np.ndarray) -> np.ndarray:
        return np.bincount(self.text, of_token, len(self.n)) / np.maximum(self.n, 1)


def votes(tokens: Tokens) -> np.ndarray:
    """One row for each text, one column for each heuristic: 1 good, -1 bad, 0 abstains."""
    n, filled = tokens.n, np.maximum(tokens.n, 1)
    data, last = tokens.data, np.maximum(tokens.end - 1, 0)
    letters, signs = tokens.per_text(_LETTER), tokens.per_text(~_PLAIN & ~_SPACE)
    capitals = tokens.per_text(_CAPITAL) / np.maximum(letters, 1)
    symbols = signs / np.maximum(letters + signs, 1)
    long_tail = ~_PLAIN[data[last]] & ~_PLAIN[data[np.maximum(last - 1, 0)]] & (tokens.end - tokens.start > 1)
    inner = np.concatenate(([0], np.cumsum(_PLAIN[data])))
    bare = inner[tokens.end] == inner[tokens.start]
    tails, marks, repeats = tokens.mean(long_tail), tokens.mean(bare), tokens.mean(tokens.again)
    pairs = np.ones(len(n))
    if len(tokens.number) > 1:
        joint = np.flatnonzero(tokens.text[1:] == tokens.text[:-1])
        width = np.int64(len(tokens.words))
        both = np.unique(tokens.number[joint].astype(np.int64) * width + tokens.number[joint + 1], return_inverse=True)[1]
        distinct = np.unique(tokens.text[joint] * np.int64(max(1, len(both))) + both)
        pairs = np.bincount(distinct // max(1, len(both)), minlength=len(n)) / np.maximum(n - 1, 1)
    top = np.zeros(len(n))
    if len(tokens.number):
        pair, count = np.unique(tokens.text * np.int64(len(tokens.words)) + tokens.number, return_counts=True)
        np.maximum.at(top, pair // len(tokens.words), count)
    top /= filled
    stops = tokens.per_text(_STOP) / filled
    size = tokens.mean(tokens.end - tokens.start)
    some, many = n >= 3, n >= 20
    found = [
        _vote(n, n >= 8, n < 2),
        _vote(capitals, some & (capitals < 0.3), some & (capitals > 0.6)),
        _vote(symbols, some & (symbols < 0.08), some & (symbols > 0.15)),
        _vote(tails, some & (tails < 0.05), some & (tails > 0.2)),
        _vote(marks, some & (marks < 0.05), some & (marks > 0.2)),
        _vote(repeats, many & (repeats < 0.05), many & (repeats > 0.25)),
        _vote(pairs, many & (pairs > 0.6), many & (pairs < 0.3)),
        _vote(top, many & (top < 0.2), many & (top > 0.4)),
        _vote(stops, many & (stops > 0.02) & (stops < 0.4), many & ((stops < 0.005) | (stops > 0.8))),
        _vote(size, some & (size > 2.5) & (size < 12), some & ((size < 1.5) | (size > 20))),
    ]
    return np.stack(found, axis=1)


def pattern(row: np.ndarray) -> str:
    return "".join("-0+"[v + 1] for v in row.tolist())


class LabelModel:
    """Probabilities of each heuristic's vote given the class, and of the class."""

    def __init__(self, counts: dict[str, int], rounds: int = 200, smooth: float = 1.0):
        self.counts = counts
        patterns = sorted(counts)
        if not patterns:
            self.posterior, self.votes, self.prior = {}, np.full((2, len(HEURISTICS), 3), 0.5), np.array([0.5, 0.5])
            return
        v = np.array([["-0+".index(c) for c in p] for p in patterns]).reshape(len(patterns), -1)
        weight = np.array([counts[p] for p in patterns], float)
        # To begin with, a document is bad if any heuristic says so: each kind of junk is seen by a few of them.
        good = np.where((v == 0).any(axis=1), 0.1, 0.9)
        for _ in range(rounds):
            table = np.full((2, v.shape[1], 3), smooth)
            for side, share in enumerate((1 - good, good)):
                for h in range(table.shape[1]):
                    table[side, h] += np.bincount(v[:, h], weight * share, 3)
            table[:, :, 1] = 0  # an abstention tells nothing
            table /= table.sum(axis=2, keepdims=True)
            table[:, :, 1] = 1
            prior = (np.array([(weight * (1 - good)).sum(), (weight * good).sum()]) + smooth) / (weight.sum() + 2 * smooth)
            logs = np.stack([np.log(prior[s]) + sum((np.log(table[s, h][v[:, h]]) for h in range(table.shape[1])), np.zeros(len(v))) for s in (0, 1)])
            new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
            if np.abs(new - good).max() < 1e-9:
                good = new
                break
            good = new
        self.posterior = dict(zip(patterns, good.tolist()))
        self.votes, self.prior = table, prior

    def accuracies(self) -> dict[str, float]:
        """For each heuristic, how often its vote is right when it votes."""
        bad, good = self.votes
        right = self.prior[0] * bad[:, 0] + self.prior[1] * good[:, 2]
        given = self.prior[0] * (bad[:, 0] + bad[:, 2]) + self.prior[1] * (good[:, 0] + good[:, 2])
        return dict(zip(HEURISTICS, (right / given).round(4).tolist()))


class Scorer:
    """A linear model of the relative frequencies of hashed tokens and token shapes, and of repetition."""

    def __init__(self):
        self.weights = np.zeros(2 * FEATURES + 1)
        self.bias = 0.0

    @staticmethod
    def hashed(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        word = [zlib.crc32(w) % FEATURES for w in tokens.words]
        shape = [zlib.crc32(_RUN.sub(rb"\1", w.translate(_SHAPE))) % FEATURES + FEATURES for w in tokens.words]
        return np.array(word, np.int64), np.array(shape, np.int64)

    def raw(self, tokens: Tokens, hashed: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        word, shape = hashed or self.hashed(tokens)
        own = self.weights[word] + self.weights[shape]
        per_token = own[tokens.number] + self.weights[-1] * tokens.again if len(own) else np.zeros(0)
        return tokens.mean(per_token) + self.bias

    def scores(self, tokens: Tokens) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(self.raw(tokens), -30, 30)))
        return np.where(tokens.n > 0, p, 0.0)

    def fit(self, tokens: Tokens, labels: np.ndarray, rounds: int = 150, rate: float = 1.0, l2: float = 1e-4) -> None:
        word, shape = self.hashed(tokens)
        squares, bias_square = np.full_like(self.weights, 1e-8), 1e-8
        for _ in range(rounds):
            error = labels - 1 / (1 + np.exp(-np.clip(self.raw(tokens, (word, shape)), -30, 30)))
            share = (error / np.maximum(tokens.n, 1))[tokens.text]
            by_word = np.bincount(tokens.number, share, len(tokens.words))
            g = np.bincount(word, by_word, len(self.weights)) + np.bincount(shape, by_word, len(self.weights))
            g[-1] = (share * tokens.again).sum()
            g -= l2 * self.weights
            squares += g * g
            self.weights += rate * g / np.sqrt(squares)
            bias_square += error.sum() ** 2
            self.bias += rate * error.sum() / np.sqrt(bias_square)


def learn(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 3_000, longest: int = 20_000
) -> tuple[LabelModel, Scorer]:
    """Label model from the votes on all documents, scorer from a sample."""
    rows = T.pick(df, id_col, text_col)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, some in T.slices(batch):
                found, n = np.unique([pattern(v) for v in votes(Tokens(some))], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.tolist(), pa.string()), pa.array(n, pa.int64())], ["p", "n"])

    counts = rows.mapInArrow(patterns, "p string, n long").groupBy("p").agg(F.sum("n").alias("n"))
    labels = LabelModel({r.p: r.n for r in counts.collect()})
    sample = T.sample_rows(rows, most_rows).where(F.length("text") <= longest).toPandas().sort_values(["doc_id", "text"])
    tokens, scorer = Tokens([t.encode() for t in sample.text]), Scorer()
    if len(sample):
        scorer.fit(tokens, np.array([labels.posterior[pattern(v)] for v in votes(tokens)]))
    return labels, scorer


def classify(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5,
    models: tuple[LabelModel, Scorer] | None = None,
) -> DataFrame:
    """(doc_id, votes, posterior, score, keep) of every row; fits the models on the table if none are given."""
    shared = df.sparkSession.sparkContext.broadcast(models or learn(df, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, scorer = shared.value
        for batch in batches:
            for first, some in T.slices(batch):
                tokens = Tokens(some)
                found = [pattern(v) for v in votes(tokens)]
                scores = scorer.scores(tokens)
                arrays = [
                    batch.column(0).slice(first, len(some)),
                    pa.array(found, pa.string()),
                    pa.array([labels.posterior.get(p) for p in found], pa.float64()),
                    pa.array(scores, pa.float64()),
                    pa.array((scores >= least) & (tokens.n > 0), pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "votes", "posterior", "score", "keep"])

    return T.pick(df, id_col, text_col).mapInArrow(run, SCHEMA)
