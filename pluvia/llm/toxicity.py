"""Operator 10: toxic spans by a linear-chain conditional random field, and document scores from them.

Chains are sentences (at most `CHAIN` words; a longer one goes on as the next chain). A word's features are
the word, its first 4, 5 and 6 bytes, the word before and the word after; two states, clean and toxic, are linked by transition weights.
With two states the forward and backward passes are recursions of one ratio each, which run over all chains
of a slice together. Token labels for training come from the document labels: in a document labelled toxic
those words are toxic that, or whose first bytes, stand far more often in toxic documents than in others. Marginals become a
document score by a logistic model of the largest marginal and of their sum; neighbouring words with a
marginal of one half or more are offending spans.

The fit uses a bounded sample: about `most_rows` rows of each label with at most `longest` characters.
Rows whose CRC-32 of the id leaves `held_rest` modulo `held_of` are never learned from.

Cases: null and wordless texts have no marginals and score as a text whose words are all clean; without
labels of both kinds every score is 0; a document with several label rows counts as toxic if any says so;
null labels are left out; equal rows are scored one by one; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvia.llm import texts as T
from pluvia.llm.language import held_out
from pluvia.llm.simhash import fingerprint

CHAIN = 256
_WORD = np.array([i >= 128 or 48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122 for i in range(256)])
_STOP = np.array([i in b".!?\n" for i in range(256)])
SCHEMA = "doc_id long, score double, spans array<struct<start: long, end: long, p: double>>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))


class Tokens:
    """Words of a slice of texts: where they are, their chains and their texts."""

    def __init__(self, some: list[bytes | None]):
        whole, starts = T.joined([(x or b"").translate(T.LOWER) for x in some])
        self.data = np.frombuffer(whole, np.uint8)
        self.start, self.end = T.runs(_WORD[self.data])
        self.words, self.number = T.distinct(self.data, self.start, self.end)
        self.texts = starts
        #: First word of each text.
        self.first = np.searchsorted(self.start, starts)
        n = len(self.start)
        stops = np.cumsum(_STOP[self.data], dtype=np.int32)[self.start] if n else np.zeros(0, np.int32)
        begins = np.concatenate(([True], stops[1:] != stops[:-1]))[:n]
        at = np.flatnonzero(begins)
        sizes = np.diff(np.concatenate((at, [n])))
        if (sizes > CHAIN).any():
            more = np.repeat(-(-sizes // CHAIN), 1)
            part = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
            at = np.repeat(at, more) + part * CHAIN
            sizes = np.diff(np.concatenate((at, [n])))
        self.chain_start, self.chain_size = at, sizes
        self.opens = np.zeros(n, bool)
        self.opens[at] = True


#: A word's own features: the whole word, and its first bytes if it has that many.
PREFIXES = (None, 4, 5, 6)


def features(words: list[bytes], prefix: int | None) -> list[bytes | None]:
    return words if prefix is None else [w[:prefix] if len(w) >= prefix else None for w in words]


class Field:
    """Weights of the toxic state by feature (0: unknown), and of the transitions."""

    def __init__(self, vocabulary: list[list[bytes]]):
        self.numbers = [{f: i + 1 for i, f in enumerate(v)} for v in vocabulary]
        self.own = [np.zeros(len(v) + 1) for v in vocabulary]
        self.beside = np.zeros((2, len(vocabulary[0]) + 1))
        self.bias = -3.0
        self.moves = np.zeros((2, 2))
        self.calibration: np.ndarray | None = None

    def coded(self, tokens: Tokens) -> list[np.ndarray]:
        """The features of each distinct word, by kind."""
        return [
            np.array([get(f, 0) for f in features(tokens.words, prefix)], np.int64)
            for prefix, get in zip(PREFIXES, (n.get for n in self.numbers))
        ]

    def unary(self, tokens: Tokens, coded: list[np.ndarray]) -> np.ndarray:
        own = sum(w[c] for w, c in zip(self.own, coded))
        u = own[tokens.number] + self.bias
        inner = np.flatnonzero(~tokens.opens)
        before, after = self.beside[0][coded[0]], self.beside[1][coded[0]]
        u[inner] += before[tokens.number[inner - 1]]
        u[inner - 1] += after[tokens.number[inner]]
        return np.exp(np.clip(u, -30, 30))

    def passes(self, tokens: Tokens, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward ratios, toxic to clean, of each word; e: exponentials of the unary scores."""
        m = np.exp(self.moves)
        order = np.argsort(-tokens.chain_size, kind="stable")
        start, size = tokens.chain_start[order], tokens.chain_size[order]
        r, b = e.copy(), np.ones(len(e))
        longest = int(size.max(initial=0))
        live = np.searchsorted(-size, -np.arange(longest + 1), "left")  # chains of more words than the step
        for step in range(1, longest):
            at = start[: live[step]] + step
            prior = r[at - 1]
            r[at] = e[at] * (m[0, 1] + prior * m[1, 1]) / (m[0, 0] + prior * m[1, 0])
        for step in range(longest - 2, -1, -1):
            at = start[: live[step + 1]] + step
            ahead = e[at + 1] * b[at + 1]
            b[at] = (m[1, 0] + m[1, 1] * ahead) / (m[0, 0] + m[0, 1] * ahead)
        return r, b

    def marginals(self, tokens: Tokens) -> np.ndarray:
        e = self.unary(tokens, self.coded(tokens))
        r, b = self.passes(tokens, e)
        odds = r * b
        return odds / (1 + odds)

    def fit(self, tokens: Tokens, labels: np.ndarray, rounds: int = 40, rate: float = 0.5, l2: float = 0.02) -> None:
        """Maximise the conditional likelihood of the token labels (per-weight step sizes, L2 penalty)."""
        coded, number, n = self.coded(tokens), tokens.number, len(tokens.words)
        y, state = labels.astype(float), labels.astype(np.int64)
        inner = np.flatnonzero(~tokens.opens)
        seen = np.zeros((2, 2))
        np.add.at(seen, (state[inner - 1], state[inner]), 1)
        weights = [*self.own, *self.beside, np.array([self.bias]), self.moves]
        squares = [np.full_like(w, 1e-6) for w in weights]
        for _ in range(rounds):
            e = self.unary(tokens, coded)
            r, b = self.passes(tokens, e)
            odds = r * b
            error = y - odds / (1 + odds)
            by_word = np.bincount(number, error, n)
            steps = [np.bincount(c, by_word, len(w)) for c, w in zip(coded, self.own)]
            for at, of in ((inner, inner - 1), (inner - 1, inner)):
                steps.append(np.bincount(coded[0], np.bincount(number[of], error[at], n), self.beside.shape[1]))
            m = np.exp(self.moves)
            prior, ahead = r[inner - 1], e[inner] * b[inner]
            pair = np.stack([m[0, 0] + 0 * prior, m[0, 1] * ahead, m[1, 0] * prior, m[1, 1] * prior * ahead])
            pair = (pair / pair.sum(axis=0)).sum(axis=1).reshape(2, 2)
            steps += [np.array([error.sum()]), seen - pair]
            for w, g, q in zip(weights, steps, squares):
                g = g - l2 * w
                q += g * g
                w += rate * g / np.sqrt(q)
            for w in weights[:-2]:
                w[0] = 0.0
            self.bias = float(weights[-2][0])
        self._forget()

    def _forget(self, least: float = 0.25) -> None:
        """Drop the features that say next to nothing."""
        for kind, numbers in enumerate(self.numbers):
            size = np.abs(self.own[kind])
            if kind == 0:
                size = np.maximum(size, np.abs(self.beside).max(axis=0))
            told = np.flatnonzero(size >= least)
            names = {i: f for f, i in numbers.items()}
            self.numbers[kind] = {names[i]: k + 1 for k, i in enumerate(told.tolist())}
            self.own[kind] = np.concatenate(([0.0], self.own[kind][told]))
            if kind == 0:
                self.beside = np.concatenate((np.zeros((2, 1)), self.beside[:, told]), axis=1)

    def signals(self, tokens: Tokens, p: np.ndarray) -> np.ndarray:
        """For each text: 1, the logit of the largest marginal, and the logarithm of their sum."""
        n = len(tokens.texts) - 1
        text = np.repeat(np.arange(n), np.diff(tokens.first))
        most = np.full(n, 1e-5)
        np.maximum.at(most, text, p)
        most = np.clip(most, 1e-5, 1 - 1e-5)
        total = np.bincount(text, np.where(p >= 0.05, p, 0.0), n)
        return np.stack([np.ones(n), np.log(most / (1 - most)), np.log1p(total)], axis=1)

    def calibrate(self, signals: np.ndarray, labels: np.ndarray, rounds: int = 50, l2: float = 0.1) -> None:
        """Logistic regression by Newton steps."""
        w = np.zeros(signals.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(signals @ w, -30, 30)))
            g = signals.T @ (labels - p) - l2 * w
            h = (signals * (p * (1 - p))[:, None]).T @ signals + l2 * np.eye(len(w))
            step = np.linalg.solve(h, g)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        self.calibration = w

    def scores(self, some: list[bytes | None]) -> tuple[np.ndarray, Tokens, np.ndarray]:
        tokens = Tokens(some)
        p = self.marginals(tokens)
        if self.calibration is None:
            return np.zeros(len(some)), tokens, p
        return 1 / (1 + np.exp(-np.clip(self.signals(tokens, p) @ self.calibration, -30, 30))), tokens, p


def token_labels(tokens: Tokens, toxic: np.ndarray, least_share: float = 0.02, least_odds: float = 2.5) -> np.ndarray:
    """Which words are toxic, told from which of the texts are.

    A toxic feature stands in at least `least_share` of the toxic texts: rarer ones may be there by chance.
    """
    text = np.repeat(np.arange(len(toxic)), np.diff(tokens.first))
    n1, marked = int(toxic.sum()), np.zeros(len(tokens.words), bool)
    for prefix in PREFIXES:
        names = features(tokens.words, prefix)
        seen: dict[bytes | None, int] = {}
        number = np.array([seen.setdefault(f, len(seen)) for f in names], np.int64)
        n = max(1, len(seen))
        pairs = np.unique(text * np.int64(n) + number[tokens.number])
        feature, of = pairs % n, pairs // n
        bad = np.bincount(feature[toxic[of]], minlength=n)
        good = np.bincount(feature[~toxic[of]], minlength=n)
        odds = np.log((bad + 0.5) / (n1 + 1)) - np.log((good + 0.5) / (len(toxic) - n1 + 1))
        strong = (bad >= max(3, least_share * n1)) & (odds >= least_odds)
        if None in seen:
            strong[seen[None]] = False
        marked |= strong[number]
    return marked[tokens.number] & toxic[text]


def _without_copies(texts: list[bytes], near: int = 10) -> list[int]:
    """One of each group of near copies in the sample, else the chance words of a copied text look toxic."""
    prints = np.array([fingerprint(t) for t in texts], np.int64).view(np.uint64)
    kept: list[int] = []
    for i, own in enumerate(prints):
        if not kept or (np.bitwise_count(prints[kept] ^ own) > near).all():
            kept.append(i)
    return kept


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    most_rows: int = 1_500, longest: int = 20_000, held_of: int = 3, held_rest: int = 1,
) -> Field:
    """Fit the field on a sample of the labelled rows that are not held out."""
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(held_of, held_rest))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    per_label = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    shares = {label: int(1e6 * min(1.0, most_rows / n)) for label, n in per_label.items()}
    share = F.lit(0)
    for label, n in shares.items():
        share = F.when(F.col("toxic") == label, n).otherwise(share)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    chosen = known.where(drawn < share)
    # The ids are about `most_rows` for each label, whatever the size of the tables; texts don't move for them.
    rows = T.pick(docs, id_col, text_col).where((drawn < max(shares.values(), default=0)) & (F.length("text") <= longest))
    several = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    sample = rows.join(F.broadcast(chosen), "doc_id").withColumn("nth", several).where("nth <= 2").drop("nth").toPandas()
    sample = sample.sort_values(["doc_id", "text"])
    texts = [t.encode() for t in sample.text]
    single = _without_copies(texts)
    sample, texts = sample.iloc[single], [texts[i] for i in single]
    toxic = (sample.toxic > 0).to_numpy()
    # Weights from most of the sample, the document model from the rest.
    part = sample.doc_id.map(lambda i: zlib.crc32(b"%d" % i) // 7 % 10 < 7).to_numpy(bool)
    if min(len(set(toxic[part].tolist())), len(set(toxic[~part].tolist()))) < 2:
        part = np.ones(len(texts), bool)
    if len(set(toxic.tolist())) < 2:
        return Field([[]] * len(PREFIXES))
    tokens = Tokens([t for t, p in zip(texts, part) if p])
    marked = token_labels(tokens, toxic[part])
    times = np.bincount(tokens.number, minlength=len(tokens.words))
    vocabulary = []
    for prefix in PREFIXES:
        counts: Counter = Counter()
        for name, n in zip(features(tokens.words, prefix), times.tolist()):
            if name is not None:
                counts[name] += n
        vocabulary.append([f for f, n in counts.items() if n >= 3])
    field = Field(vocabulary)
    field.fit(tokens, marked)
    rest = part if part.all() else ~part
    tokens = Tokens([t for t, r in zip(texts, rest) if r])
    field.calibrate(field.signals(tokens, field.marginals(tokens)), toxic[rest].astype(float))
    return field


def detect(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, spans) of every row; spans are code points, the end exclusive."""
    shared = df.sparkSession.sparkContext.broadcast(field)

    def spans(tokens: Tokens, p: np.ndarray, some: list[bytes | None]) -> list[list[dict]]:
        hot = p >= 0.5
        out: list[list[dict]] = [[] for _ in some]
        if not hot.any():
            return out
        a, b = T.runs(np.concatenate((hot, [False])))
        doc = np.searchsorted(tokens.first, a, "right") - 1
        for d, x, y in zip(doc.tolist(), a.tolist(), b.tolist()):
            while x < y:  # a run of words ends with its text
                stop = min(y, int(tokens.first[d + 1]))
                base = int(tokens.texts[d])
                start, end = int(tokens.start[x]) - base, int(tokens.end[stop - 1]) - base
                text = some[d]
                if not text.isascii():
                    start, end = len(text[:start].decode()), len(text[:end].decode())
                out[d].append({"start": start, "end": end, "p": float(p[x:stop].max())})
                x, d = stop, d + 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, some in T.slices(batch):
                scores, tokens, p = shared.value.scores(some)
                arrays = [batch.column(0).slice(first, len(some)), pa.array(scores), pa.array(spans(tokens, p, some), SPANS)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "spans"])

    return T.pick(df, id_col, text_col).mapInArrow(run, SCHEMA)


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    threshold: float = 0.7, held_of: int = 3, held_rest: int = 1, field: Field | None = None,
) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every row; fits a field if none is given."""
    field = field or learn(docs, labels, id_col, text_col, label_col, held_of=held_of, held_rest=held_rest)
    found = detect(docs, field, id_col, text_col)
    return found.select(
        "doc_id",
        held_out(held_of, held_rest).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "spans",
    )
