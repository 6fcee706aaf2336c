"""Operator 3: secrets by patterns and by the grammar of their format.

The patterns label credentials, in every document. From a bounded number of the distinct ones a prefix tree of
character classes is built for each kind, and its states are merged while their outgoing frequencies are statistically
compatible (Hoeffding bound), which gives a small probabilistic automaton. Every other token of every text
is scored by its log-likelihood under each automaton less that under a model of ordinary tokens; what
scores beyond the prior log-odds (ordinary tokens to labelled credentials of the kind) and a margin is a
secret too, whatever stands before it. Tokens outside the patterns are unlabelled, not known to be ordinary:
those beyond the threshold are left out and the model of ordinary tokens is fitted again.
Scoring moves all tokens of a slice through the automaton together.

Cases: null text counts as empty and has no spans; equal rows are scanned one by one; without labelled
credentials only the patterns work; an empty table gives no rows; other columns are not read (`redact`
keeps them). Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm import texts as T
from pluvia.operators.storage import materialise

#: Fixed patterns, for UTF-8 bytes: kind, pattern, group that must have so many characters, how many.
KINDS = ("assign", "access", "hex")
PATTERNS = [
    (
        "assign",
        re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I),
        2,
        8,
    ),
    ("access", re.compile(rb"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(rb"[0-9a-f]{32,}"), 0, 32),
]
SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
    "found array<struct<kind: string, start: long, end: long, base: boolean>>"
)
FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def base_spans(text: bytes) -> list[tuple[int, int, int, int]]:
    """(start, end, kind number, start of the value) in bytes, by start, then kind."""
    spans = []
    for number, (_, pattern, group, least) in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                spans.append((m.start(), m.end(), number, m.start(group)))
    return sorted(spans, key=lambda s: (s[0], s[2]))


# Character classes: the letters of hexadecimal numbers apart from the others.
def _classes() -> np.ndarray:
    kinds = np.full(256, 5, np.uint8)
    kinds[ord("0") : ord("9") + 1] = 0
    kinds[ord("a") : ord("z") + 1] = 2
    kinds[ord("a") : ord("f") + 1] = 1
    kinds[ord("A") : ord("Z") + 1] = 3
    for x in b"+/_.=-":
        kinds[x] = 4
    return kinds


CLASSES = _classes()
N_CLASSES = 6


class Automaton:
    """A probabilistic deterministic automaton over character classes, merged from a prefix tree."""

    def __init__(self, values: list[bytes], alpha: float = 0.05):
        self.next: list[dict[int, int]] = [{}]
        self.count: list[dict[int, int]] = [{}]
        self.ends: list[int] = [0]
        for value in values:
            state = 0
            for symbol in CLASSES[np.frombuffer(value, np.uint8)].tolist():
                self.count[state][symbol] = self.count[state].get(symbol, 0) + 1
                if symbol not in self.next[state]:
                    self.next[state][symbol] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                state = self.next[state][symbol]
            self.ends[state] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self.characters = Counter(b for v in values for b in v)

    def _total(self, state: int) -> int:
        return self.ends[state] + sum(self.count[state].values())

    def _alike(self, a: int, b: int) -> bool:
        """Whether all frequencies of the two states, and of those that follow both, are within the bound."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            m, n = self._total(a), self._total(b)
            if not m or not n:
                continue
            far = self.bound * (1 / math.sqrt(m) + 1 / math.sqrt(n))
            if abs(self.ends[a] / m - self.ends[b] / n) > far:
                return False
            for symbol in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a].get(symbol, 0) / m - self.count[b].get(symbol, 0) / n) > far:
                    return False
                if symbol in self.next[a] and symbol in self.next[b]:
                    stack.append((self.next[a][symbol], self.next[b][symbol]))
        return True

    def _fold(self, into: int, state: int) -> None:
        stack = [(into, state)]
        while stack:
            into, state = stack.pop()
            self.ends[into] += self.ends[state]
            for symbol, n in self.count[state].items():
                self.count[into][symbol] = self.count[into].get(symbol, 0) + n
                child = self.next[state][symbol]
                if symbol in self.next[into]:
                    stack.append((self.next[into][symbol], child))
                else:
                    self.next[into][symbol] = child

    def _merge(self) -> None:
        kept = [0]
        while True:
            inside = set(kept)
            edge = [
                (-self.count[s][symbol], s, symbol, child)
                for s in kept
                for symbol, child in self.next[s].items()
                if child not in inside
            ]
            if not edge:
                break
            _, parent, symbol, child = min(edge)
            for state in kept:
                if self._alike(state, child):
                    self.next[parent][symbol] = state
                    self._fold(state, child)
                    break
            else:
                kept.append(child)
        number = {s: i for i, s in enumerate(kept)}
        self.next = [{c: number[t] for c, t in self.next[s].items()} for s in kept]
        self.count = [self.count[s] for s in kept]
        self.ends = [self.ends[s] for s in kept]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Next state and log-probability by state and byte, log-probability of the end by state.

        The last state takes what the automaton doesn't know, at a small probability.
        """
        n = len(self.next)
        character = log_characters(self.characters)
        following = np.full((n + 1, 256), n, np.int32)
        logs = np.full((n + 1, 256), math.log(1e-4))
        ends = np.full(n + 1, math.log(1e-4))
        for state in range(n):
            total = self._total(state) + (N_CLASSES + 1) * 0.01
            ends[state] = math.log((self.ends[state] + 0.01) / total)
            for symbol, to in self.next[state].items():
                own = symbol == CLASSES
                following[state, own] = to
                logs[state, own] = math.log((self.count[state][symbol] + 0.01) / total) + character[own]
        return following, logs, ends


def log_characters(characters: Counter) -> np.ndarray:
    """The log-probability of a byte among those of its class, smoothed."""
    seen = np.full(256, 0.1)
    for byte, n in characters.items():
        seen[byte] += n
    return np.log(seen / np.bincount(CLASSES, seen, N_CLASSES)[CLASSES])


class Ordinary:
    """Ordinary tokens: a chain of character classes, and the characters of each class."""

    def __init__(self, tokens: list[bytes]):
        chain = np.full((N_CLASSES + 1, N_CLASSES + 1), 0.5)  # the last row and column: begin and end
        for token in tokens:
            path = [N_CLASSES, *CLASSES[np.frombuffer(token, np.uint8)].tolist(), N_CLASSES]
            np.add.at(chain, (path[:-1], path[1:]), 1)
        chain = np.log(chain / chain.sum(axis=1, keepdims=True))
        character = log_characters(Counter(b for t in tokens for b in t))
        self.first = chain[N_CLASSES][CLASSES] + character
        self.after = chain[:, CLASSES] + character
        self.end = chain[:N_CLASSES, N_CLASSES][CLASSES]


class Scorer:
    """Automata of all kinds with their thresholds; scores tokens of a buffer together."""

    def __init__(self, labelled: dict[int, list[bytes]], ordinary: list[bytes], margin: float = 6.0, least: int = 16):
        self.least = least
        self.tables = {k: Automaton(v).tables() for k, v in labelled.items() if len(v) >= 20}
        # The odds against a token's being of the kind, from the counts of both, and the margin on them.
        self.threshold = {
            k: max(0.0, math.log(max(1, len(ordinary)) / len(labelled[k]))) + margin for k in self.tables
        }
        self.ordinary = self._fitted(ordinary)
        for _ in range(5):  # what passes as a secret is no example of an ordinary token
            data, start, end = _laid_out(ordinary)
            beyond = np.zeros(len(ordinary), bool)
            for kind, scores in self.scores(data, start, end).items():
                beyond |= scores >= self.threshold[kind]
            if not beyond.any():
                break
            ordinary = [t for t, out in zip(ordinary, beyond.tolist()) if not out]
            self.ordinary = self._fitted(ordinary)

    @staticmethod
    def _fitted(ordinary: list[bytes]) -> Ordinary:
        return Ordinary(ordinary + [t.upper() for t in ordinary])  # a word in capitals is as ordinary

    def candidates(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of at least `least` characters; dots, dashes and equals signs at their ends are left out."""
        start, end = T.runs(CLASSES[data] != 5)
        long = end - start >= self.least
        start, end = start[long], end[long]
        edge = np.isin(data, list(b".-="))
        while len(start):
            last, first = edge[end - 1] & (end > start), edge[np.minimum(start, len(data) - 1)] & (end > start)
            if not (last.any() or first.any()):
                break
            end, start = end - last, start + (first & (end - last > start))
        long = end - start >= self.least
        return start[long], end[long]

    def scores(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[int, np.ndarray]:
        """For each kind, log-likelihood under its automaton less that of an ordinary token."""
        sizes = end - start
        order = np.argsort(-sizes, kind="stable")
        start, sizes = start[order], sizes[order]
        state = {k: np.zeros(len(start), np.int32) for k in self.tables}
        score = {k: np.zeros(len(start)) for k in self.tables}
        plain = np.zeros(len(start))
        for step in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(-sizes, -step, "left"))
            byte = data[start[:live] + step]
            before = data[start[:live] + step - 1]
            plain[:live] += self.ordinary.first[byte] if step == 0 else self.ordinary.after[CLASSES[before], byte]
            for k, (following, logs, _) in self.tables.items():
                score[k][:live] += logs[state[k][:live], byte]
                state[k][:live] = following[state[k][:live], byte]
        plain += self.ordinary.end[data[start + sizes - 1]]
        out = {}
        for k, (_, _, ends) in self.tables.items():
            out[k] = np.empty(len(start))
            out[k][order] = score[k] + ends[state[k]] - plain
        return out

    def secrets(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, kind) of the tokens beyond a threshold, the kind being that of the best score."""
        start, end = self.candidates(data)
        best, kind = np.full(len(start), -math.inf), np.zeros(len(start), np.int64)
        for k, scores in self.scores(data, start, end).items():
            better = (scores >= self.threshold[k]) & (scores > best)
            best[better], kind[better] = scores[better], k
        hit = best > -math.inf
        return list(zip(start[hit].tolist(), end[hit].tolist(), kind[hit].tolist()))


def _laid_out(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in tokens], np.int64)
    end = np.cumsum(sizes + 1) - 1
    return np.frombuffer(b" ".join(tokens) + b" ", np.uint8), end - sizes, end


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_values: int = 2_000) -> Scorer:
    """Fit the automata on the tokens of all documents.

    At most `most_values` distinct credentials of each kind and four times as many ordinary tokens, those with
    the smallest hash, go to the driver, which makes the automata.
    """
    rows = T.pick(df, id_col, text_col).select("text")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = Scorer({}, [])
        for batch in batches:
            for _, some in T.slices(batch):
                seen: set[tuple[int, bytes]] = set()
                for text in filter(None, some):
                    spans = base_spans(text)
                    seen.update((k, text[value:b]) for _, b, k, value in spans)
                    data = np.frombuffer(text + b"\n", np.uint8)
                    start, end = plain.candidates(data)
                    for a, b in zip(start.tolist(), end.tolist()):
                        if not any(x < b and a < y for x, y, _, _ in spans):
                            seen.add((len(KINDS), text[a:b]))
                kinds, values = zip(*seen) if seen else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(values, pa.binary())], ["kind", "value"])

    found = materialise(rows.mapInArrow(tokens, "kind int, value binary").distinct(), "labelled")
    labelled: dict[int, list[bytes]] = {}
    for kind in range(len(KINDS) + 1):
        most = most_values * (4 if kind == len(KINDS) else 1)
        few = found.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(most)
        labelled[kind] = [bytes(r.value) for r in few.collect()]
    ordinary = labelled.pop(len(KINDS))
    return Scorer(labelled, ordinary)


def spans_of(text: bytes, scorer: Scorer) -> list[tuple[int, int, int, bool]]:
    """(start, end, kind, whether by pattern) in code points, by start, then kind."""
    base = base_spans(text)
    spans = [(a, b, k, True) for a, b, k, _ in base]
    if scorer.tables:
        for a, b, k in scorer.secrets(np.frombuffer(text + b"\n", np.uint8)):
            if not any(x < b and a < y for x, y, _, _ in base):
                spans.append((a, b, k, False))
    if spans and not text.isascii():
        points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
        spans = [(int(points[a]), int(points[b]), k, by) for a, b, k, by in spans]
    return sorted(spans, key=lambda s: (s[0], s[2]))


def _slice_spans(some: list[bytes | None], scorer: Scorer) -> list[list[tuple[int, int, int, bool]]]:
    """`spans_of` of each text; the tokens of the whole slice are scored at once."""
    whole, starts = T.joined(some)
    extra: dict[int, bool] = {}
    if scorer.tables:
        at = np.array([a for a, _, _ in scorer.secrets(np.frombuffer(whole, np.uint8))], np.int64)
        extra = dict.fromkeys((np.searchsorted(starts, at, "right") - 1).tolist(), True)
    none = Scorer({}, [])
    return [spans_of(x or b"", scorer if i in extra else none) for i, x in enumerate(some)]


def joined_spans(spans: list[tuple[int, int, int, bool]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k, _ in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scorer: Scorer | None = None) -> DataFrame:
    """One row for each document with the spans of its secrets; fits a scorer on the table if none is given."""
    scorer = scorer or learn(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, some in T.slices(batch):
                spans = _slice_spans(some, scorer)
                base = [[s for s in x if s[3]] for x in spans]
                counts = [[sum(s[2] == k for s in x) for x in base] for k in range(len(KINDS))]
                found = [[{"kind": KINDS[k], "start": a, "end": b, "base": by} for a, b, k, by in x] for x in spans]
                columns = [
                    batch.column(0).slice(first, len(some)),
                    *[pa.array(n, pa.int64()) for n in counts],
                    pa.array([hashlib.sha256(joined_spans(x).encode()).hexdigest() for x in base], pa.string()),
                    pa.array([joined_spans(x) for x in spans], pa.string()),
                    pa.array(found, FOUND),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")[:6]] + ["found"])

    return T.pick(df, id_col, text_col).mapInArrow(run, SCHEMA)


def union(spans: list[tuple[int, int, int, bool]]) -> list[tuple[int, int]]:
    """(start, end) of the stretches that the spans cover, by start; overlapping spans make one."""
    whole: list[tuple[int, int]] = []
    for a, b, _, _ in sorted(spans):
        if whole and a < whole[-1][1]:
            whole[-1] = (whole[-1][0], max(b, whole[-1][1]))
        else:
            whole.append((a, b))
    return whole


def redact(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", scorer: Scorer | None = None
) -> DataFrame:
    """The same rows and columns; every secret in the text gives way to `mark`."""
    scorer = scorer or learn(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for first, some in T.slices(batch, text_col):
                rows = batch.slice(first, len(some))
                out = []
                for text, spans in zip(some, _slice_spans(some, scorer)):
                    text = text.decode() if text is not None else None
                    for a, b in reversed(union(spans)):
                        text = text[:a] + mark + text[b:]
                    out.append(text)
                yield rows.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return df.mapInArrow(run, df.schema)
