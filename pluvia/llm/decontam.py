"""Operator 9: benchmark passages in training documents, found with an FM-index per training shard.

A shard is a slice of whole documents of bounded size. Its words become numbers of the test phrases'
vocabulary; any other word ends a stretch. Stretches shorter than the shortest phrase can hold none and
stay out of the index. Over the others a suffix array is sorted by prefix doubling, its Burrows-Wheeler
transform goes to a wavelet matrix, all phrases are searched backwards at once with rank queries, and
occurrences are located by walking to sampled suffix positions. Occurrences of a document are merged to
removal spans. Documents never move between tasks.

The test set is read in blocks of at most `block_words` words; each block is broadcast and is one more
pass over the rows, so that what a worker holds stays bounded.

Cases: null or wordless texts have no words and are never hit; wordless items are no phrases; items with
a null id hit words but are not listed; repeated items count once; equal document rows are judged one by
one; an empty test set hits nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pluvia.llm import texts as T

#: Bytes of words as they are; capital letters as small ones; all others become spaces.
WORD_BYTES = bytes(
    i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else i + 32 if 65 <= i <= 90 else 32 for i in range(256)
)
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(WORD_BYTES).split()


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector for each bit of a symbol, with counts for each 64 bits."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.n, self.levels = len(sequence), []
        for bit in range(bits - 1, -1, -1):
            ones = ((sequence >> bit) & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = ones
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=counts[1:])
            zeros = self.n - int(ones.sum())
            self.levels.append((bit, packed, counts, zeros))
            sequence = np.concatenate((sequence[~ones], sequence[ones]))

    @staticmethod
    def _ones(packed: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
        block, inside = at >> 6, (at & 63).astype(np.uint64)
        return counts[block] + np.bitwise_count(packed[block] & ((np.uint64(1) << inside) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol comes before each place."""
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for bit, packed, counts, zeros in self.levels:
            set_ = ((symbol >> bit) & 1).astype(bool)
            a, b = self._ones(packed, counts, low), self._ones(packed, counts, high)
            low, high = np.where(set_, zeros + a, low - a), np.where(set_, zeros + b, high - b)
        return high - low

    def get(self, at: np.ndarray) -> np.ndarray:
        """The symbols at these places."""
        found, at = np.zeros(len(at), np.int64), at.astype(np.int64)
        for bit, packed, counts, zeros in self.levels:
            set_ = ((packed[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            ones = self._ones(packed, counts, at)
            found |= set_.astype(np.int64) << bit
            at = np.where(set_, zeros + ones, at - ones)
        return found


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order; each 0 of the text is smaller than any other symbol and than every later 0."""
    n = len(text)
    ends = text == 0
    n_ends = int(ends.sum())
    rank = text.astype(np.int64) + n_ends
    rank[ends] = np.arange(n_ends)
    order = np.argsort(rank, kind="stable")
    _, rank = np.unique(rank, return_inverse=True)
    #: From here a suffix's rank is the first place of its group.
    sizes = np.bincount(rank)
    begin = np.cumsum(sizes) - sizes
    tied = order[np.repeat(sizes > 1, sizes)]
    rank = begin[rank]
    reach = 1
    while len(tied):
        following = rank[np.minimum(tied + reach, n - 1)]
        by = np.lexsort((following, rank[tied]))
        tied, following = tied[by], following[by]
        group = rank[tied]
        fresh_group = np.concatenate(([True], group[1:] != group[:-1]))
        fresh = fresh_group | np.concatenate(([True], following[1:] != following[:-1]))
        at = np.arange(len(tied))
        base = np.maximum.accumulate(np.where(fresh_group, at, 0))
        lead = np.maximum.accumulate(np.where(fresh, at, 0))
        order[group + at - base] = tied
        rank[tied] = group + lead - base
        size = np.bincount(np.cumsum(fresh) - 1)
        tied = tied[np.repeat(size > 1, size)]
        reach *= 2
    return order


class FMIndex:
    """Backward search and location in one text of symbols; 0 ends stretches and is in no phrase."""

    def __init__(self, text: np.ndarray, n_symbols: int, step: int = 8):
        order = suffix_array(text)
        before = text[order - 1]
        before[order == 0] = 0
        self.bwt = WaveletMatrix(before, max(1, int(n_symbols).bit_length()))
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))))
        self.n = len(text)
        #: Every step-th position is kept, and those that start a stretch, where walking back would end.
        kept = (order % step == 0) | (before == 0)
        self.kept = WaveletMatrix(kept.astype(np.int64), 1)
        self.positions = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of the suffixes that begin with each phrase; phrases are rows of equal length."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, column]
            a = self.smaller[symbol] + self.bwt.rank(symbol, low[alive])
            b = self.smaller[symbol] + self.bwt.rank(symbol, high[alive])
            low[alive], high[alive] = a, b
            alive = alive[a < b]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of these rows."""
        found = np.zeros(len(rows), np.int64)
        left, at, walked = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(left):
            kept = self.kept.get(at).astype(bool)
            found[left[kept]] = self.positions[self.kept.rank(np.ones(int(kept.sum()), np.int64), at[kept])] + walked
            left, at = left[~kept], at[~kept]
            symbol = self.bwt.get(at)
            at = self.smaller[symbol] + self.bwt.rank(symbol, at)
            walked += 1
        return found


class Phrases:
    """The test phrases of one block of items: windows of `window` words, or a shorter item as a whole."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        self.ids: list[str | None] = []
        for item_id, words in items:
            self.ids.append(item_id)
            coded = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            for i in range(max(1, len(coded) - window + 1)):
                owners.setdefault(tuple(coded[i : i + window]), set()).add(len(self.ids) - 1)
        self.by_length: list[tuple[int, np.ndarray, list[list[int]]]] = []
        for length in sorted({len(p) for p in owners}):
            some = [p for p in owners if len(p) == length]
            self.by_length.append((length, np.array(some, np.int64), [sorted(owners[p]) for p in some]))
        self.shortest = self.by_length[0][0] if self.by_length else 0

    def occurrences(self, shard: list[list[bytes]]) -> Iterator[tuple[np.ndarray, int, list[list[int]], np.ndarray]]:
        """(word positions in the shard, length, items of the phrases, which phrase) by phrase length."""
        get, none = self.numbers.get, 0
        sizes = [len(w) + 1 for w in shard]
        coded = np.zeros(sum(sizes), np.int64)
        at = 0
        for words, size in zip(shard, sizes):
            coded[at : at + size - 1] = [get(w, none) for w in words]
            at += size
        known = np.concatenate((coded != 0, [False]))
        start, end = T.runs(known)
        long = end - start >= self.shortest
        start, end = start[long], end[long]
        if not len(start):
            return
        spans = end - start + 1
        offset = np.cumsum(spans) - spans
        position = np.repeat(start - offset, spans) + np.arange(int(spans.sum()))
        text = np.where(known[position], coded[np.minimum(position, len(coded) - 1)], 0)
        index = FMIndex(text, len(self.numbers))
        for length, phrases, owners in self.by_length:
            low, high = index.search(phrases)
            count = np.maximum(high - low, 0)
            if not count.any():
                continue
            which = np.repeat(np.arange(len(count)), count)
            rows = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            yield position[index.locate(rows)], length, owners, which


def _hits(phrases: Phrases, shard: list[list[bytes]], spans: list[list], items: list[set]) -> None:
    """Add each document's merged spans and item ids of one block."""
    starts = np.concatenate(([0], np.cumsum([len(w) + 1 for w in shard])))
    change = np.zeros(int(starts[-1]) + 1, np.int64)
    hit = False
    for at, length, owners, which in phrases.occurrences(shard):
        hit = True
        np.add.at(change, at, 1)
        np.add.at(change, at + length, -1)
        pairs = np.unique(np.stack((np.searchsorted(starts, at, "right") - 1, which)), axis=1)
        for doc, phrase in pairs.T.tolist():
            items[doc].update(phrases.ids[i] for i in owners[phrase])
    if hit:
        a, b = T.runs(np.cumsum(change) > 0)
        for doc, x, y in zip((np.searchsorted(starts, a, "right") - 1).tolist(), a.tolist(), b.tolist()):
            spans[doc].append((x - int(starts[doc]), y - int(starts[doc])))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> Iterator[Phrases]:
    """The test set, read row by row and cut to blocks of at most so many words (one item at least)."""
    held: list[tuple[str | None, list[bytes]]] = []
    n = 0
    chosen = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    for row in chosen.toLocalIterator():
        words = words_of(row.t)
        if words:
            if held and n + len(words) > block_words:
                yield Phrases(held, window)
                held, n = [], 0
            held.append((row.i, words))
            n += len(words)
    if held:
        yield Phrases(held, window)


VERDICT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def judge(
    rows: DataFrame,
    benchmark: DataFrame,
    text_col: str,
    item_col: str,
    item_text_col: str,
    window: int,
    least_share: float,
    block_words: int,
) -> tuple[DataFrame, dict[str, str]]:
    """All columns of `rows` and the verdict on each, and under which names the verdict's columns are."""
    context = rows.sparkSession.sparkContext
    blocks = [context.broadcast(b) for b in blocks_of(benchmark, item_col, item_text_col, window, block_words)]
    share = Fraction(least_share).limit_denominator(1_000_000)
    own = rows.columns
    names = {n: T.unused(rows, n) for n in ("spans", "item_ids", *VERDICT)}

    def scan(batches: Iterator[pa.RecordBatch], block, last: bool) -> Iterator[pa.RecordBatch]:
        phrases = block.value if block is not None else Phrases([], window)
        for batch in batches:
            for first, some in T.slices(batch, text_col):
                part = batch.slice(first, len(some))
                shard = [words_of(x) for x in some]
                spans = [[tuple(s.values()) for s in x or ()] for x in part.column(len(own)).to_pylist()]
                items = [set(x or ()) for x in part.column(len(own) + 1).to_pylist()]
                _hits(phrases, shard, spans, items)
                spans = [merged(x) for x in spans]
                found = [sorted(i for i in x if i is not None) for x in items]
                columns = part.columns[: len(own)] + [
                    pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], SPANS),
                    pa.array(found, pa.list_(pa.string())),
                ]
                if last:
                    n_words, n_hit = [len(w) for w in shard], [sum(b - a for a, b in x) for x in spans]
                    columns += [
                        pa.array(n_words, pa.int64()),
                        pa.array(n_hit, pa.int64()),
                        pa.array([len(x) for x in found], pa.int64()),
                        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in found], pa.string()),
                        pa.array([h > 0 and share.denominator * h >= share.numerator * n for h, n in zip(n_hit, n_words)], pa.bool_()),
                    ]
                yield pa.RecordBatch.from_arrays(columns, [*own, *list(names.values())[: len(columns) - len(own)]])

    kinds = ["array<struct<start: long, end: long>>", "array<string>", "long", "long", "long", "string", "boolean"]
    fields = [StructType.fromDDL(f"x {kind}")["x"].dataType for kind in kinds]
    fields = [StructField(n, f) for n, f in zip(names.values(), fields)]
    for name, field in list(zip(names.values(), fields))[:2]:
        rows = rows.withColumn(name, F.lit(None).cast(field.dataType))
    start = rows.schema.fields[: len(own)]
    for i, block in enumerate(blocks or [None]):
        last = i >= len(blocks) - 1
        schema = StructType([*start, *(fields if last else fields[:2])])
        rows = rows.mapInArrow(lambda it, b=block, z=last: scan(it, b, z), schema)
    return rows, names


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    least_share: float = 1 / 20,
    block_words: int = 500_000,
) -> DataFrame:
    """One row for each document: hit words, items, merged spans of word positions (end exclusive), verdict.

    A document is contaminated if it has a hit word and the hit words are at least `least_share` of its words.
    """
    rows = T.pick(docs, id_col, text_col)
    found, _ = judge(rows, benchmark, "text", item_col, item_text_col, window, least_share, block_words)
    return found.drop("text")


def without_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    least_share: float = 1 / 20,
    block_words: int = 500_000,
) -> DataFrame:
    """The rows of `docs` that are not contaminated, in the same columns."""
    found, names = judge(docs, benchmark, text_col, item_col, item_text_col, window, least_share, block_words)
    return found.where(~F.col(names["contaminated"])).select(*docs.columns)
