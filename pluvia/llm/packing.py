"""Operator 5: token sequences of fixed capacity by harmonic packing.

A document is tokenised, ends with one end token, and is cut. Full-capacity pieces are sequences of
their own. The rest is dealt to reciprocal-capacity classes: class j takes pieces of more than
capacity/(j+1) and at most capacity/j tokens and fills a bin with exactly j of them, so a bin never
depends on another worker and nothing is shuffled. A piece that would leave its class's bins with
more than `slack` of the capacity empty is cut to the top size of the next class, and the remainder is
dealt on. What is left in unfinished bins when a worker ends is filled up by cutting; the last tokens
go to sequences whose sizes are powers of two, which need no padding.

Cases: null text counts as empty; an empty text is the end token alone; equal rows are packed once for
each row; a null id is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pluvia.llm import texts as T

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_SPACE, _LETTER, _DIGIT, _MARK, _OPEN = range(5)


def _byte_classes() -> np.ndarray:
    """Pre-tokens never run over white space, nor over two ASCII bytes of different class.

    Bytes beyond ASCII and the apostrophe (contractions) tie their neighbours together instead.
    """
    kinds = np.full(256, _MARK, np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = _SPACE
    kinds[ord("0") : ord("9") + 1] = _DIGIT
    kinds[ord("a") : ord("z") + 1] = kinds[ord("A") : ord("Z") + 1] = _LETTER
    kinds[128:] = kinds[ord("'")] = _OPEN
    return kinds


class WordTokens:
    """Ids of many texts, each distinct chunk being encoded once.

    `path` is a tokenizers file whose pre-tokens keep within white space. At most `remember` chunks
    are held from one slice to the next.
    """

    MARK = "\x01"

    def __init__(self, path: str, remember: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.remember = remember
        self.classes = _byte_classes()
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        #: First bytes of the marks that can merge with an ASCII letter; case is left alone near them.
        self.accents = (b"\xcc", b"\xcd")
        mark = self._encode(self.MARK)
        self.mark = mark[0] if len(mark) == 1 else None

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, chunks: list[bytes]) -> None:
        """Encode many chunks at once, with a chunk of one known id between them."""
        plain = [x for x in chunks if b"\x01" not in x] if self.mark is not None else []
        if plain:
            for part in range(0, len(plain), 20_000):
                some = plain[part : part + 20_000]
                ids = np.array(self._encode(f" {self.MARK} ".join([x.decode() for x in some])), np.uint32)
                cuts = np.concatenate(([-1], np.flatnonzero(ids == self.mark), [len(ids)]))
                raw = ids.tobytes()
                if len(cuts) != len(some) + 1:
                    raise ValueError("the tokenizer joins chunks over white space")
                for chunk, a, b in zip(some, (cuts[:-1] + 1).tolist(), cuts[1:].tolist()):
                    self.known[chunk] = raw[4 * a : 4 * b]
        for chunk in chunks:
            if chunk not in self.known:
                self.known[chunk] = np.array(self._encode(chunk.decode()), np.uint32).tobytes()

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers."""
        odd = {i for i, x in enumerate(texts) if x and any(s in x for s in self.special)}
        whole, starts = T.joined([b"" if i in odd else x for i, x in enumerate(texts)])
        if not any(x in whole for x in self.accents):
            whole = whole.lower()
        data = np.frombuffer(whole, np.uint8)
        kind = self.classes[data]
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        before, after = kind[edge - 1], kind[edge]
        cut = ((before != _OPEN) & (after != _OPEN)) | (before == _SPACE) | (after == _SPACE)
        edge, before, after = edge[cut], before[cut], after[cut]
        start, end = edge[after != _SPACE], edge[before != _SPACE]
        if kind[0] != _SPACE:
            start = np.concatenate(([0], start))
        chunks, number = T.distinct(data, start, end)
        if len(self.known) > self.remember:
            self.known.clear()
        self._learn([x for x in chunks if x not in self.known])
        found = [self.known[x] for x in chunks]
        flat = np.frombuffer(b"".join(found), np.uint32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        base = np.cumsum(sizes) - sizes
        each = sizes[number]
        ends = np.cumsum(each)
        ids = flat[np.repeat(base[number] - ends + each, each) + np.arange(int(each.sum()))]
        at = np.concatenate(([0], ends))[np.searchsorted(start, starts)]
        return [
            np.array(self._encode(texts[i].decode()), np.uint32) if i in odd else ids[at[i] : at[i + 1]]
            for i in range(len(texts))
        ]


class HarmonicPacker:
    """Deals pieces to classes and hands out finished sequences as lists of rows."""

    def __init__(self, capacity: int, slack: float, first_id: int):
        self.capacity, self.slack, self.next_id = capacity, slack, first_id
        self.bins: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while at < total:
            left = total - at
            if left >= self.capacity:
                self._sequence([(doc_id, at, ids[at : at + self.capacity], total)])
                at += self.capacity
                continue
            per_bin = self.capacity // left
            size = left
            if self.capacity - per_bin * left > self.slack * self.capacity:
                size = self.capacity // (per_bin + 1)
                per_bin += 1
            waiting = self.bins.setdefault(per_bin, [])
            waiting.append((doc_id, at, ids[at : at + size].copy(), total))
            if len(waiting) == per_bin:
                self._sequence(self.bins.pop(per_bin))
            at += size

    def _sequence(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset, ids))
            offset += len(ids)
        self.next_id += 1

    def finish(self) -> None:
        """Empty the unfinished bins: full sequences first, then powers of two."""
        left = [piece for per_bin in sorted(self.bins) for piece in self.bins[per_bin]]
        self.bins.clear()
        tokens = sum(len(p[2]) for p in left)
        while tokens:
            room = self.capacity if tokens >= self.capacity else 1 << (tokens.bit_length() - 1)
            tokens -= room
            taken = []
            while room:
                doc_id, start, ids, total = left.pop(0)
                taken.append((doc_id, start, ids[:room], total))
                if len(ids) > room:
                    left.insert(0, (doc_id, start + room, ids[room:], total))
                room -= len(taken[-1][2])
            self._sequence(taken)

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


@functools.lru_cache(1)
def word_tokens(path: str) -> WordTokens:
    """One encoder for each worker process, so that later tasks find its chunks."""
    return WordTokens(path)


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Where the installed vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    tokenizer: str | None = None,
    end_id: int = 2,
    slack: float = 1 / 64,
    keep_ids: bool = False,
) -> DataFrame:
    """One row for each piece; with `keep_ids` its token ids as well.

    `tokenizer` is the path of a tokenizers file on the workers (the installed public one if None).
    Sequence ids are unique, not consecutive: the number of the input partition in the upper half.
    """
    if capacity < 1:
        raise ValueError("capacity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokens(tokenizer or public_tokenizer())
        packer = HarmonicPacker(capacity, slack, TaskContext.get().partitionId() << 32)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, some in T.slices(batch):
                for i, ids in enumerate(encode(some)):
                    packer.add(names[first + i], np.append(ids, np.uint32(end_id)))
                if packer.rows:
                    yield table(packer.take())
        packer.finish()
        if packer.rows:
            yield table(packer.take())

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
        if keep_ids:
            arrays.append(pa.array([x.astype(np.int64) for x in columns[7]], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(arrays, names)

    schema = SCHEMA + (", ids array<long>" if keep_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    return T.pick(df, id_col, text_col).mapInArrow(run, schema)
