"""Operator 8: language of a text by sparse multinomial logistic regression on character n-grams.

Features are hashed pairs and triples of letters (small letters; whatever is between two runs of letters is
one space), weighted by log(1 + count) and inverse document frequency and scaled to length one. Document
frequencies cover all rows that may be learned from. Weights are trained with follow-the-regularised-leader
(per coordinate, with L1 and L2 penalties) on a bounded sample, at most about `most_rows` rows of each
language; a fifth of the sample is set aside to fit the temperature of the probabilities.

Rows whose CRC-32 of the id leaves `held_rest` modulo `held_of` are never learned from.

Cases: null, empty and letterless texts are `und` with score 0; if no row has a language, all are `und`;
equal rows are judged one by one; a null id counts as learned from (its remainder is null, held_out false);
ties go to the first language by name; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.llm import texts as T

UNKNOWN = "und"
FEATURES = 1 << 15

#: A letter takes some fifty bytes while its n-grams are hashed, so slices of texts are short.
SLICE_BYTES = 1 << 19


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its small letter, or a space if it is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            small = c.lower()
            table[i] = ord(small) if len(small) == 1 else i
    return table


def features(some: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """(features, counts) of each text, None without letters."""
    texts = [(x or b"").decode("utf-8", "replace") for x in some]
    sizes = np.array([len(t) + 1 for t in texts])
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    small = _letters()[points]
    space = small == 32
    keep = ~space  # no space at the beginning of a text, one behind each run of letters
    keep[1:] |= ~space[:-1]
    ends = np.cumsum(keep)[np.cumsum(sizes) - 1]
    small = small[keep].astype(np.uint64)
    two = small[:-1] * np.uint64(0x9E3779B97F4A7C15) + small[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two[:-1] + small[2:] * np.uint64(0x165667B19E3779F9)
    shift = np.uint64(64 - (FEATURES.bit_length() - 1))
    mix = np.uint64(0xFF51AFD7ED558CCD)
    two = (((two ^ (two >> np.uint64(29))) * mix) >> shift).astype(np.uint16)
    three = (((three ^ (three >> np.uint64(31))) * mix) >> shift).astype(np.uint16)
    start = 0
    for end in ends.tolist():
        # The n-grams that lie within the text; a letter makes at least one pair with the space behind it.
        if end - start < 2:
            yield None
        else:
            both = np.concatenate((two[start : end - 1], three[start : max(start, end - 2)]))
            counts = np.bincount(both, minlength=FEATURES)
            found = np.flatnonzero(counts)
            yield found, counts[found]
        start = end


class Model:
    """Languages, inverse document frequencies, weights (features + intercept) x languages, temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf, self.temperature = languages, idf, 1.0
        self.weights = np.zeros((FEATURES + 1, len(languages)))

    def vector(self, found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = np.log1p(counts) * self.idf[found]
        values /= np.sqrt((values * values).sum()) or 1.0
        return np.append(found, FEATURES), np.append(values, 1.0)

    def fit(
        self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], rounds: int = 4,
        rate: float = 0.5, smooth: float = 1.0, l1: float = 0.1, l2: float = 0.001,
    ) -> None:
        """Follow the regularised leader over the rows, then choose the temperature on every fifth row."""
        shape = self.weights.shape
        z, n, w = np.zeros(shape), np.zeros(shape), self.weights
        held = [i for i in range(len(rows)) if i % 5 == 4]
        fitted = [i for i in range(len(rows)) if i % 5 != 4]
        for _ in range(rounds):
            for i in fitted:
                at, x = rows[i]
                error = _softmax(x @ w[at])
                error[labels[i]] -= 1
                g = x[:, None] * error
                old = n[at]
                new = old + g * g
                sigma = (np.sqrt(new) - np.sqrt(old)) / rate
                z[at] += g - sigma * w[at]
                n[at] = new
                step = (smooth + np.sqrt(new)) / rate + l2
                w[at] = np.where(np.abs(z[at]) <= l1, 0.0, (np.sign(z[at]) * l1 - z[at]) / step)
        if held:
            logits = np.array([rows[i][1] @ w[rows[i][0]] for i in held])
            own = np.array([labels[i] for i in held])
            grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
            loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(own)), own], 1e-12)).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def predict(self, found: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        at, x = self.vector(found, counts)
        p = _softmax(x @ self.weights[at] / self.temperature)
        return self.languages[int(p.argmax())], float(p.max())


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def held_out(of: int, rest: int, name: str = "doc_id") -> Column:
    return F.coalesce(T.crc_of_id(name) % of == rest, F.lit(False))


def learn(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    most_rows: int = 1_500, held_of: int = 4, held_rest: int = 2,
) -> Model:
    """Fit a model on the rows that have a language and are not held out."""
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
    ).where(~held_out(held_of, held_rest) & F.col("lang").isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(FEATURES + 1, np.int64), 0
        for batch in batches:
            for _, some in T.slices(batch, most=SLICE_BYTES):
                for row in features(some):
                    if row is not None:
                        seen[row[0]] += 1
                        n += 1
        seen[FEATURES] = n  # the last number counts the rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], ["f", "n"])

    df_counts = rows.select("text").mapInArrow(frequencies, "f int, n long").groupBy("f").agg(F.sum("n").alias("n"))
    counts = np.zeros(FEATURES + 1)
    for r in df_counts.collect():
        counts[r.f] = r.n
    idf = np.log((1 + counts[FEATURES]) / (1 + counts[:FEATURES])) + 1

    per_language = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    model = Model(sorted(per_language), idf)
    if not per_language:
        return model
    share = F.create_map(*[F.lit(x) for k, n in per_language.items() for x in (k, int(1e6 * min(1.0, most_rows / n)))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")))
    expected = sum(min(n, most_rows) for n in per_language.values())
    if not expected // 2 <= chosen.select("doc_id", "lang").count() <= 2 * expected:
        # One id, or null, has a large part of the rows: draw by id and text, exactly so many.
        nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text")))
        chosen = rows.withColumn("nth", nth).where(F.col("nth") <= most_rows).drop("nth")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, some in T.slices(batch, most=SLICE_BYTES):
                found = list(features(some))
                arrays = [
                    batch.column(0).slice(first, len(some)),
                    batch.column(2).slice(first, len(some)),
                    pa.array([None if x is None else x[0].astype(np.uint16).tobytes() for x in found], pa.binary()),
                    pa.array([None if x is None else x[1].astype(np.uint32).tobytes() for x in found], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang", "at", "n"])

    sample = chosen.mapInArrow(vectors, "doc_id long, lang string, at binary, n binary").where("at is not null")
    taken = sample.toPandas()
    mixed = [hash((-1 if i != i else i, 11)) & 0xFFFFFFFF for i in taken.doc_id]  # null ids are NaN here
    taken = taken.assign(mixed=mixed).sort_values(["mixed", "doc_id", "lang", "at", "n"])
    number = {k: i for i, k in enumerate(model.languages)}
    fitted = [
        model.vector(np.frombuffer(at, np.uint16).astype(np.int64), np.frombuffer(n, np.uint32))
        for at, n in zip(taken["at"], taken["n"])
    ]
    model.fit(fitted, [number[k] for k in taken["lang"]])
    return model


def identify(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    model: Model | None = None, held_of: int = 4, held_rest: int = 2,
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; fits a model on the table if none is given."""
    model = model or learn(df, id_col, text_col, lang_col, held_of=held_of, held_rest=held_rest)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, some in T.slices(batch, most=SLICE_BYTES):
                found = _predictions(shared.value, some)
                arrays = [
                    batch.column(0).slice(first, len(some)),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang_pred", "score"])

    rows = T.pick(df, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", held_out(held_of, held_rest).alias("held_out"), "lang_pred", "score")


def _predictions(model: Model, some: list[bytes | None]) -> list[tuple[str, float]]:
    known = len(model.languages) > 0
    return [model.predict(*x) if x is not None and known else (UNKNOWN, 0.0) for x in features(some)]


def keep_identified(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    least_score: float = 0.5, model: Model | None = None,
) -> DataFrame:
    """The rows with a language of at least that probability, in the same columns; it is written to `lang_col`."""
    model = model or learn(df, id_col, text_col, lang_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(lang_col)
            for first, some in T.slices(batch, text_col, SLICE_BYTES):
                found = _predictions(shared.value, some)
                rows = batch.slice(first, len(some))
                rows = rows.set_column(at, batch.schema.field(at), pa.array([x[0] for x in found], batch.schema.field(at).type))
                yield rows.filter(pa.array([x[0] != UNKNOWN and x[1] >= least_score for x in found], pa.bool_()))

    return df.mapInArrow(run, df.schema)
