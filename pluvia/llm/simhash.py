"""Operator 1: near-duplicate documents by SimHash and deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Two fingerprints with at most two differing bits have a
half in which at most one bit differs, so they share a variant of that half with one bit left out.
Distinct fingerprints are indexed under all 64 variants and meet by equality of the variant. Where more
than `crowd` fingerprints meet, they are not compared with each other: variants of the other half split
the bucket into classes of at most four that are all within two bits. Verified links go to connected
components; the links of copies never multiply, because equal fingerprints are one node.

Cases: null text has no words; without words the fingerprint is zero and links like any other; a text of
one or two words is one shingle; equal rows are each returned with the same component; rows with a null
id get the component of their fingerprint (null if no row of it has an id); an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm import texts as T
from pluvia.llm.components import components
from pluvia.operators.storage import materialise


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of one UTF-8 text, as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    words = (text or b"").translate(T.LOWER).split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, ends = [0, *ends[:-1].tolist()], (ends - 1).tolist()
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(
        [xxh64_intdigest(whole[a:b], seed) for a, b in zip(starts[:n], ends[-n:])], np.uint64, n
    )
    bits = np.zeros(64, np.int64)
    for part in range(0, n, 1 << 16):
        some = hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, some in T.slices(batch):
                prints = pa.array([fingerprint(x, shingle) for x in some], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(some)), prints], ["doc_id", "fp"])

    return T.pick(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _variants(prints: DataFrame) -> DataFrame:
    """64 rows for each fingerprint: v is the bit left out, key the half without it.

    `turned` is the fingerprint rotated so that bit v is the sign: the least and the greatest of a
    bucket then show whether both values of the bit occur in it.
    """
    half = "case when v >= 32 then shiftrightunsigned(fp, 32) else fp & 4294967295L end"
    return prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")).selectExpr(
        "fp",
        "v",
        f"shiftleft(cast(v as bigint), 32) | (({half}) & ~shiftleft(1L, v & 31)) as key",
        "shiftleft(fp, 63 - v) | shiftrightunsigned(shiftrightunsigned(fp, v), 1) as turned",
    )


#: Of a bucket that leaves out the first bit of a half all close pairs count, of the others those that differ there.
_NEEDED = "(v & 31 = 0 or (lo < 0) != (hi < 0))"
_BACK = "shiftrightunsigned({0}, 63 - v) | shiftleft(shiftleft({0}, v), 1)"


def links(prints: DataFrame, crowd: int = 64) -> DataFrame:
    """Pairs (u, v) of fingerprints within two bits, enough to join all that are linked. `prints`: fp, distinct.

    All pairs of a bucket are compared up to `crowd` members; beyond, the second variants take over.
    """
    variants = _variants(prints)
    buckets = materialise(
        variants.groupBy("key", "v")
        .agg(F.count("*").alias("n"), F.min("turned").alias("lo"), F.max("turned").alias("hi"))
        .where(f"n > 1 and {_NEEDED}"),
        "buckets",
    )
    two = buckets.where("n = 2").selectExpr(f"{_BACK.format('lo')} as u", f"{_BACK.format('hi')} as v")
    two = two.where("bit_count(u ^ v) <= 2")
    members = variants.select("key", "fp").join(buckets.where("n > 2").select("key", "v", "n"), "key")
    few = (
        members.where(F.col("n") <= crowd)
        .groupBy("key", "v")
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        .select("v", "fps", F.explode("fps").alias("a"))
        .selectExpr(
            "a as u",
            "explode(filter(fps, b -> b > a and bit_count(a ^ b) <= 2 "
            "and (v & 31 = 0 or (shiftright(a ^ b, v) & 1) = 1))) as v",
        )
    )
    many = members.where(F.col("n") > crowd)
    # One bit out of each half, or, once for each half, the half as it is and two bits out of the other.
    one = many.selectExpr("fp", "v", "explode(sequence(0, 31)) as i").selectExpr(
        "fp", "shiftleft(1L, v) | shiftleft(1L, case when v >= 32 then i else i + 32 end) as mask"
    )
    both = many.where("v & 31 = 0").selectExpr("fp", "v", "explode(sequence(0, 31)) as i")
    both = both.where("i < 31").selectExpr("fp", "v", "i", "explode(sequence(i + 1, 31)) as j")
    both = both.selectExpr(
        "fp", "shiftleft(shiftleft(1L, i) | shiftleft(1L, j), case when v >= 32 then 0 else 32 end) as mask"
    )
    classes = one.unionByName(both).selectExpr("fp", "mask", "fp & ~mask as rest").distinct()
    crowded = (
        classes.groupBy("mask", "rest")
        .agg(F.min("fp").alias("u"), F.collect_set("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("u", F.explode("fps").alias("v"))
        .where("u != v")
    )
    return two.unionByName(few).unionByName(crowded).distinct()


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, crowd: int = 64
) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) of every row; component_id is the smallest id reachable."""
    rows = materialise(fingerprints(df, id_col, text_col, shingle), "prints")
    prints = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(links(prints.select("fp"), crowd)).withColumnRenamed("node", "fp")
    rooted = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = rooted.join(smallest, "root").select("fp", "component_id")
    return rows.join(found, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of `df`, of each component only one: that with the smallest id (null ids last).

    Equal rows count as one; of different texts under the same id that with the smaller fingerprint stays.
    """
    fp, number, none = (T.unused(df, name) for name in ("fp", "number", "none"))
    marked = materialise(with_fingerprint(df, fp, text_col, shingle), "marked")
    given = F.col(id_col).cast("long")
    marked = marked.withColumn(number, F.coalesce(given, F.lit(0).cast("long"))).withColumn(none, given.isNull())
    own = F.min(F.struct(none, number)).alias("own")
    prints = materialise(marked.groupBy(F.col(fp).alias("fp")).agg(own), "distinct")
    roots = components(links(prints.select("fp"))).withColumnRenamed("node", "fp")
    rooted = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = rooted.groupBy("root").agg(F.min(F.struct("own", "fp")).alias("best"))
    chosen = best.select(
        F.col("best.fp").alias(fp), F.col(f"best.own.{number}").alias(number), F.col(f"best.own.{none}").alias(none)
    )
    kept = marked.join(chosen, [fp, number, none], "left_semi")
    return kept.dropDuplicates([fp, number, none]).select(*df.columns)


def with_fingerprint(df: DataFrame, name: str, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """All columns of the rows and their fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, some in T.slices(batch, text_col):
                prints = pa.array([fingerprint(x, shingle) for x in some], pa.int64())
                rows = batch.slice(first, len(some))
                yield pa.RecordBatch.from_arrays([*rows.columns, prints], [*rows.schema.names, name])

    return df.mapInArrow(run, T.schema_with(df, name, "long"))
