"""Operator 4: exact top-k inner products with one KD-tree for each shard of vectors.

Components become integers, floor(scale * x). Equal vectors are one entry that keeps its k+1 smallest ids:
more of them can't be among a query's k best. Entries are dealt to shards of bounded size by hash; a shard's
tree splits at the median of the widest side of its bounding box, and every node keeps the tight box of what
is below it. A query visits nodes best first, by the greatest product that its box allows, and stops when no
box can reach its k-th best score. Queries travel in blocks of bounded size: a block first searches one
shard, and its k-th scores then bound the search of all the others. Scores are exact: products are taken in
double precision only while every sum stays below 2^53.

Cases: vectors that are null or hold null or non-finite components take no part, as rows without an id;
missing components of a shorter vector count as zero; equal rows count once; all rows with the query's id
are its own; fewer candidates than k give fewer rows; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.operators.storage import materialise


class KDTree:
    """Nodes in preorder; a leaf holds the entries [first, last)."""

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray], leaf: int = 128):
        order = np.arange(len(vectors))
        self.first: list[int] = []
        self.last: list[int] = []
        self.children: list[tuple[int, int] | None] = []
        low: list[np.ndarray] = []
        high: list[np.ndarray] = []
        stack = [(0, len(vectors), -1)]
        while stack:
            a, b, parent = stack.pop()
            node = len(self.first)
            if parent >= 0:
                self.children[parent] = (self.children[parent] or ()) + (node,)
            some = vectors[order[a:b]]
            low.append(some.min(axis=0))
            high.append(some.max(axis=0))
            self.first.append(a)
            self.last.append(b)
            self.children.append(None)
            if b - a > leaf:
                side = int((high[-1].astype(float) - low[-1]).argmax())
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(some[:, side], middle)]
                stack += [(a + middle, b, node), (a, a + middle, node)]
        self.low, self.high = np.array(low), np.array(high)
        self.vectors = vectors[order]
        self.ids = [ids[i] for i in order.tolist()]

    def search(
        self, queries: np.ndarray, own: list[int], k: int, least: np.ndarray | None = None
    ) -> list[list[tuple[int, int]]]:
        """For each query up to k (score, id), best first; `least`: k-th scores known already."""
        most = float(np.abs(queries).max(initial=0)) * float(np.abs(self.vectors).max(initial=0)) * queries.shape[1]
        kind = np.float64 if most < 2**53 else np.int64
        queries, vectors = queries.astype(kind), self.vectors.astype(kind)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        bounds = up @ self.high.T.astype(kind) + down @ self.low.T.astype(kind)
        out = []
        for q in range(len(queries)):
            best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst first
            floor = None if least is None else int(least[q])
            bound, vector = bounds[q].tolist(), queries[q]
            todo = [(-bound[0], 0)]
            while todo:
                over, node = heapq.heappop(todo)
                kth = best[0][0] if len(best) == k else floor
                if kth is not None and -over < kth:
                    break
                if (children := self.children[node]) is not None:
                    for c in children:
                        heapq.heappush(todo, (-bound[c], c))
                    continue
                a, b = self.first[node], self.last[node]
                scores = vectors[a:b] @ vector
                good = np.arange(len(scores)) if kth is None else np.flatnonzero(scores >= kth)
                if len(best) < k:
                    good = good[np.argsort(-scores[good], kind="stable")]
                for i in good.tolist():
                    score = int(scores[i])
                    for vec_id in self.ids[a + i].tolist():
                        if vec_id == own[q]:
                            continue
                        entry = (score, -vec_id)
                        if len(best) < k:
                            heapq.heappush(best, entry)
                        elif entry > best[0]:
                            heapq.heapreplace(best, entry)
                        else:
                            break
                floor = None if floor is None else max(floor, best[0][0] if len(best) == k else floor)
            out.append([(s, -i) for s, i in sorted(best, reverse=True)])
        return out


def _integers(vector: Column, scale: int) -> Column:
    """The vector as an array of longs, null if it takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return F.when(vector.isNotNull() & ~bad, whole)


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    matrix = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        matrix[i, : len(v)] = v
    if len(matrix) and np.abs(matrix).max() < 2**31:
        return matrix.astype(np.int32)
    return matrix


def top_k(
    df: DataFrame,
    queries: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    shard_rows: int = 8192,
    block_rows: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row where `queries` holds."""
    rows = df.select(
        F.col(id_col).cast("long").alias("vec_id"),
        _integers(F.col(vector_col), scale).alias("v"),
        F.coalesce(queries, F.lit(False)).alias("asks"),
    ).where("vec_id is not null and v is not null")
    rows = materialise(rows, "vectors")
    near = Window.partitionBy("v").orderBy("vec_id")
    entries = rows.groupBy("v", "vec_id").count().drop("count")
    entries = entries.withColumn("at", F.row_number().over(near)).where(F.col("at") <= k + 1)
    entries = materialise(entries.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    n, width = entries.agg(F.count("*"), F.max(F.size("v"))).first()
    asked = rows.where("asks").select("vec_id", "v").distinct()
    n_asked = asked.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_asked // block_rows))
    width = max(1, width or 0)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        tree = KDTree(_matrix(list(part.v), width), [np.asarray(x) for x in part.ids])
        return pd.DataFrame({"shard": [int(part.shard.iloc[0])], "tree": [pickle.dumps(tree, 5)]})

    def block(part: pd.DataFrame) -> pd.DataFrame:
        held = (part.vec_id.tolist(), _matrix(list(part.v), width))
        return pd.DataFrame({"block": [int(part.block.iloc[0])], "asked": [pickle.dumps(held, 5)]})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                number, shard, asked, tree, kth = (c[row].as_py() for c in batch.columns)
                own, vectors = pickle.loads(asked)
                least = None if kth is None else np.frombuffer(kth, np.int64)
                found = pickle.loads(tree).search(vectors, own, k, least)
                flat = [(number, shard, q, i, s) for q, best in zip(own, found) for s, i in best]
                if kth is None:
                    none = np.iinfo(np.int64).min
                    kth = np.array([b[-1][0] if len(b) == k else none for b in found], np.int64).tobytes()
                    flat.append((number, shard, None, None, None))
                    marks = [None] * (len(flat) - 1) + [kth]
                else:
                    marks = [None] * len(flat)
                columns = list(zip(*flat)) or [()] * 5
                arrays = [pa.array(c, pa.int64()) for c in columns] + [pa.array(marks, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["block", "shard", "query_id", "vec_id", "score", "kth"])

    shard = F.pmod(F.xxhash64("v"), F.lit(shards)).alias("shard")
    trees = entries.select("v", "ids", shard).groupBy("shard").applyInPandas(build, "shard long, tree binary")
    trees = materialise(trees, "trees")
    held = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    held = materialise(held.groupBy("block").applyInPandas(block, "block long, asked binary"), "blocks")
    out = "block long, shard long, query_id long, vec_id long, score long, kth binary"
    order = ["block", "shard", "asked", "tree", "kth"]
    filled = trees.select(F.sort_array(F.collect_list("shard")).alias("filled"))  # numbers of shards only
    filled = [int(s) for s in filled.first()[0]]
    home = F.element_at(F.array([F.lit(s) for s in filled] or [F.lit(0)]), (F.col("block") % max(1, len(filled)) + 1).cast("int"))
    begun = held.withColumn("shard", home.cast("long")).join(trees, "shard")
    begun = begun.withColumn("kth", F.lit(None).cast("binary")).select(*order).mapInArrow(search, out)
    begun = materialise(begun, "begun")
    kth = begun.where("kth is not null").select("block", F.col("shard").alias("home"), "kth")
    rest = held.join(kth, "block").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    rest = rest.where("shard != home").join(trees, "shard").select(*order).mapInArrow(search, out)
    found = begun.where("kth is null").unionByName(rest).select("query_id", "vec_id", "score")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
