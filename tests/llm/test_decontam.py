import hashlib
import random
import re

import numpy as np
import pytest

from pluvia.llm import decontam as D


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def by_definition(docs, items, window=13):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        at = {}
        for i in range(len(w)):
            at.setdefault(w[i], []).append(i)
        for item_id, body in items:
            b = words(body)
            for k in range(max(1, len(b) - window + 1) if b else 0):
                p = b[k : k + window]
                for i in at.get(p[0], ()):
                    if w[i : i + len(p)] == p:
                        hit.update(range(i, i + len(p)))
                        found.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.mark.parametrize("seed", range(20))
def test_index(seed):
    rng = np.random.default_rng(seed)
    text = np.concatenate((rng.integers(0, 4, rng.integers(1, 200)), [0]))
    index = D.FMIndex(text, 3, step=4)
    for length in (1, 2, 5):
        phrases = rng.integers(1, 4, (30, length))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(len(text) - length + 1) if (text[i : i + length] == p).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_small_alphabet(spark):
    random.seed(1)
    letters = "abz"
    docs = [(i, " ".join(random.choices(letters, k=random.randint(0, 60)))) for i in range(40)]
    items = [(i, " ".join(random.choices("ab", k=random.randint(0, 9)))) for i in range(8)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block_words in (500_000, 5):  # one pass and several
        got = D.contamination(d, b, window=4, block_words=block_words)
        assert sorted(map(tuple, got.select(*COLUMNS).collect())) == sorted(by_definition(docs, items, 4))


def test_documents(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = by_definition(rows, items)
    assert sorted(map(tuple, D.contamination(docs, bench).select(*COLUMNS).collect())) == sorted(want)
    kept = D.without_contaminated(docs, bench)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in want if not r[5])


def test_odd_rows(spark, odd):
    items = [(1, "five SIX seven"), (2, None), (None, "letters"), (3, ""), (1, "five six seven")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = D.contamination(odd, bench).collect()
    assert len(rows) == odd.count()
    three = [r for r in rows if r.doc_id == 3]
    assert [(r.n_hit, r.n_items, r.contaminated, len(r.spans)) for r in three] == [(3, 1, True, 1)] * 2
    assert [(r.n_hit, r.n_items) for r in rows if r.doc_id is None] == [(1, 0)]
    assert [(r.n_words, r.n_hit) for r in rows if r.doc_id in (1, 2)] == [(0, 0)] * 2
    assert D.contamination(odd.limit(0), bench).count() == 0
    none = D.contamination(odd, bench.limit(0)).agg({"n_hit": "sum"}).first()[0]
    assert none == 0
    kept = D.without_contaminated(odd, bench)
    assert kept.schema == odd.schema and kept.where("doc_id = 3").count() == 0


@pytest.mark.parametrize("share, bad", [(0.4, [1]), (0.5, []), (1 / 20, [1, 2]), (1.0, [])])
def test_any_share(spark, share, bad):
    docs = spark.createDataFrame([(1, "a b c d x x x x x x"), (2, "a b c d " + "x " * 30)], "doc_id long, text string")
    items = spark.createDataFrame([("i", "a b c d")], "item_id string, text string")
    found = D.contamination(docs, items, least_share=share)
    assert sorted(r.doc_id for r in found.where("contaminated").collect()) == bad
