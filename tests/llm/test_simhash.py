import itertools

import numpy as np
import pytest

from pluvia.llm import simhash as S
from pluvia.llm.components import components


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def by_definition(text):
    import xxhash

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("text", [None, "", "one", "One TWO", "a b c", "a b c d a b c d", " x\t\n y\x0bé Z ", "w " * 500])
def test_fingerprint(text):
    own = S.fingerprint(None if text is None else text.encode())
    assert own & (2**64 - 1) == by_definition(text)


@pytest.mark.parametrize("crowd", [2, 64])
def test_links_lose_nothing(spark, crowd):
    rng = np.random.default_rng(3)
    prints = {0, 3, -1}
    for base in rng.integers(-(2**63), 2**63 - 1, 25).tolist():
        prints.add(base)
        for _ in range(6):
            x = np.array([base], np.int64).view(np.uint64)
            for bit in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= np.uint64(1) << np.uint64(bit)
            prints.add(int(x.view(np.int64)[0]))
    hub = next(iter(prints))
    prints |= {hub ^ (1 << i) for i in range(40)}
    near = [(a, b) for a, b in itertools.combinations(sorted(prints), 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 2]
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = [tuple(r) for r in S.links(frame, crowd).collect()]
    assert {tuple(sorted(p)) for p in found} <= set(near)
    assert roots(prints, found) == roots(prints, near)


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (2, 3), (9, 7), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    chain = [e for e in chain if e[0] != e[1]]  # an edge to itself joins nothing
    want = roots({n for e in chain for n in e}, chain)
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_documents(spark, odd):
    rows = S.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    own = {r.doc_id: r for r in rows}
    assert own[1].fingerprint == "0" * 16 and own[1].component_id == own[2].component_id == 1
    assert [r.component_id for r in rows if r.doc_id == 3] == [3, 3]
    for r in odd.collect():
        assert r.doc_id is None or own[r.doc_id].fingerprint == format(by_definition(r.text), "016x")
    assert S.near_duplicates(odd.limit(0)).count() == 0


def test_one_of_each(spark, odd):
    kept = S.one_of_each(odd)
    assert kept.schema == odd.schema
    ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect())
    components_ = {r.component_id for r in S.near_duplicates(odd.where("doc_id is not null")).collect()}
    assert ids == sorted(components_ | {-1})
