import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pluvia.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """The root, and for each node the (before, after) siblings on its way up."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(place):
            run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
            paths[k].append((run[: at % 8], run[at % 8 + 1 :]))
            place[k] = at // 8
        nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def by_definition(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs.values():
        x.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [tree([leaf(r) for r in langs[k]]) for k in order]
    root, above = tree([t[0] for t in trees])
    found = []
    for k, (subroot, paths), top in zip(order, trees, above):
        for r, path in zip(langs[k], paths):
            path = path + top
            fold = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                fold = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for before, after in path:
                fold = H(*before, fold, *after)
            proof = H(*[x for before, after in path for x in (*before, *after)])
            found.append((r[0], leaf(r), subroot, root, proof, fold, fold == root))
    return sorted(found, key=str)


def manifest(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in M.manifest(df).collect()), key=str)


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (8, 9), (64, 65, 7), (600, 1, 512)])
def test_against_plain_trees(spark, sizes):
    rows = [
        (1000 * k + 3 * i, f"s{i % 3}", f"l{k}", i, f"Text {i}" if i % 5 else None) for k, n in enumerate(sizes) for i in range(n)
    ]
    assert manifest(spark, rows) == by_definition(rows)


def test_three_tiers(spark, monkeypatch):
    monkeypatch.setattr(M, "DIGITS", 1)
    monkeypatch.setattr(M, "BLOCK", M.FAN)
    rows = [(i, None, "en" if i % 3 else "é", i, f"Ab {i}") for i in range(700)]
    assert manifest(spark, rows) == by_definition(rows)


def test_more_than_eight_blocks(spark, monkeypatch):
    """The place of a block in the tier above has several digits: 700 leaves are 11 blocks of 64."""
    monkeypatch.setattr(M, "DIGITS", 2)
    monkeypatch.setattr(M, "BLOCK", M.FAN**2)
    rows = [(i, None, "en" if i % 50 else "fr", i, f"Ab {i}") for i in range(715)]
    assert manifest(spark, rows) == by_definition(rows)


def test_odd_rows(spark):
    same = [(7, "s", "en", 1, "Same")] * 20 + [(None, "s", "en", 1, "No id")] * 9 + [(7, "s", "en", 1, f"V{i}") for i in range(15)]
    rows = same + [
        (None, None, None, None, None), (1, "a", None, 2, ""), (-(2**63), "s", "en", 1, "Least"), (None, "s", "en", 2, "x"),
        (2, "b", "", 0, "É" * 30000), (3, "b", "en\x00", 0, "A"), (4, "b", "engl", 0, "AB"), (5, "b", "englisch-lang", 0, "z"),
        (6, "b", "englisch", 0, "Z"),
    ]
    assert manifest(spark, rows) == by_definition(rows)


def test_tables_and_plan(spark, odd, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in docs.collect()]
    more = docs.withColumns({"hash": F.lit(1), "block": F.lit(2)})
    assert sorted((tuple(r) for r in M.manifest(more).collect()), key=str) == by_definition(rows)
    clash = odd.selectExpr("*", "'s' as source", "1L as n_chars")
    assert M.manifest(clash).count() == odd.count() and M.manifest(clash.limit(0)).count() == 0
    nodes = spark.range(2000).selectExpr("string(id % 3) as key", "2000 + id % 2 as total", "id as number", "1 as times", "string(id) as hash", "id as item")
    plan = M.rolled_up(M._blocks(nodes))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
