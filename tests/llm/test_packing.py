import zlib
from collections import defaultdict

import numpy as np
import pytest

from pluvia.llm import packing as P


@pytest.fixture(scope="module")
def words():
    return P.WordTokens(P.public_tokenizer())


@pytest.mark.parametrize(
    "text",
    ["it's don't 'S ''s x'llq", "a—!b é!x H̱ İx", "<|endoftext|>hi <|startoftext|>", "tab\tnl\x1cx\x85y z", "12ab3.4,,..a",
     "", "̸=a ≠ ½ ² 中文 ABC's Σς \x01 x\x01y", "\x00\x7f!", "\u180e a\u2028b"],
)
def test_ids_equal_the_tokenizer(words, text):
    want = words.tokenizer.encode(text, add_special_tokens=False).ids
    got = words([b"other words", text.encode(), None])
    assert got[1].tolist() == want and len(got[2]) == 0


def check(rows, texts, words, capacity):
    want = {i: [*words.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            ids = np.array(want[i][r.start : r.start + r.length], "<u4")
            assert r.start == at and r.length > 0 and r.ids_crc32 == zlib.crc32(ids.tobytes())
            assert r.doc_tokens == len(want[i])
            at += r.length
        assert at == len(want[i])
    padding = total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / (padding + total)


def test_pieces(spark, words, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check(P.pack(docs).collect(), texts, words, 4096) < 0.01
    assert check(P.pack(docs, capacity=256).collect(), texts, words, 256) < 0.02


def test_odd_rows(spark, words, odd):
    once = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = P.pack(once).collect()
    check(rows, {r.doc_id: r.text for r in once.collect()}, words, 4096)
    assert [(r.length, r.doc_tokens) for r in rows if r.doc_id in (1, 2)] == [(1, 1), (1, 1)]
    assert P.pack(odd).where("doc_id = 3 and start = 0").count() == 2
    assert P.pack(odd.limit(0)).count() == 0
    kept = P.pack(once, keep_ids=True).where("doc_id = 3").orderBy("start").collect()
    assert [i for r in kept for i in r.ids][-1] == 2
