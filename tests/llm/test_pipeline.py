import zlib
from collections import defaultdict

import __spark_entry__ as entry
import corpus_pipeline as P
from pluvia.llm import credentials, language
from pluvia.llm.decontam import words_of
from pluvia.operators.storage import materialise

from test_similar import kept_by_definition


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and len(P.STAGES) == 5


def test_stages(spark, sf):
    """Each stage on its own input against a plain version of it."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, docs.collect()
    stage = dict(P.STAGES)

    kept = materialise(stage["language_id"](spark, docs, sf))
    assert kept.columns == columns
    lettered = [r.doc_id for r in rows if any(c.isalpha() for c in r.text or "")]
    scores = {r.doc_id: r.score for r in language.identify(docs).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in lettered if scores[i] >= 0.3)

    docs, rows = kept, kept.collect()
    kept = materialise(stage["near_duplicates"](spark, docs, sf))
    assert kept.columns == columns
    assert sorted(r.doc_id for r in kept.collect()) == kept_by_definition([(r.doc_id, r.text) for r in rows])

    docs, rows = kept, kept.collect()
    kept = materialise(stage["decontamination"](spark, docs, sf))
    assert kept.columns == columns
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words_of(r.text)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    clean = []
    for r in rows:
        w, hit = words_of(r.text), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append(r.doc_id)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(clean)

    docs, rows = kept, kept.collect()
    kept = materialise(stage["secret_scan"](spark, docs, sf))
    assert kept.columns == columns and kept.count() == len(rows)
    new = {r.doc_id: r for r in kept.collect()}
    for r in rows:
        assert new[r.doc_id].n_chars == len(new[r.doc_id].text)
        assert not credentials.base_spans(new[r.doc_id].text.encode())
        if not credentials.base_spans(r.text.encode()) and "[secret]" not in new[r.doc_id].text:
            assert new[r.doc_id].text == r.text

    pieces = defaultdict(int)
    for r in stage["packing"](spark, kept, sf).collect():
        pieces[r.doc_id] += r.length
    assert set(pieces) == set(new) and zlib.crc32(b"") == 0


def test_odd_rows_pass_all_stages(spark, odd, sf):
    docs = odd.select("doc_id", "text", "lang").selectExpr("*", "'s' as source", "1L as n_chars")
    for docs_ in (docs, docs.limit(0)):
        for name, stage in P.STAGES:
            docs_ = materialise(stage(spark, docs_, sf), name)
        assert docs_.columns[0] == "doc_id"


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 0


def test_stages_hand_python_short_batches(spark, sf):
    """Also when a stage's result is written after the stage has returned."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, docs = spark.conf.get(name), spark.read.parquet(f"{sf}/documents.parquet")
    try:
        for stage in (P.language_id, P.secret_scan, P.pack):
            spark.conf.set(name, 10_000)
            rows = stage(spark, docs.limit(50), sf)
            assert int(spark.conf.get(name)) <= 1_000 and rows.count() > 0
    finally:
        spark.conf.set(name, before)
