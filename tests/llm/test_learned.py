"""Held-out accuracy of the trained operators, and their odd cases."""

import itertools
import os

import numpy as np
import pytest

from pluvia.llm import language as L
from pluvia.llm import quality as Q
from pluvia.llm import toxicity as X

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def crc_rest(name, of):
    import zlib

    return zlib.crc32(str(name).encode()) % of


def test_language(spark, docs, odd):
    model = L.learn(docs)
    found = L.identify(docs, model=model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (found.held_out == found.doc_id.map(lambda i: crc_rest(i, 4) == 2)).all()
    held = found[found.held_out]
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all() and (model.weights == 0).mean() > 0.5
    rows = L.identify(odd, model=model).collect()
    assert len(rows) == odd.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (1, 2, 4))
    assert {r.lang_pred for r in rows if r.doc_id not in (1, 2, 4)} <= set(model.languages)
    kept = L.keep_identified(odd, model=model, least_score=0.0)
    assert kept.schema == odd.schema and kept.where("doc_id in (1, 2, 4)").count() == 0
    assert kept.count() == odd.count() - 3
    untold = L.identify(odd.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r.lang_pred for r in untold.collect()} == {"und"}
    assert L.identify(odd.limit(0)).count() == 0


def test_a_text_is_judged_alone(docs):
    texts = [r.text.encode() for r in docs.limit(40).collect()] + [b"", None, b"a", b"ab", b"!a!"]
    together = list(L.features(texts))
    for text, row in zip(texts, together):
        alone = next(L.features([text]))
        assert (row is None and alone is None) or all((x == y).all() for x, y in zip(row, alone))


def test_field_marginals(rng):
    tokens = X.Tokens([b"a b c. d a", b"", None, b"b c\na a a b"])
    field = X.Field([[b"a", b"b", b"c"], [], [], []])
    field.own[0], field.beside, field.moves = rng.normal(size=4), rng.normal(size=(2, 4)), rng.normal(size=(2, 2))
    u = np.log(field.unary(tokens, field.coded(tokens)))
    p = field.marginals(tokens)
    for s, n in zip(tokens.chain_start.tolist(), tokens.chain_size.tolist()):
        total, toxic = 0.0, np.zeros(n)
        for states in itertools.product((0, 1), repeat=n):
            w = np.exp(u[s : s + n] @ states + sum(field.moves[a, b] for a, b in zip(states, states[1:])))
            total += w
            toxic += w * np.array(states)
        assert np.allclose(toxic / total, p[s : s + n])


def test_toxicity(spark, docs, labels, odd):
    field = X.learn(docs, labels)
    found = X.toxicity(docs, labels, field=field).join(labels, "doc_id").toPandas()
    assert (found.held_out == found.doc_id.map(lambda i: crc_rest(i, 3) == 1)).all()
    held = found[found.held_out]
    toxic = held.toxic == 1
    assert held.score.between(0, 1).all() and ((held.score >= 0.7) == (held.predicted == 1)).all()
    assert held.predicted[toxic].mean() > 0.7 and held.predicted[~toxic].mean() < 0.05
    assert held.score[toxic].rank(pct=True).mean() > held.score[~toxic].rank(pct=True).mean()
    text = docs.where("doc_id = %d" % found[found.predicted == 1].doc_id.iloc[0]).first().text
    spans = X.detect(docs.where(docs.text == text), field).first().spans
    assert all(0 <= s.start < s.end <= len(text) and not text[s.start : s.end].isspace() for s in spans)
    rows = X.detect(odd, field).collect()
    assert len(rows) == odd.count() and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert X.detect(odd.limit(0), field).count() == 0
    none = X.toxicity(odd, labels.limit(0))
    assert {r.score for r in none.collect()} == {0.0}


def test_quality(spark, docs, labels, odd):
    models = Q.learn(docs)
    found = Q.classify(docs, models=models).join(labels, "doc_id").toPandas()
    good = found.quality == 1
    assert found.keep[good].mean() > 0.98 and (~found.keep[~good]).mean() > 0.9
    assert sum(models[0].counts.values()) == docs.count()
    rows = Q.classify(odd, models=models).collect()
    assert len(rows) == odd.count()
    assert all(not r.keep and r.score == 0 for r in rows if r.doc_id in (1, 2))
    assert Q.classify(odd).count() == odd.count() and Q.classify(odd.limit(0)).count() == 0


def test_label_model(rng):
    truth = rng.random(5000) < 0.8
    right = [0.9, 0.8, 0.95, 0.7]
    votes = [np.where(rng.random(5000) < a, truth, ~truth) for a in right]
    patterns, n = np.unique(["".join("-+"[int(v[i])] for v in votes) for i in range(5000)], return_counts=True)
    model = Q.LabelModel(dict(zip(patterns.tolist(), n.tolist())))
    assert abs(model.prior[1] - truth.mean()) < 0.05
    said = np.array([model.posterior["".join("-+"[int(v[i])] for v in votes)] > 0.5 for i in range(5000)])
    assert (said == truth).mean() > 0.93


def test_samples_are_bounded(spark):
    """Rows without ids, or under one id, do not all get into a sample."""
    from pluvia.llm import texts as T

    for ident in ("cast(null as long)", "7L"):
        rows = spark.range(10_000).selectExpr(f"{ident} as doc_id", "concat('text number ', id, ' of many words') as text")
        assert T.sample_rows(rows, 100).count() == 100
    mixed = spark.range(10_000).selectExpr("case when id % 3 > 0 then id end as doc_id", "string(id) as text")
    assert T.sample_rows(mixed, 100).count() <= 200


def test_language_without_ids(spark):
    """The same model each time, from a bounded sample, when no row has an id."""
    words = "case when id % 2 = 0 then 'the house of the old king' else 'das haus und der alte mann' end"
    rows = spark.range(4000).selectExpr("cast(null as long) as doc_id", f"concat({words}, ' ', id) as text", "if(id % 2 = 0, 'en', 'de') as lang")
    one, two = (L.learn(rows, most_rows=50) for _ in range(2))
    texts = [b"the old house", b"der alte koenig", b"x"]
    assert L._predictions(one, texts) == L._predictions(two, texts)
    assert [x[0] for x in L._predictions(one, texts)[:2]] == ["en", "de"]
