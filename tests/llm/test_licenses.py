import re

from pluvia.llm import licenses as L


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(w):
    return [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]


def by_definition(text, least=0.8, slack=0.1):
    """The licences of which some window holds enough shingles."""
    own, found = shingles(words(text)), set()
    for name, body in L.TEMPLATES.items():
        t = shingles(words(body))
        room = round(slack * len(t))
        for p in range(len(own)):
            window = own[max(0, p - room) : p + len(t) + room]
            if len(set(window) & set(t)) >= least * len(set(t)):
                found.add(name)
    return found


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in L.license_matches(docs).collect():
        assert {m.license for m in r.matches} == by_definition(texts[r.doc_id])


def test_edits_and_odd_rows(spark, odd):
    grant = L.TEMPLATES["MIT-grant"]
    texts = ["x y " + L.TEMPLATES["MIT"] + " foo bar " + L.TEMPLATES["MIT"], "été " + grant.replace("any person", "ANY  person"),
             grant.replace("copy", "copies"), grant.replace("hereby", "now").replace("deal", "work"), "Released under the MIT",
             L.TEMPLATES["GPL-notice"][5:], "all rights reserved"]
    rows = sorted(L.license_matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    for r, text in zip(rows, texts):
        assert {m.license for m in r.matches} == by_definition(text)
    assert [(m.license, m.start, m.end) for m in rows[0].matches] == [("MIT", 2, 7), ("MIT", 9, 14)]
    found = L.license_matches(odd).collect()
    assert len(found) == odd.count() and all(r.matches == [] for r in found)
    assert L.license_matches(odd.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, sf):
    found = L.license_matches(spark.read.parquet(f"{sf}/documents.parquet"))
    text = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", text)
