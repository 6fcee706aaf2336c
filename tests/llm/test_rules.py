import re

import pytest

from pluvia.llm import rules as R


def by_definition(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": len(words) < 10 or 100 * len(covered) > 20 * len(words),
    }


TEXTS = [
    None, "", " \n\t\x0b\x0c\r ", "one", "a b c d e", "a b c d e a b c d e", "a a a a a a a", "a b c d e f a b c d e g b c d e g",
    "x\n\nx\nx \n y\ny", "é ü \U0001f600 # * $ % & | < >", "the cat and the dog of the house went to the sea in a boat on a day",
    "SHOUT THE WORDS " * 4, "w " * 3000, " ".join(f"w{i % 700}" for i in range(3000)), "x!! y!! z?? " * 6, "1\n2\n3\n" * 5,
]


def test_base_measures(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = {r.doc_id: r for r in R.judge(rows).collect()}
    for i, text in enumerate(TEXTS):
        want = by_definition(text)
        assert {k: found[i][k] for k in want} == want, text
        assert not (found[i].kept and found[i].base_failed)
        assert found[i].kept == (not found[i].failed)


@pytest.mark.parametrize("text, name", [
    ("the one of the ten words is in the text here", None),
    ("short", "few_words"),
    ("## ** $$ %% && || << >> the of and to in it", "symbols"),
    ("THE WORDS OF THIS TEXT ARE ALL CAPITALS AND THEY SHOUT", "capitals"),
    ("stop! the! words! of! all! here! are! marked! as! loud!", "marks"),
    ("a b c d e f g h i j k l", "word_length"),
    ("same line of the text\n" * 2 + "same line of the text\nother one", "repeated_lines"),
    ("one two...\nthree four...\nfive six...\nseven eight nine ten", "dotted_lines"),
    (" ".join(f"wort{i}x" for i in range(60)), "stop_words"),
])
def test_each_rule(spark, text, name):
    row = R.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert name in row.failed if name else row.kept


def test_one_projection(spark, odd):
    judged = R.judge(odd)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Python", "Generate", "Join"))
    assert judged.count() == odd.count() and R.judge(odd.limit(0)).count() == 0
    longest = judged.where("doc_id = 6").first()
    assert longest.n_words == longest.n_repeat_words == 100000 and longest.base_failed
