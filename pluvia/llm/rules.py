"""Operator 11: quality rules, a table of thresholds compiled into one projection of built-in functions.

Every measure is a count over one whole text; a rule bounds a measure, or its ratio to another one, from below
or above for texts of enough words. All measures of a row are evaluated together, without shuffle, explode or
user function. A value that several measures need (the words, their windows) is bound once, as the variable
of a `transform` over a one-element array.

Cases: a null text is an empty one, all its counts are zero and it fails; texts of fewer than six words have
no repeated window; a line without a word is no line; equal rows are judged one by one; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.llm.texts import SPACE, bound

#: Symbols, and words that prose in any of the four languages is full of.
SYMBOLS = "#*$%&|<>"
MARKS = "!?"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au aux ce dans de des du elle en est et il la le les ou par pas pour que qui sur un une "
    "auf aus das dem den der die ein eine er es ist mit nicht sich sie und von zu "
    "al como con del el las lo los mas no para por se su y"
).split()
WINDOW = 5

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_capitals", "n_stops",
    "n_lines", "n_dotted",
)


@dataclass(frozen=True)
class Rule:
    """`least` * per <= measure <= `most` * per, for texts of `words` words and more; `per` None counts as one."""

    name: str
    measure: str
    per: str | None = None
    least: float | None = None
    most: float | None = None
    words: int = 0
    base: bool = False


#: The base rules, then length, symbol, stop-word and line ratios.
RULES = (
    Rule("few_words", "n_words", least=10, base=True),
    Rule("repeated_words", "n_repeat_words", per="n_words", most=0.2, base=True),
    Rule("word_length", "word_chars", per="n_words", least=2, most=15),
    Rule("symbols", "n_symbols", per="n_words", most=0.25),
    Rule("marks", "n_marks", per="n_words", most=0.4),
    Rule("capitals", "n_capitals", per="word_chars", most=0.5),
    Rule("stop_words", "n_stops", per="n_words", least=0.02, words=50),
    Rule("repeated_lines", "n_dup_lines", per="n_lines", most=0.4),
    Rule("dotted_lines", "n_dotted", per="n_lines", most=0.5),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, SPACE, " " * len(SPACE)), " "), lambda w: w != "")


def count_of(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def repeated(words: Column) -> Column:
    """How many words lie in a window that the text has twice or more."""

    def covered(places: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            places,
            zero,
            lambda a, p: F.struct((a.n + F.least(F.lit(WINDOW), p - a.last)).alias("n"), p.alias("last")),
            lambda a: a.n,
        )

    def twice(values: Column) -> Column:
        """The places of the values that occur twice or more. `values`: an array of (x, i)."""

        def found(ordered: Column) -> Column:
            return F.filter(
                ordered,
                lambda s, k: F.coalesce(F.get(ordered, k - 1)["x"] == s["x"], F.lit(False))
                | F.coalesce(F.get(ordered, k + 1)["x"] == s["x"], F.lit(False)),
            )

        return F.transform(bound(F.sort_array(values), found), lambda s: s["i"])

    def window(i: Column) -> Column:
        return F.array_join(F.slice(words, i + 1, WINDOW), " ")

    def exact(hashes: Column) -> Column:
        """Only windows with a hash that repeats are compared as texts."""
        some = twice(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        places = twice(F.transform(some, lambda i: F.struct(window(i).alias("x"), i.alias("i"))))
        repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(repeats, covered(F.sort_array(places))).otherwise(0)

    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) > WINDOW, bound(hashes, exact)).otherwise(0)


def measures(text: Column) -> Column:
    """A struct of all measures of a text that is not null."""

    def lines_with_words(lines: Column) -> Column:
        return F.filter(lines, lambda x: F.translate(x, SPACE, "") != "")

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))).alias("n_dotted"),
        )

    def is_stop(word: Column) -> Column:
        return F.translate(word, CAPITALS + ".,;:!?", CAPITALS.lower()).isin(STOP_WORDS)

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).alias("n_words"),
            F.length(F.array_join(words, "")).alias("word_chars"),
            repeated(words).alias("n_repeat_words"),
            F.size(F.filter(words, is_stop)).alias("n_stops"),
        )

    def of_all(w: Column, x: Column, rest: Column) -> Column:
        found = {
            "n_words": w["n_words"],
            "word_chars": w["word_chars"],
            "n_symbols": count_of(rest, SYMBOLS),
            "n_dup_lines": x["n_dup_lines"],
            "n_repeat_words": w["n_repeat_words"],
            "n_marks": count_of(rest, MARKS),
            "n_capitals": count_of(rest, CAPITALS),
            "n_stops": w["n_stops"],
            "n_lines": x["n_lines"],
            "n_dotted": x["n_dotted"],
        }
        return F.struct(*[found[m].cast("long").alias(m) for m in MEASURES])

    by_word = bound(words_of(text), of_words)
    by_line = bound(lines_with_words(F.split(text, "\n")), of_lines)
    # Most of a text are small letters and spaces; what is left without them is short.
    rest = F.translate(text, CAPITALS.lower() + " ", "")
    return bound(F.struct(by_word.alias("w"), by_line.alias("x"), rest.alias("rest")), lambda s: of_all(s["w"], s["x"], s["rest"]))


def verdicts(found: Column, rules: Sequence[Rule]) -> list[Column]:
    """Whether a row of measures fails, one column for each rule. Bounds count in hundredths, as whole numbers."""
    fails = []
    for r in rules:
        value, per = 100 * found[r.measure], found[r.per] if r.per else F.lit(1)
        low = value < round(100 * r.least) * per if r.least is not None else F.lit(False)
        high = value > round(100 * r.most) * per if r.most is not None else F.lit(False)
        fails.append((found["n_words"] >= r.words) & (low | high))
    return fails


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, the measures, base_failed, kept, failed) of every row; `failed` lists the names of the failed rules."""

    def row(found: Column) -> Column:
        fails = verdicts(found, rules)
        either = [reduce(lambda a, b: a | b, x, F.lit(False)) for x in ([f for f, r in zip(fails, rules) if r.base], fails)]
        names = F.filter(F.array(*[F.when(f, F.lit(r.name)) for f, r in zip(fails, rules)]), lambda x: x.isNotNull())
        return F.struct(
            *[found[m].alias(m) for m in MEASURES],
            either[0].alias("base_failed"),
            (~either[1]).alias("kept"),
            names.alias("failed"),
        )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    judged = df.select(F.col(id_col).cast("long").alias("doc_id"), bound(measures(text), row).alias("judged"))
    return judged.select("doc_id", "judged.*")
