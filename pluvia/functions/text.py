"""Text expressions: numbers, headers, station codes, announced criteria."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented capitals and their base letters.
ACCENTED = "ÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
UNACCENTED = "AAAAAAEEEEIIIIOOOOOUUUUCNY"

STATION_CODE = r"_([A-Z]\d{3})_"


def _first_group(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def decimal_comma(text: Column) -> Column:
    """Number with a decimal comma and stray semicolons; NULL when it is no number."""
    cleaned = F.trim(F.replace(F.replace(text, F.lit(";"), F.lit("")), F.lit(","), F.lit(".")))
    number = cleaned.try_cast("double")
    return F.when(F.isnan(number), F.lit(None)).otherwise(number)


def canonical_header(name: Column) -> Column:
    """Upper case, accents folded, characters outside ASCII dropped, trimmed."""
    folded = F.translate(F.upper(F.trim(name)), ACCENTED, UNACCENTED)
    return F.trim(F.regexp_replace(folded, r"[^\x00-\x7F]", ""))


def letters_only(name: Column) -> Column:
    folded = F.translate(F.upper(F.trim(name)), ACCENTED, UNACCENTED)
    return F.regexp_replace(folded, "[^A-Z]", "")


def station_code(path: Column) -> Column:
    """Station code in a file name such as ``..._A801_...``; NULL when there is none."""
    base = F.regexp_extract(F.upper(path), r"([^/]*)$", 1)
    return _first_group(base, STATION_CODE)


UNIT = "\u241f"  # stands for the wanted unit among the words


def _amounts(text: Column, unit: str, links: tuple[str, ...]) -> Column:
    """The announced amounts that end with a unit, in order: the lower number, and whether `entre` opens it.

    The sentence becomes words, with a gap between letters and digits and around each link; before a unit
    stands one number, or two with a link between them.
    """
    lowered = F.regexp_replace(F.lower(text), unit, f" {UNIT} ")
    spaced = F.regexp_replace(lowered, "(?<=[0-9])(?=[a-z])|(?<=[a-z])(?=[0-9])", " ")
    for link in links:
        if not link.isalpha():
            spaced = F.replace(spaced, F.lit(link), F.lit(f" {link} "))

    def number(words: Column, i: Column) -> Column:
        digits = F.regexp_extract(F.get(words, i), r"[0-9]+([.,][0-9]+)?$", 0)
        return F.replace(digits, F.lit(","), F.lit(".")).try_cast("double")

    def amount(words: Column, word: Column, i: Column) -> Column:
        linked = F.get(words, i - 2).isin(*links) & number(words, i - 3).isNotNull()
        low = F.when(linked, number(words, i - 3)).otherwise(number(words, i - 1))
        opened = linked & F.coalesce(F.get(words, i - 4).endswith("entre"), F.lit(False))
        return F.when((word == UNIT) & number(words, i - 1).isNotNull(), F.struct(low.alias("low"), opened.alias("entre")))

    # Through an array of one, the words are split once and not again for each word.
    found = F.transform(
        F.array(F.split(F.trim(spaced), r"\s+")),
        lambda words: F.filter(F.transform(words, lambda w, i: amount(words, w, i)), lambda a: a.isNotNull()),
    )
    return F.get(found, F.lit(0))


def rain_criterion(text: Column) -> Column:
    """Lowest announced daily rain in mm; a range with `entre` goes first, hourly amounts never count."""
    amounts = _amounts(text, r"mm\s*/\s*dia", ("e", "a"))
    ranges = F.filter(amounts, lambda a: a["entre"])
    return F.coalesce(F.get(ranges, F.lit(0))["low"], F.get(amounts, F.lit(0))["low"])


def gust_criterion(text: Column) -> Column:
    """Lowest gust of the first announcement, km/h converted to m/s."""
    return F.get(_amounts(text, r"km\s*/\s*h", ("-", "e", "a")), F.lit(0))["low"] / 3.6


def code_count(text: Column) -> Column:
    """Number of non-blank entries in a comma separated list."""
    return F.size(F.filter(F.split(text, ","), lambda c: F.trim(c) != "")).cast("long")
