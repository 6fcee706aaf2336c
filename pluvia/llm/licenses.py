"""Operator 6: licence notices in texts, with DataFrame functions only.

Texts and templates are words (runs of letters and digits, in small letters) and five-word shingles. For
each template `hashes` min-wise hash functions give its band values, one value a band. A window of text can
have the same value in a band only if it holds the shingle that is the template's minimum there, so bands are
looked up the other way round: each text shingle is hashed once and compared with the templates' minima, and
only the windows around those are built, where their band values are compared and the containment of the
template's shingles is then counted exactly. A window with a containment of `least` has a Jaccard similarity
of at least `least` / (2.2 - `least`) with the template, the slack at both ends counted, and is missed with
probability of at most (1 - similarity) ** hashes, about 0.1 % for the defaults. For an unchanged notice the
similarity is at least 1 / 1.2, so that a miss has odds of about one to two million.

Everything happens within a document's row: nothing is shuffled, joined or handed to Python.

Cases: null, empty and short texts have no matches; equal rows are scanned one by one; a notice that stands
several times gives several matches; overlapping windows of one template that meet are one match; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pluvia.llm import texts as T

#: Notices to look for.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the "
    "GNU General Public License as published by the Free Software Foundation",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files, to deal in the Software without restriction",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met",
    "Apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
}

_WORDS = r"filter(split(lower(text), '[^\\p{L}\\p{N}]+'), w -> w != '')"
_SHINGLES = (
    "case when size(words) >= 5 then transform(sequence(0, size(words) - 5), "
    "i -> xxhash64(words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4])) else array() end"
)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _template_literals(spark: SparkSession, templates: dict[str, str], hashes: int, slack: float) -> tuple[str, str, list[int]]:
    """SQL literals: the templates, their minima by template and place, and the hashes of all minima."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string").coalesce(1)
    rows = rows.selectExpr("name", f"{_WORDS} as words").selectExpr("name", "words", f"{_SHINGLES} as h")
    rows = rows.selectExpr("name", "words", "h", f"transform(sequence(1, {hashes}), k -> array_min(transform(h, x -> xxhash64(x, k)))) as mins", f"transform(sequence(1, {hashes}), k -> array_min(transform(h, (x, i) -> named_struct('m', xxhash64(x, k), 'x', x, 'i', i)))) as least")
    entries, minima, anchors = [], [], set()
    for number, r in enumerate(rows.orderBy("name").collect()):
        if not r.h:
            raise ValueError(f"template {r.name} has fewer than five words")
        shingles = sorted({" ".join(r.words[i : i + 5]) for i in range(len(r.h))})
        room = round(slack * len(r.h))
        mins = ", ".join(f"{m}L" if m > -(2**63) else f"({m + 1}L - 1L)" for m in r.mins)
        entries.append(f"named_struct('name', {_quoted(r.name)}, 'n', {len(r.h)}, 'room', {room}, 'mins', array({mins}), 'shingles', array({', '.join(map(_quoted, shingles))}))")
        for x, i in sorted({(s.x, s.i) for s in r.least}):
            anchors.add(x)
            minima.append(f"named_struct('h', {x}L, 't', {number}, 'i', {i})")
    return f"array({', '.join(entries)})", f"array({', '.join(minima)})", sorted(anchors)


def license_matches(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] = TEMPLATES,
    least: float = 0.8,
    hashes: int = 8,
    slack: float = 0.1,
) -> DataFrame:
    """(doc_id, matches) of every row; a match has the licence, its first word and the end (exclusive)."""
    known, minima, anchors = _template_literals(df.sparkSession, templates, hashes, slack)
    among = ", ".join(f"{a}L" for a in anchors)
    rows = T.pick(df, id_col, text_col).selectExpr("doc_id", f"{_WORDS} as words")
    rows = rows.selectExpr("doc_id", "words", f"{_SHINGLES} as h")
    # Where a shingle is some template's minimum; windows begin so that it has the same place in them.
    rows = rows.selectExpr(
        "doc_id",
        "words",
        "h",
        f"case when arrays_overlap(h, array({among})) then "
        f"filter(transform(h, (x, i) -> named_struct('x', x, 'i', i)), s -> s.x in ({among})) end as hits",
    )
    rows = rows.selectExpr(
        "doc_id",
        "words",
        "h",
        "array_distinct(flatten(transform(coalesce(hits, array()), s -> transform("
        f"filter({minima}, m -> m.h = s.x), m -> named_struct('t', m.t, 'at', s.i - m.i))))) as places",
    )
    window = "greatest(p.at - d.room, 0) + 1, d.n + d.room + least(d.room, p.at)"
    rows = rows.selectExpr(
        "doc_id",
        "words",
        f"transform(filter(transform(places, q -> named_struct('p', q, 'd', {known}[q.t])), "
        f"s -> s.p.at > -s.d.n), s -> named_struct('p', named_struct('t', s.p.t, 'at', greatest(s.p.at, 0)), 'd', s.d, "
        f"'own', slice(h, {window.replace('p.', 's.p.').replace('d.', 's.d.').replace('s.p.at', 'greatest(s.p.at, 0)')}))) as windows",
    )
    rows = rows.selectExpr(
        "doc_id",
        "words",
        "filter(windows, w -> size(w.own) > 0 and exists(sequence(1, size(w.d.mins)), "
        "k -> array_min(transform(w.own, x -> xxhash64(x, k))) = w.d.mins[k - 1])) as windows",
    )
    shingles = (
        "transform(sequence(1, size(w.own)), i -> concat_ws(' ', slice(words, greatest(w.p.at - w.d.room, 0) + i, 5)))"
    )
    rows = rows.selectExpr(
        "doc_id",
        f"filter(windows, w -> size(array_intersect({shingles}, w.d.shingles)) >= {least} * size(w.d.shingles)) as good",
    )
    matched = "transform(good, w -> named_struct('license', w.d.name, 'start', w.p.at, 'end', w.p.at + w.d.n + 4))"
    rows = rows.selectExpr("doc_id", f"array_sort(array_distinct({matched})) as found")
    # Places of one template that overlap are one match: keep those that begin after the end of the one before.
    return rows.selectExpr(
        "doc_id",
        "aggregate(found, cast(array() as array<struct<license: string, start: int, end: int>>), (kept, f) -> "
        "case when size(kept) > 0 and element_at(kept, -1).license = f.license and element_at(kept, -1).end > f.start "
        "then kept else concat(kept, array(f)) end) as matches",
    )
