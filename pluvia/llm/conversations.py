"""Operator 13: repair of conversation structure, by a suffix-shared automaton of role and fault signatures.

A row is one symbol: its role's initial, whether it is truncated, whether it has to go. A conversation is the
word of its symbols. Distinct words, sorted by their ends, form a trie read from the end, in which a node is a
suffix and is visited once for all words that end in it; nodes with equal costs ahead and equal choices are one
state of the minimal automaton. A node holds, for each state of the grammar `(s?(ua)+)?`, the least cost from
there to the end and the first edit of the best audit, so a word's audit is read off its own path. From one
grammar state all edits have different initials: the least initial among the cheapest gives the least audit.

Rows of a conversation run through one task in order, since a SHA-256 of the whole cannot be made from parts;
they stream by, and only the conversation's word and edits (a byte a row) are held. Duplicates are found
before, on keys of conversation, role and text, so a long conversation is spread there.

Cases: a null role or text is one space, so such a text is blank and such a role has no place in the grammar
(nor has an empty role or one with another initial); a null conversation or turn prints as one space in the
checksum, and null conversations are one group; rows of equal turns are ordered by role and text; rows that
repeat under one turn are duplicates; a conversation without rows after damage has zeros, no audit and the
hash of nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.llm.texts import SPACE
from pluvia.operators.joins import attach
from pluvia.operators.storage import materialise

ORDER = ("turn", "role", "text", "copy")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")

#: Grammar states: nothing yet, after s, after u, after a. Where a kept s, u or a leads; where a new row leads.
STATES = 4
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
DELETE, REROLE, INSERT, CUT_SHORT = 2, 1, 5, 5


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copy): the rows after damage by the checksum of `conv:turn`."""
    conv_id, at = F.col(conv).cast("long"), F.col(turn).cast("long")
    as_text = [F.coalesce(x.cast("string"), F.lit(" ")) for x in (conv_id, at, F.col(role), F.col(text))]
    code = F.crc32(F.concat(as_text[0], F.lit(":"), as_text[1]).cast("binary")) % 20
    new_text = F.when(code == 1, "").when(code == 2, F.translate(as_text[3], ".!?", "")).otherwise(as_text[3])
    rows = df.select(
        conv_id.alias("conv"),
        at.alias("turn"),
        F.when(code == 4, "user").otherwise(as_text[2]).alias("role"),
        new_text.alias("text"),
        code.alias("code"),
    )
    copies = F.sequence(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1))
    return rows.where("code != 0").select("conv", "turn", "role", "text", F.explode(copies).alias("copy"))


def faulty(rows: DataFrame) -> DataFrame:
    """The rows and their first fault: blank, duplicate, truncated or null."""
    key = ["conv", "role", "text"]
    order = [F.asc_nulls_first("turn"), "copy"]
    again = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) > 1
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    fault = (
        F.when(F.translate("text", SPACE, "") == "", "blank")
        .when(again, "duplicate")
        .when(~last.isin(".", "!", "?"), "truncated")
    )
    return rows.withColumn("fault", fault)


def symbol(role: Column, fault: Column) -> Column:
    """s, u, a or x for another role, in capitals if truncated; - if the row has to go."""
    first = F.substring(role, 1, 1)
    own = F.when(first.isin("s", "u", "a"), first).otherwise("x")
    gone = fault.isin("blank", "duplicate")
    return F.when(gone, "-").when(fault == "truncated", F.upper(own)).otherwise(own)


def in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Whole conversations in one partition each, their rows in order."""
    keys = [F.asc_nulls_first(c) for c in ("conv", *first, *ORDER)]
    return rows.repartition("conv").sortWithinPartitions(*keys)


def _profile_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of rows of a conversation: its counts and its word."""
    names = ["conv", *COUNTS, "word"]
    kinds = [pa.int64()] * 6 + [pa.string()]
    done: list[list] = [[] for _ in names]
    now, count, word = None, None, bytearray()

    def close() -> None:
        low, high, turns = count["low"], count["high"], count["turns"]
        values = [0 if low is None else high - low + 1 - turns, *[count[c] for c in COUNTS[1:]]]
        for column, value in zip(done, [now[0], *values, word.decode()]):
            column.append(value)

    for batch in batches:
        for conv, turn, first, fault, sign in zip(*[c.to_pylist() for c in batch.columns]):
            if now != (conv,):
                if now:
                    close()
                now, word = (conv,), bytearray()
                count = dict.fromkeys(COUNTS, 0) | {"low": None, "high": None, "turns": 0, "before": None}
            if sign is None:
                continue
            if turn is not None and turn != count["high"]:
                count["low"] = turn if count["low"] is None else count["low"]
                count["high"], count["turns"] = turn, count["turns"] + 1
            if count["before"] is not None and count["before"] + first not in ("su", "ua", "au"):
                count["illegal"] += 1
            if fault:
                count[fault] += 1
            count["before"] = first
            word += sign.encode()
        if len(done[0]) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(done, kinds)], names)
            done = [[] for _ in names]
    if now:
        close()
    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(done, kinds)], names)


def profiles(rows: DataFrame, all_convs: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, word) of each conversation, those without rows as well."""
    signed = rows.select(*("conv", *ORDER), "fault", symbol(F.col("role"), F.col("fault")).alias("sign"))
    both = in_order(signed.unionByName(all_convs, allowMissingColumns=True))
    thin = both.select("conv", "turn", F.substring("role", 1, 1).alias("first"), "fault", "sign")
    kinds = ", ".join(f"{c} long" for c in ("conv", *COUNTS))
    return thin.mapInArrow(_profile_runs, f"{kinds}, word string")


class Automaton:
    """States of the minimal automaton: costs ahead for each grammar state, less the least of them, and the choices."""

    def __init__(self) -> None:
        self.states: dict[tuple, int] = {}
        self.costs: list[tuple[int, ...]] = []
        self.choices: list[str] = []
        self.moves: dict[tuple[str, int], tuple[int, int]] = {}
        self.end = self._state((0, 2 * INSERT, INSERT, 0), "-II-")[0]

    def _state(self, ahead: tuple[int, ...], choices: str) -> tuple[int, int]:
        least = min(ahead)
        key = (tuple(x - least for x in ahead), choices)
        if key not in self.states:
            self.states[key] = len(self.costs)
            self.costs.append(key[0])
            self.choices.append(choices)
        return self.states[key], least

    def before(self, sign: str, state: int) -> tuple[int, int]:
        """The state one symbol nearer to the start, and by how much the least cost grows."""
        if (sign, state) not in self.moves:
            after, late = self.costs[state], CUT_SHORT * sign.isupper()
            options: list[dict[str, int]] = []
            for s in range(STATES):
                own = {"D": DELETE + after[s]}
                if sign != "-":
                    own["R"] = REROLE + late + after[NEXT[s]]
                    to = KEEP.get(sign.lower(), {}).get(s)
                    if to is not None:
                        own["K"] = late + after[to]
                options.append(own)
            best = [min(x.values()) for x in options]
            for _ in range(STATES):
                best = [min(b, INSERT + best[NEXT[s]]) for s, b in enumerate(best)]
            for s, own in enumerate(options):
                own["I"] = INSERT + best[NEXT[s]]
            choices = "".join(min(k for k, c in own.items() if c == best[s]) for s, own in enumerate(options))
            self.moves[sign, state] = self._state(tuple(best), choices)
        return self.moves[sign, state]


def step(state: int, sign: str, edit: str) -> int:
    """The grammar state after an edit."""
    if edit == "D":
        return state
    return KEEP[sign.lower()][state] if edit == "K" else NEXT[state]


def _audits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words sorted by their ends: the nodes of the common end of two neighbours are kept."""
    automaton = Automaton()
    path, totals, before = [automaton.end], [0], ""
    for batch in batches:
        costs, audits = [], []
        for word in batch.column(0).to_pylist():
            back = word[::-1]
            shared = next((i for i, (a, b) in enumerate(zip(back, before)) if a != b), min(len(back), len(before)))
            del path[shared + 1 :], totals[shared + 1 :]
            for sign in back[shared:]:
                state, more = automaton.before(sign, path[-1])
                path.append(state)
                totals.append(totals[-1] + more)
            before, audit, state, left = back, [], 0, len(back)
            costs.append(totals[-1] + automaton.costs[path[-1]][0])
            while (edit := automaton.choices[path[left]][state]) != "-":
                sign = back[left - 1] if left else ""
                state = step(state, sign, edit)
                left -= edit != "I"
                audit.append(edit)
            audits.append("".join(audit))
        columns = [batch.column(0), pa.array(costs, pa.int64()), pa.array(audits, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["word", "cost", "audit"])


def audits(words: DataFrame) -> DataFrame:
    """(word, cost, audit) of distinct words."""
    back = F.reverse("word")
    return words.repartitionByRange(back).sortWithinPartitions(back).mapInArrow(_audits_of, "word string, cost long, audit string")


def _repaired_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams the edits of a conversation, then its rows; gives the conversation and the digest of what is left."""
    convs: list[int | None] = []
    digests: list[str] = []
    whole, edits, at, state, empty = None, "", 0, 0, True

    def add(role: str, text: str) -> None:
        nonlocal empty
        whole.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
        empty = False

    def insert() -> None:
        nonlocal at, state
        while edits[at : at + 1] == "I":
            state = NEXT[state]
            add(ROLE[state], "")
            at += 1

    def close() -> None:
        if whole:
            insert()
            digests.append(whole.hexdigest())

    for batch in batches:
        for conv, role, text, audit in zip(*[c.to_pylist() for c in batch.columns]):
            if audit is not None:
                close()
                convs.append(conv)
                whole, edits, at, state, empty = hashlib.sha256(), audit, 0, 0, True
                continue
            insert()
            edit, at = edits[at], at + 1
            if edit != "D":
                state = step(state, role[:1], edit)
                add(role if edit == "K" else ROLE[state], text)
        if len(digests) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(convs[:-1], pa.int64()), pa.array(digests)], ["conv", "sha"])
            convs, digests = convs[-1:], []
    close()
    yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(digests, pa.string())], ["conv", "sha"])


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation."""
    rows = materialise(faulty(damaged(df, conv, turn, role, text)), "damaged")
    all_convs = df.select(F.col(conv).cast("long").alias("conv")).distinct()
    found = materialise(profiles(rows, all_convs), "profiles")
    known = audits(materialise(found.select("word").distinct(), "words"))
    judged = materialise(attach(found, known, ["word"], spread_by="conv", how="inner"), "judged")
    scripts = judged.select("conv", "audit")
    both = in_order(rows.drop("fault").withColumn("row", F.lit(1)).unionByName(scripts.withColumn("row", F.lit(0)), True), "row")
    hashes = both.select("conv", "role", "text", "audit").mapInArrow(_repaired_runs, "conv long, sha string")
    same = judged["conv"].eqNullSafe(hashes["conv"])
    return judged.join(hashes, same).select(
        judged["conv"].alias("conv_id"), *COUNTS, "cost", "audit", hashes["sha"].alias("repaired_sha256")
    )
