import hashlib
import itertools
import re
import zlib

import pytest

from pluvia.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    for conv, turn, role, text in rows:
        show = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        code = zlib.crc32(f"{show[0]}:{show[1]}".encode()) % 20
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", show[3]) if code == 2 else show[3]
            yield from [(conv, turn, "user" if code == 4 else show[2], text)] * (2 if code == 3 else 1)


def faults(rows):
    seen = set()
    for _, _, role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        yield "blank" if not shown else "duplicate" if (role, text) in seen else None if shown[-1] in ".!?" else "truncated"
        seen.add((role, text))


def cheapest(rows, marks):
    """All (cost, audit, repaired) by a search over positions, grammar prefixes and edits."""
    best = {(0, ""): (0, "", ())}
    todo = [(0, "")]
    results = []
    grammar = re.compile("(s?(ua)*u?)?$")
    while todo:
        place, made = min(todo, key=lambda x: best[x][:2])
        todo.remove((place, made))
        cost, audit, kept = best[place, made]
        if place == len(rows) and re.fullmatch("(s?(ua)+)?", made):
            results.append((cost, audit, kept))
            continue
        moves = [(5, "I", x, "user:" if x == "u" else "assistant:", 0) for x in "ua"]
        if place < len(rows):
            _, _, role, text = rows[place]
            moves.append((2, "D", "", None, 1))
            if marks[place] not in ("blank", "duplicate"):
                late = 5 * (marks[place] == "truncated")
                moves += [(1 + late, "R", x[0], f"{x}:{text}", 1) for x in ("user", "assistant")]
                if role[:1]:
                    moves.append((late, "K", role[0], f"{role}:{text}", 1))
        for more, edit, letter, row, by in moves:
            new = (place + by, made + letter)
            if len(new[1]) > len(rows) + 2 or not grammar.match(new[1]):
                continue
            value = (cost + more, audit + edit, kept + ((row,) if row is not None else ()))
            if new not in best or value[:2] < best[new][:2]:
                if new not in best or new in todo:
                    best[new] = value
                    todo.append(new) if new not in todo else None
    return min(results)


def by_definition(rows):
    found = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    for conv in {r[0] for r in rows}:
        own = sorted(damage([r for r in rows if r[0] == conv]), key=key)
        marks = list(faults(own))
        turns = {r[1] for r in own if r[1] is not None}
        pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(own)]
        cost, audit, kept = cheapest(own, marks)
        found[conv] = (
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[marks.count(x) for x in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest(),
        )
    return sorted(found.values(), key=str)


def repaired(spark, rows):
    return sorted((tuple(r) for r in C.repair(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def test_every_short_word():
    """Costs and audits of the automaton for all words of up to four symbols, sorted by their ends."""
    import pyarrow as pa

    words = sorted(("".join(w) for n in range(5) for w in itertools.product("suaxSUA-", repeat=n)), key=lambda w: w[::-1])
    batches = [pa.RecordBatch.from_arrays([pa.array(words[i : i + 500])], ["word"]) for i in range(0, len(words), 500)]
    roles = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "-": "user"}
    found = [(x, c, a) for b in C._audits_of(batches) for x, c, a in zip(*b.to_pydict().values())]
    for word, cost, audit in found[::7]:
        rows = [(0, 0, roles[s.lower()], "t") for s in word]
        marks = ["blank" if s == "-" else "truncated" if s.isupper() else None for s in word]
        assert (cost, audit) == cheapest(rows, marks)[:2], word
    automaton = C.Automaton()
    states = {automaton.end}
    for _ in range(6):
        states |= {automaton.before(s, x)[0] for x in list(states) for s in "suaxSUAX-"}
    assert len(states) == len({automaton.before(s, x)[0] for x in states for s in "suaxSUAX-"} | {automaton.end}) < 200


def test_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert repaired(spark, rows) == by_definition(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, None, "user", "a."), (None, 3, "user", "b?")]
    rows += [(1, t, "user" if t % 2 else "assistant", f"x{t}.") for t in range(9)] + [(1, 3, "user", "x3."), (1, None, "system", "s")]
    rows += [(2, 5, "", "y"), (2, 7, "tool", "z!"), (2, 9, "user", "\t\n "), (3, 1, "system", "é\U0001f600.")]
    rows += [(i, 0, "user", "one. ") for i in range(10, 60)]
    assert repaired(spark, rows) == by_definition(rows)


def test_one_long_conversation(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(30000)]
    row = C.repair(spark.createDataFrame(rows, SCHEMA)).first()
    left = list(damage(rows))
    assert len(row.audit) - row.audit.count("I") == len(left)
    assert row.blank == sum(not r[3] for r in left) and row.gaps == 29999 + 1 - len({r[1] for r in left}) - (29999 not in {r[1] for r in left})


@pytest.mark.parametrize("n", [0, 3])
def test_clashing_names(spark, n):
    rows = [(i, 0, "user", "one.") for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as conv", "2 as copy", "3 as fault", "4 as word", "5 as audit")
    assert C.repair(df).count() == n
