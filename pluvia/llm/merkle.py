"""Operator 12: a Merkle manifest of a dataset, with a proof for every row.

Each row is a leaf, each language a tree of runs of eight, the subroots of all languages one tree more. Leaves
are numbered by counts over the axis of ids, without a global sort. The digits of a number, base eight, say
where the leaf hangs: a block is all numbers with the same high digits, and its low digits are grouped away one
after another, each time nesting the child structs in their parent. One shuffle by block serves all groupings
of it. The blocks are the leaves of the next tier, until one is left. Proofs go down the same tiers: each block
meets the path above it as rows of one group, and nested transforms and one explode emit all its children with
their paths, without a join. A block has at most 8**3 leaves, whatever the size of the table.

Cases: null ids come first in their language, null languages before all others; rows with the same id follow
each other by leaf, and equal rows have equal leaves but each its own place and proof; a language of one row
has its leaf as subroot; the hash of no siblings is that of the empty string; tampering changes neither null
texts nor rows with null ids; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.llm.texts import bound, crc_of_id
from pluvia.operators.prefix import running_totals
from pluvia.operators.storage import materialise

FAN, DIGITS = 8, 3
BLOCK = FAN**DIGITS
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_LEAST = -(2**63)


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(**fields: Column) -> Column:
    """The digest of a row: each field as a dash, or its length in bytes, a colon and itself."""
    as_text = [fields[f].cast("string") for f in FIELDS]
    parts = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in as_text]
    return digest(*parts)


def leaves(df: DataFrame) -> DataFrame:
    """(key, v, doc_id, leaf, changed): the language and id as keys that are not null, and the leaf of a tampered row."""
    rows = df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")],
        F.col("n_chars").cast("long").alias("n_chars"),
    )
    fields = {f: F.col(f) for f in FIELDS}
    tampered = fields | {"text": F.translate("text", CAPITALS, CAPITALS.lower())}
    hit = (crc_of_id() % 3 == 0) & (tampered["text"] != F.col("text"))
    return rows.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("key"),
        F.coalesce("doc_id", F.lit(_LEAST)).alias("v"),
        "doc_id",
        leaf_of(**fields).alias("leaf"),
        F.when(hit, leaf_of(**tampered)).alias("changed"),
    )


def numbered(units: DataFrame) -> DataFrame:
    """(key, total, number, times, doc_id, leaf, changed): places number .. number + times - 1 among the leaves of a key.

    Ids that occur once get their number from the counts of ids; rows under one id are ordered by leaf, equal rows
    are one entry.
    """
    counts = units.groupBy("key", "v").agg(F.count("*").alias("n"))
    starts = running_totals(counts, ["key"], "v", ["n"], with_total=True)
    starts = starts.select("key", "v", "n", (F.col("cum_n") - F.col("n")).alias("start"), F.col("total_n").alias("total"))
    placed = materialise(units.join(starts, ["key", "v"]), "placed")
    columns = ["key", "total", "number", "times", "doc_id", "leaf", "changed"]
    once = placed.where("n = 1").withColumns({"number": F.col("start"), "times": F.lit(1).cast("long")}).select(columns)
    several = placed.where("n > 1")
    if several.isEmpty():
        return once
    # Null ids share `v` with the least id; negative prefixes put them first.
    prefix = F.conv(F.substring("leaf", 1, 8), 16, 10).cast("long") - F.when(F.col("doc_id").isNull(), 1 << 32).otherwise(0)
    group = ["key", "v", "total", "start"]
    several = several.groupBy(*group, "doc_id", "leaf", "changed", prefix.alias("p")).agg(F.count("*").alias("times"))
    several = materialise(several, "several")
    sizes = several.groupBy("key", "v", "p").agg(F.sum("times").alias("k"))
    before = running_totals(sizes, ["key", "v"], "p", ["k"])
    before = before.select("key", "v", "p", (F.col("cum_k") - F.col("k")).alias("before"))
    inside = Window.partitionBy("key", "v", "p").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("times").over(inside), F.lit(0))
    several = several.join(before, ["key", "v", "p"]).withColumn("number", F.col("start") + F.col("before") + own)
    return once.unionByName(several.select(columns))


def _several(level: int) -> Column:
    """Whether a level holds more than one node; a single node is what remains and is not hashed again."""
    return F.col("total") > FAN**level


def rolled_up(nodes: DataFrame) -> DataFrame:
    """(key, total, block, kids, hash) of each block of the nodes (key, total, number, hash, item).

    `nodes` is partitioned by key and block, so that no grouping shuffles again. `kids` nests DIGITS levels.
    """
    digits = [f"d{i}" for i in range(DIGITS)]
    rows = nodes.withColumns({d: F.floor(F.col("number") / FAN**i) % FAN for i, d in enumerate(digits)})
    kid = ["hash", "item"]
    for level, digit in enumerate(digits):
        rows = rows.groupBy("key", "total", "block", *digits[level + 1 :]).agg(
            F.sort_array(F.collect_list(F.struct(F.col(digit).alias("at"), *kid))).alias("kids")
        )
        joined = digest(F.array_join(F.col("kids.hash"), ""))
        rows = rows.withColumn("hash", F.when(_several(level), joined).otherwise(F.col("kids")[0]["hash"]))
        kid = ["hash", "kids"]
    return rows


def _blocks(nodes: DataFrame) -> DataFrame:
    """The rows of nodes that stand for `times` leaves in a row, one for each leaf, dealt out by block."""
    last = F.floor((F.col("number") + F.col("times") - 1) / BLOCK)
    first = F.floor(F.col("number") / BLOCK)
    parts = nodes.withColumn("block", F.explode(F.sequence(first, last))).repartition("key", "block")
    low = F.greatest(F.col("number"), F.col("block") * BLOCK)
    high = F.least(F.col("number") + F.col("times"), (F.col("block") + 1) * BLOCK) - 1
    return parts.withColumn("number", F.explode(F.sequence(low, high))).drop("times")


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """The written blocks of each tier; in the last one every key has one block, whose hash is its root."""
    found, most = [], None
    while most is None or most > BLOCK:
        blocks = materialise(rolled_up(_blocks(nodes)), "blocks")
        found.append(blocks)
        most = blocks.agg(F.max("total")).first()[0] or 0
        nodes = blocks.select(
            "key",
            F.ceil(F.col("total") / BLOCK).alias("total"),
            F.col("block").alias("number"),
            F.lit(1).alias("times"),
            "hash",
            F.lit(None).cast("string").alias("item"),
        )
    return found


def _children(kids: Column, level: int, above: Column, place: Column) -> Column:
    """All leaves of a block with their paths: siblings before and after the node, from the lowest level up.

    `at` is a leaf's place in its block, all digits of it: `place` holds those above this level.
    """

    def of(hashes: Column) -> Column:
        def child(kid: Column, i: Column) -> Column:
            before = F.array_join(F.slice(hashes, 1, i), "")
            after = F.array_join(F.slice(hashes, i + 2, FAN), "")
            step = F.array(F.struct(before.alias("before"), after.alias("after")))
            path = F.when(_several(level), F.concat(step, above)).otherwise(above)
            at = place + kid["at"] * FAN**level
            if level:
                return bound(path, lambda p: _children(kid["kids"], level - 1, p, at))
            return F.struct(kid["item"].alias("item"), kid["hash"].alias("hash"), at.alias("at"), path.alias("path"))

        each = F.transform(kids, child)
        return F.flatten(each) if level else each

    return bound(F.transform(kids, lambda k: k["hash"]), of)


def proofs(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(key, item, hash, path, subroot, root) of each leaf. `tops`: (key, path, subroot, root) of each key."""
    given = tops.withColumn("block", F.lit(0).cast("long"))
    for depth, blocks in enumerate(reversed(levels)):
        kept, handed = ["total", "kids"], ["path", "subroot", "root"]
        both = blocks.select("key", "block", *kept).unionByName(given, allowMissingColumns=True)
        met = both.groupBy("key", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in kept + handed])
        each = _children(F.col("kids"), DIGITS - 1, F.col("path"), F.lit(0).cast("long"))
        kids = met.select("key", "block", "subroot", "root", F.explode(each).alias("kid"))
        if depth + 1 == len(levels):
            return kids.select("key", "kid.item", "kid.hash", "kid.path", "subroot", "root")
        number = F.col("block") * BLOCK + F.col("kid.at")
        given = kids.select("key", "kid.path", "subroot", "root", number.alias("block"))
    raise ValueError("no tier")


def _ordered(roots: DataFrame) -> DataFrame:
    """Subroots as nodes of one more tree, by the bytes of their key: its first six as a number, then among equals."""
    first = F.rpad(F.substring(F.hex(F.encode("key", "UTF-8")), 1, 12), 12, "0")
    keyed = roots.withColumn("p", F.conv(first, 16, 10).cast("long"))
    sizes = running_totals(keyed.groupBy("p").agg(F.count("*").alias("k")), [], "p", ["k"], with_total=True)
    sizes = sizes.select("p", (F.col("cum_k") - F.col("k")).alias("before"), F.col("total_k").alias("total"))
    own = F.row_number().over(Window.partitionBy("p").orderBy("key")) - 1
    return keyed.join(sizes, "p").select(
        F.lit("").alias("key"),
        "total",
        (F.col("before") + own).alias("number"),
        F.lit(1).alias("times"),
        "hash",
        F.col("key").alias("item"),
    )


def manifest(df: DataFrame) -> DataFrame:
    """One row a document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    `df` has the columns doc_id, source, lang, n_chars and text. Tampered rows fold to another root.
    """
    ranked = numbered(materialise(leaves(df), "leaves"))
    item = F.struct("doc_id", "changed").alias("item")
    languages = tiers(ranked.select("key", "total", "number", "times", F.col("leaf").alias("hash"), item))
    subroots = tiers(_ordered(languages[-1].select("key", "hash")))
    empty = F.array().cast("array<struct<before:string,after:string>>")
    top = subroots[-1].select("key", empty.alias("path"), F.lit("").alias("subroot"), F.col("hash").alias("root"))
    handed = proofs(subroots, top).select(F.col("item").alias("key"), "path", F.col("hash").alias("subroot"), "root")
    own = F.coalesce("item.changed", "hash")
    folded = F.aggregate("path", own, lambda below, s: digest(s["before"], below, s["after"]))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    return (
        proofs(languages, handed)
        .select(
            "item.doc_id",
            F.col("hash").alias("leaf"),
            "subroot",
            "root",
            digest(siblings).alias("proof_sha256"),
            folded.alias("folded_root"),
        )
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )
