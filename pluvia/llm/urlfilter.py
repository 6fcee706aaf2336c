"""Operator 7: URL rules as one bit-parallel wildcard automaton.

Each rule is a glob over the canonical URL, `.host/path`: `*` stands for any run of characters within the
host or within the path, `**` for any run at all, `?` for one character other than `/`; other characters
stand for themselves. All globs are packed into the bits of a few 64-bit words: a character of a glob is one
bit, a wildcard run is a loop on the bit before it. A step shifts all states by one (carrying between the
words), keeps those that the character allows, and adds those that loop. URLs of a batch advance together,
one character each, so a step is a few vector operations for all rules and all URLs.

A rule's verdict holds where its glob fits the whole URL; of several the longest rule wins, then the
earlier one. Listed rules come first, then the method's own globs, then `allow`.

Cases: a null url and one without `://` have an empty host and path and fit no rule; an empty path fits no
listed rule; equal rows are judged one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm import texts as T

SCHEMA = "page_id long, host string, path string, rule string, verdict string, glob string"


@dataclass(frozen=True)
class Rule:
    """`name` is what the result shows (null for the method's own globs); longer names win."""

    glob: str
    verdict: str
    name: str | None = None

    @classmethod
    def site(cls, verdict: str, host: str, path: str) -> "Rule":
        """A host with all its subdomains, and all paths that begin with `path`."""
        if set("*?\\") & set(host + path):
            raise ValueError("a site rule holds no wildcards")
        return cls(f"*.{host}{path}**", verdict, host + path)


#: The fixed rules of the query.
SITE_RULES = [
    Rule.site("allow", "com", "/"),
    Rule.site("block", "example.com", "/en/"),
    Rule.site("allow", "www.example.com", "/en/"),
    Rule.site("block", "net", "/es/"),
    Rule.site("block", "net", "/fr/"),
]

#: Globs for pages that no listed rule judges.
OWN_RULES = [
    *[Rule(glob, "block") for word in ("spam", "casino", "cheap", "free") for glob in (f"*.{word}-*", f"*.{word}-*/**")],
    Rule("**/wp-login.php**", "block"),
    Rule("**/cgi-bin/**", "block"),
]


class Automaton:
    """All globs as bit masks over UTF-8 bytes."""

    def __init__(self, globs: list[str]):
        bits: list[tuple[int | None, bool]] = []  # the byte of each state (None: any but the slash), whether it starts a glob
        loops: list[tuple[int, bool]] = []  # state, whether the slash loops too
        self.last: list[int] = []
        for glob in globs:
            raw, i = glob.encode(), 0
            bits.append((0, True))  # before the first character; no character leads here
            while i < len(raw):
                if raw[i] == 0x2A:
                    wide = raw[i : i + 2] == b"**"
                    loops.append((len(bits) - 1, wide))
                    i += 2 if wide else 1
                    continue
                bits.append((None if raw[i] == 0x3F else raw[i], False))
                i += 1
            self.last.append(len(bits) - 1)
        self.words = max(1, (len(bits) + 63) // 64)
        self.begin = self._mask([i for i, (_, first) in enumerate(bits) if first])
        self.enter = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        for byte in range(256):
            self.enter[byte] = self._mask(
                [i for i, (x, first) in enumerate(bits) if not first and (x == byte or x is None and byte != 0x2F)]
            )
            self.stay[byte] = self._mask([i for i, wide in loops if wide or byte != 0x2F])

    def _mask(self, states: list[int]) -> np.ndarray:
        mask = np.zeros(self.words, np.uint64)
        for i in states:
            mask[i // 64] |= np.uint64(1 << (i % 64))
        return mask

    def fits(self, urls: list[bytes]) -> np.ndarray:
        """For each URL and glob, whether the glob fits all of it."""
        found = np.zeros((len(urls), len(self.last)), bool)
        if not urls:
            return found
        sizes = np.array([len(u) for u in urls])
        order = np.argsort(-sizes, kind="stable")
        data = np.frombuffer(b"".join(urls) + b"\0", np.uint8)
        start = (np.cumsum(sizes) - sizes)[order]
        state = np.tile(self.begin, (len(urls), 1))
        one, top = np.uint64(1), np.uint64(63)
        for step in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(-sizes[order], -step, "left"))  # the URLs that are longer than step
            s, byte = state[:live], data[start[:live] + step]
            moved = s << one
            moved[:, 1:] |= s[:, :-1] >> top
            state[:live] = (moved & self.enter[byte]) | (s & self.stay[byte])
        for glob, i in enumerate(self.last):
            found[order, glob] = ((state[:, i // 64] >> np.uint64(i % 64)) & one).astype(bool)
        return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z in small letters, and path."""
    _, sign, rest = (url or "").partition("://")
    if not sign:
        return "", ""
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    host, rest = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    ends = [i for i in map(rest.find, "?#") if i >= 0]
    return host.encode().translate(T.LOWER).decode(), rest[: min(ends)] if ends else rest


def filter_urls(
    df: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: list[Rule] = SITE_RULES,
    own: list[Rule] = OWN_RULES,
) -> DataFrame:
    """One verdict for each row, with the rule's name, or the method's glob that decided."""
    # The longest rule first, and the method's own globs behind all of them.
    ranked = sorted(rules, key=lambda r: -len(r.name or r.glob)) + list(own)
    n_listed = len(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([r.glob for r in ranked])
        for batch in batches:
            for first, some in T.slices(batch, "url"):
                parts = [split_url(x.decode() if x is not None else None) for x in some]
                fits = automaton.fits([f".{h}{p}".encode() if h or p else b"" for h, p in parts])
                best = np.where(fits.any(axis=1), fits.argmax(axis=1), -1).tolist()
                columns = [
                    batch.column(0).slice(first, len(some)),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([ranked[b].name if 0 <= b < n_listed else None for b in best], pa.string()),
                    pa.array([ranked[b].verdict if b >= 0 else "allow" for b in best], pa.string()),
                    pa.array([ranked[b].glob if b >= 0 else None for b in best], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "path", "rule", "verdict", "glob"])

    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return rows.mapInArrow(run, SCHEMA)
