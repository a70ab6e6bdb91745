"""URL filters: glob rules as one bit-parallel automaton that reads each canonical URL once.

A canonical URL is the host, A-Z lower-cased, followed by the path: no scheme,
no query, no fragment. A glob is literal bytes with three wildcards: `?` is one
byte other than `/`, `*` a run of bytes other than `/`, `**` a run of any bytes;
both runs may be empty. A glob fits a URL as a whole.

All globs are packed, one bit for each literal and one for the start of each
glob, into words of 64 bits. Bit j of a glob is on when its first j literals
have been read; a wildcard behind literal j lets the bit stay on. A byte c takes
the states D to `((D << 1) & STEP[c]) | (D & STAY[c])`, the shift carrying from
word to word, so every glob moves at once, in as many operations as there are
words, whatever the number of globs alive. A batch of URLs moves together; a
symbol of its own, which changes nothing, fills the shorter ones.

`judge` takes host rules, which are two globs each (the host itself and its
subdomains), and globs that decide where no host rule fits. The longest fitting
host rule wins; of globs, the last fitting one in their order.

Defined cases: a null URL, or one without `://`, has an empty host and path, no
rule and the default verdict; an empty path fits no host rule, for their paths
begin with `/`; URLs of any length are read whole, in batches of bounded bytes;
repeated rows and null ids are judged row by row; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.shared import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes and rows of URLs that move together, at most; one URL may be longer.
BATCH, ROWS = 1 << 20, 4096
#: The symbol that fills short URLs up.
FILL = 256


@dataclass(frozen=True)
class HostRule:
    """Fits a host and its subdomains where the path starts with the rule's."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class GlobRule:
    glob: str
    verdict: str


#: The rules of op12.
HOST_RULES = (
    HostRule("com", "/", "allow"),
    HostRule("example.com", "/en/", "block"),
    HostRule("www.example.com", "/en/", "allow"),
    HostRule("net", "/es/", "block"),
    HostRule("net", "/fr/", "block"),
)
#: What decides where no host rule fits: names of advertisers and spam, downloads and pages that hold no text.
GLOB_RULES = (
    GlobRule("**", "allow"),
    GlobRule("ads-*/**", "block"),
    GlobRule("*.ads-*/**", "block"),
    GlobRule("*cheap-*/**", "block"),
    GlobRule("*spam-*/**", "block"),
    GlobRule("*free-bet*/**", "block"),
    GlobRule("*/**.exe", "block"),
    GlobRule("*/**.zip", "block"),
    GlobRule("*/**/login", "block"),
    GlobRule("*/**/login/**", "block"),
    GlobRule("*/**/wp-admin/**", "block"),
    GlobRule("**/robots.txt", "allow"),
)


def behind_scheme(url: Column) -> Column:
    """What stands behind the first ://; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(behind_scheme(url), "^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(behind_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


class Automaton:
    """Globs packed into words; `fits` tells which fit each of a batch of strings."""

    def __init__(self, globs: Sequence[str]):
        states, stay, ends = [], [], []  # of each bit: its literal (None at a start, -1 for ?), the wildcard behind it
        for glob in globs:
            states.append(None)
            stay.append("")
            data, at = glob.encode(), 0
            while at < len(data):
                if data[at] == ord("*"):
                    wide = data[at : at + 2] == b"**"
                    stay[-1] = "any" if wide or stay[-1] == "any" else "segment"
                    at += 1 + wide
                    continue
                states.append(-1 if data[at] == ord("?") else data[at])
                stay.append("")
                at += 1
            ends.append(len(states) - 1)
        bits = len(states)
        self.words = max(1, -(-bits // 64))
        step, keep = np.zeros((257, self.words * 64), bool), np.zeros((257, self.words * 64), bool)
        slash = ord("/")
        for bit, (literal, wild) in enumerate(zip(states, stay, strict=True)):
            if literal == -1:
                step[:256, bit] = True
                step[slash, bit] = False
            elif literal is not None:
                step[literal, bit] = True
            if wild:
                keep[:256, bit] = True
                keep[slash, bit] = wild == "any"
        keep[FILL] = True
        starts = np.zeros(self.words * 64, bool)
        starts[[bit for bit, literal in enumerate(states) if literal is None]] = True
        self.step, self.keep, self.start = _words(step), _words(keep), _words(starts)
        self.ends = np.array(ends, np.int64)

    def run(self, symbols: np.ndarray) -> np.ndarray:
        """States after each row of symbols (bytes, or FILL behind the end)."""
        state = np.broadcast_to(self.start, (len(symbols), self.words)).copy()
        for column in symbols.T:
            moved = state << np.uint64(1)
            moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
            state = (moved & self.step[column]) | (state & self.keep[column])
        return state

    def fits(self, strings: pa.Array) -> np.ndarray:
        """Which glob (columns) fits which string (rows)."""
        out = np.zeros((len(strings), len(self.ends)), bool)
        if not len(strings):
            return out
        offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
        data = np.frombuffer(strings.buffers()[2] or b"\0", np.uint8)
        sizes = np.diff(offsets)
        order, low = np.argsort(sizes, kind="stable"), 0
        while low < len(order):
            rows = order[low : low + ROWS]
            rows = rows[: max(1, int(np.count_nonzero(sizes[rows] * np.arange(1, len(rows) + 1) <= BATCH)))]
            places = np.arange(int(sizes[rows[-1]]))
            inside = places[None, :] < sizes[rows][:, None]
            symbols = np.full(inside.shape, FILL, np.int16)
            symbols[inside] = data[(offsets[rows][:, None] + places[None, :])[inside]]
            state = self.run(symbols)
            out[rows] = (state[:, self.ends // 64] >> (self.ends % 64).astype(np.uint64)) & np.uint64(1) != 0
            low += len(rows)
        return out


def _words(bits: np.ndarray) -> np.ndarray:
    """Booleans along the last axis as words of 64, the first in the lowest bit."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8").astype(np.uint64)


def globs_of(rule: HostRule) -> list[str]:
    """The globs that fit the rule's host and its subdomains."""
    return [f"{rule.host}{rule.path}**", f"*.{rule.host}{rule.path}**"]


def judge(pages: DataFrame, host_rules: Sequence[HostRule] = HOST_RULES, glob_rules: Sequence[GlobRule] = GLOB_RULES, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict): one row per page.

    rule is the longest host rule that fits, or null; verdict is that rule's,
    else that of the last glob rule that fits, else the default.
    """
    ranked = sorted(host_rules, key=lambda rule: (len(rule.name), rule.name))
    globs = [glob for rule in ranked for glob in globs_of(rule)] + [rule.glob for rule in glob_rules]
    names = np.array([rule.name for rule in ranked] + [None], object)
    verdicts = np.array([rule.verdict for rule in ranked], object)
    later = np.array([rule.verdict for rule in glob_rules] + [default], object)
    found = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))

    def last(fits: np.ndarray) -> np.ndarray:
        """The last column that is on, by row; -1 where none is."""
        if not fits.shape[1]:
            return np.full(len(fits), -1)
        return np.where(fits.any(axis=1), fits.shape[1] - 1 - fits[:, ::-1].argmax(axis=1), -1)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(globs)
        for batch in batches:
            urls = [host + path for host, path in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True)]
            fits = automaton.fits(pa.array(urls, pa.string()))
            of_rule = last(fits[:, : 2 * len(ranked)].reshape(len(urls), -1, 2).any(axis=2)) if ranked else np.full(len(urls), -1)
            verdict = later[last(fits[:, 2 * len(ranked) :])]
            verdict = np.where(of_rule >= 0, verdicts[of_rule] if ranked else None, verdict)
            columns = [batch["page_id"], batch["host"], batch["path"], pa.array(names[of_rule], pa.string()), pa.array(verdict, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return found.mapInArrow(judged, f"page_id {kind}, host string, path string, rule string, verdict string")


def op12_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql() -> str:
    """The same by regular expressions: a case for each rule, the longest or last first."""
    regex = lambda glob: "^" + "".join({"**": "(.|\\n)*", "*": "[^/]*", "?": "[^/]"}.get(x, x if x.isalnum() or x in "/-" else "\\" + x) for x in _pieces(glob)) + "$"
    hosts = sorted(HOST_RULES, key=lambda rule: (-len(rule.name), rule.name))
    fits = {rule: " OR ".join(f"regexp_matches(u, '{regex(glob)}')" for glob in globs_of(rule)) for rule in hosts}
    rule = " ".join(f"WHEN {fits[x]} THEN '{x.name}'" for x in hosts)
    verdict = " ".join([f"WHEN {fits[x]} THEN '{x.verdict}'" for x in hosts] + [f"WHEN regexp_matches(u, '{regex(x.glob)}') THEN '{x.verdict}'" for x in reversed(GLOB_RULES)])
    return f"""
WITH b AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substring(url, position('://' IN url) + 3) END AS r FROM pages),
c AS (SELECT page_id, translate(coalesce(regexp_extract(r, '^[^/?#]*'), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM b),
d AS (SELECT *, host || path AS u FROM c)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM d
"""


def _pieces(glob: str) -> list[str]:
    return re.findall(r"\*\*|.", glob, re.DOTALL)


ORACLE_SQL = _sql()
