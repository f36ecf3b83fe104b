"""URL filters: one bit-parallel wildcard automaton for all glob rules.

All globs are packed one after another into multiword Shift-And masks. A bit is
one automaton state; for a byte ``c`` all states of all globs step at once:
``D = (shift(D) & ADVANCE[c]) | (D & STAY[c])``. URLs of a block step together,
position by position, so the work is a few numpy operations per position.

Glob syntax over the canonical URL (``"." + host + path``, bytes): ``**`` any
run, ``*`` any run without ``/``, ``?`` one byte other than ``/``; all else
stands for itself. A glob has to match the whole canonical URL.

Defined cases: a null url, or one without ``://``, has an empty host and path
and matches only globs that accept ``"."``; repeated rows are judged alike; an
empty table gives an empty result; other columns are ignored. Of two matching
rules the longer text wins; of equally long ones, block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the query's contract (verdict, host, path).
BASE_RULES = (
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
)

# Default globs of URLs that no rule fits: gambling, pharmacy, advertising and
# adult hosts, log-in, cart and tracker pages, and links to program files.
BLOCK_GLOBS = (
    "*casino*.*/**", "*casino*.*", "*.free-bets.*/**", "*.free-bets.*", "*poker*.*/**", "*poker*.*",
    "*cheap-pills*/**", "*cheap-pills*", "*pharma-*/**", "*pharma-*",
    "*.ads-*/**", "*.ads-*", "*.ads.*/**", "*.ads.*", "*-track.*/**", "*-track.*", "*.tracker.*/**", "*.tracker.*",
    "*.xxx/**", "*.xxx", "*porn*/**", "*porn*",
    "*/**/wp-login.php", "*/wp-login.php", "*/login/**", "*/cart/**", "*/checkout/**",
    "*/**.exe", "*/**.apk", "*/**.dmg",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?`` or ``#``; A-Z lower-cased)
    and path (up to ``?`` or ``#``); both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


# One step of a glob: the byte it takes, or None for any byte but "/".
Step = int | None


def parse_glob(glob: str) -> tuple[list[Step], dict[int, str]]:
    """Steps of a glob, and where it may stay: state -> ``*`` or ``**``."""
    steps: list[Step] = []
    loops: dict[int, str] = {}
    i, raw = 0, glob.encode()
    while i < len(raw):
        if raw[i:i + 2] == b"**":
            loops[len(steps)] = "**"
            i += 2
        elif raw[i:i + 1] == b"*":
            loops.setdefault(len(steps), "*")
            i += 1
        else:
            steps.append(None if raw[i:i + 1] == b"?" else raw[i])
            i += 1
    return steps, loops


def rule_glob(host: str, path: str) -> tuple[list[Step], dict[int, str]]:
    """A host with all its subdomains and every path that starts with ``path``."""
    steps: list[Step] = list(f".{host}{path}".encode())
    return steps, {0: "*", len(steps): "**"}


@dataclass
class ShiftAnd:
    """Masks of the packed globs; the last axis holds the 64-bit words."""

    start: np.ndarray
    advance: np.ndarray
    stay: np.ndarray
    final: np.ndarray  # state index of each glob's end

    @classmethod
    def compile(cls, globs: list[tuple[list[Step], dict[int, str]]]) -> "ShiftAnd":
        total = sum(len(s) + 1 for s, _ in globs)
        words = max(1, -(-total // 64))
        start = np.zeros(words, np.uint64)
        advance, stay = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
        final, at = [], 0
        not_slash = np.arange(256) != ord("/")
        for steps, loops in globs:
            start[at // 64] |= np.uint64(1 << at % 64)
            for k, byte in enumerate(steps):
                s = at + k + 1
                advance[not_slash if byte is None else byte, s // 64] |= np.uint64(1 << s % 64)
            for k, kind in loops.items():
                s = at + k
                stay[slice(None) if kind == "**" else not_slash, s // 64] |= np.uint64(1 << s % 64)
            final.append(at + len(steps))
            at += len(steps) + 1
        return cls(start, advance, stay, np.array(final, np.int64))

    def run(self, texts: list[bytes]) -> np.ndarray:
        """Boolean matrix: which glob matches which whole text."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        ends = np.tile(self.start, (len(texts), 1))
        # Blocks of like lengths keep the padded matrix near 4 MB.
        lo = 0
        while lo < len(order):
            width = max(1, int(lengths[order[lo]]))
            rows = order[lo:lo + max(1, (1 << 22) // width)]
            lo += len(rows)
            size = lengths[rows]
            chars = np.zeros((width, len(rows)), np.uint8)
            for j, r in enumerate(rows):
                chars[:size[j], j] = np.frombuffer(texts[r], np.uint8)
            d = ends[rows]
            live = len(rows)
            for i in range(int(size[0])):
                while live and size[live - 1] <= i:
                    live -= 1
                now, c = d[:live], chars[i, :live]
                shifted = now << np.uint64(1)
                shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
                d[:live] = (shifted & self.advance[c]) | (now & self.stay[c])
            ends[rows] = d
        bits = ends[:, self.final // 64] >> (self.final % 64).astype(np.uint64)
        return (bits & np.uint64(1)).astype(bool)


def matching_globs(globs: list[tuple[list[Step], dict[int, str]]]):
    """Column function: indices of the globs that match a canonical URL. The
    masks travel with the function; their size depends on the rules only."""
    automaton = ShiftAnd.compile(globs)

    @F.pandas_udf(ArrayType(IntegerType()))
    def matches(urls: pd.Series) -> pd.Series:
        hit = automaton.run([u.encode("utf-8", "surrogatepass") for u in urls])
        return pd.Series([np.flatnonzero(row).tolist() for row in hit], dtype=object)

    return matches


def judge_urls(pages: DataFrame, rules=BASE_RULES, block_globs=BLOCK_GLOBS,
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, globs): the longest fitting rule
    decides; where none fits, a block if any of ``block_globs`` matches."""
    host, path = host_and_path(F.col("url"))
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != BLOCK))
    matches = matching_globs([rule_glob(h, p) for _, h, p in ranked] + [parse_glob(g) for g in block_globs])
    names = F.array([F.lit(h + p) for _, h, p in ranked] + [F.lit(None).cast("string")])
    verdicts = F.array([F.lit(v) for v, _, _ in ranked] + [F.lit(None).cast("string")])
    n = len(ranked)
    best = F.coalesce(F.array_min(F.col("m")), F.lit(n))
    best = F.when(best < n, best).otherwise(n)
    return (
        pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
        .select("page_id", host.alias("host"), path.alias("path"))
        .withColumn("m", matches(F.concat(F.lit("."), "host", "path")))
        .select("page_id", "host", "path",
                F.get(names, best).alias("rule"),
                F.coalesce(F.get(verdicts, best),
                           F.when(F.array_max("m") >= n, BLOCK).otherwise(ALLOW)).alias("verdict"),
                F.transform(F.filter("m", lambda i: i >= n), lambda i: i - n).alias("globs"))
    )


def glob_regex(glob: str) -> str:
    """The same language as a regular expression (for SQL twins and tests)."""
    out, i = "", 0
    while i < len(glob):
        if glob[i:i + 2] == "**":
            out, i = out + "(.|\n)*", i + 2
            continue
        c = glob[i]
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in ".+()[]{}^$|\\" else c
        i += 1
    return out


def oracle_sql(rules=BASE_RULES, block_globs=BLOCK_GLOBS) -> str:
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != BLOCK))
    fits = [(v, h + p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for v, h, p in ranked]
    rule = " ".join(f"WHEN {c} THEN '{name}'" for _, name, c in fits)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for v, _, c in fits)
    globs = "|".join(f"({glob_regex(g)})" for g in block_globs)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
             THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN regexp_full_match('.' || host || path, '{globs}') THEN 'block' ELSE 'allow' END AS verdict
FROM h"""
