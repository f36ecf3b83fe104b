"""Secret scans: all rules in one deterministic automaton over bytes.

The rules are regular expressions of a small dialect. Reversed, joined under a
leading "any bytes" loop and compiled by subset construction and minimisation,
they give one transition array; one pass over a text's bytes, from its end,
finds every place where some rule can start. A second array for each rule,
compiled the same way but anchored and forward, measures the longest match at
those few places. Spans of a rule are leftmost and do not overlap.

Defined cases: null and empty texts have no spans; texts are scanned whole, in
linear time, with memory in proportion to one text; repeated rows and an empty
table need nothing special; columns other than id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import bound_batches, keyed_text


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds spans; one whose group, if any, or else whole match is
    shorter than ``least`` is dropped after the leftmost non-overlapping match."""

    kind: str
    pattern: str
    least: int = 0
    ignore_case: bool = False
    group: str = ""  # the bytes that the trailing run of the pattern may hold


_VALUE = "[A-Za-z0-9+/_.=-]"
# The three kinds of the query's contract, then common key formats.
BASE_RULES = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?" + _VALUE + "+", 6, True, _VALUE),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24,}", 24),
)
MORE_RULES = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 24),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", "AIza[A-Za-z0-9_-]+", 35),
    Rule("bearer", "[Bb]earer\\x20+[A-Za-z0-9+/_.=-]+", 24),
)
RULES = BASE_RULES + MORE_RULES


# --- regular expressions to automata -------------------------------------

class _Parser:
    """Syntax tree of the dialect: literals, ``\\xHH`` and escaped bytes,
    classes, groups, ``|`` and the repeats ``? * + {n} {n,}``."""

    def __init__(self, pattern: str, ignore_case: bool):
        self.s, self.i, self.fold = pattern, 0, ignore_case

    def parse(self):
        tree = self.alternatives()
        if self.i != len(self.s):
            raise ValueError(f"cannot read {self.s!r} at {self.i}")
        return tree

    def alternatives(self):
        parts = [self.sequence()]
        while self.s[self.i:self.i + 1] == "|":
            self.i += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self):
        parts = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            parts.append(self.repeated())
        return ("seq", parts)

    def repeated(self):
        atom = self.atom()
        while self.i < len(self.s) and self.s[self.i] in "?*+{":
            c = self.s[self.i]
            self.i += 1
            if c == "{":
                least, _, rest = self.s[self.i:self.s.index("}", self.i)].partition(",")
                more = self.s[self.i + len(least)] == ","
                if rest:
                    raise ValueError("only {n} and {n,}")
                self.i = self.s.index("}", self.i) + 1
                atom = ("seq", [atom] * int(least) + ([("star", atom)] if more else []))
            else:
                atom = {"?": ("or", [atom, ("seq", [])]), "*": ("star", atom), "+": ("seq", [atom, ("star", atom)])}[c]
        return atom

    def byte(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2:self.i], 16)
        return ord(c)

    def atom(self):
        if self.s[self.i] == "(":
            self.i += 1
            tree = self.alternatives()
            self.i += 1
            return tree
        chars: set[int] = set()
        if self.s[self.i] == "[":
            self.i += 1
            while self.s[self.i] != "]":
                lo = hi = self.byte()
                if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                    self.i += 1
                    hi = self.byte()
                chars |= set(range(lo, hi + 1))
            self.i += 1
        else:
            chars = {self.byte()}
        if self.fold:
            chars |= {ord(chr(c).swapcase()) for c in chars if chr(c).isascii() and chr(c).isalpha()}
        return ("set", frozenset(chars))


def _reverse(tree):
    kind, x = tree
    if kind == "seq":
        return kind, [_reverse(t) for t in reversed(x)]
    if kind == "or":
        return kind, [_reverse(t) for t in x]
    return (kind, _reverse(x)) if kind == "star" else tree


@dataclass
class _Nfa:
    """Thompson automaton: edges by byte set and empty moves."""

    edges: list[list[tuple[frozenset, int]]] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, tree, a: int) -> int:
        kind, x = tree
        if kind == "set":
            b = self.state()
            self.edges[a].append((x, b))
            return b
        if kind == "seq":
            for t in x:
                a = self.add(t, a)
            return a
        b = self.state()
        if kind == "or":
            for t in x:
                c = self.state()
                self.empty[a].append(c)
                self.empty[self.add(t, c)].append(b)
        else:
            self.empty[a].append(b)
            self.empty[self.add(x, b)].append(b)
        return b

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass
class Dfa:
    """``step[state * 256 + byte]`` is the next state; state 0 starts. ``accept``
    marks states; ``dead`` is the state with no way on (or -1)."""

    step: np.ndarray
    accept: np.ndarray
    dead: int


def compile_dfa(trees: list, anywhere: bool) -> Dfa:
    """Subset construction over byte classes, then Moore's minimisation."""
    nfa = _Nfa()
    start = nfa.state()
    if anywhere:
        nfa.edges[start].append((frozenset(range(256)), start))
    ends = set()
    for t in trees:
        s = nfa.state()
        nfa.empty[start].append(s)
        ends.add(nfa.add(t, s))
    sets = {x for out in nfa.edges for x, _ in out}
    marks = [tuple(b in x for x in sets) for b in range(256)]
    classes = {m: i for i, m in enumerate(dict.fromkeys(marks))}
    klass = np.array([classes[m] for m in marks])
    sample = [marks.index(m) for m in classes]
    ids = {nfa.closure([start]): 0}
    queue, rows = list(ids), []
    while len(rows) < len(queue):
        now, row = queue[len(rows)], []
        for byte in sample:
            to = nfa.closure({t for s in now for x, t in nfa.edges[s] if byte in x})
            if to not in ids:
                ids[to] = len(ids)
                queue.append(to)
            row.append(ids[to])
        rows.append(row)
    table = np.array(rows, np.int64)
    accept = np.array([bool(ends & s) for s in queue])
    part = accept.astype(np.int64)
    while True:  # states stay together while their blocks and their successors' blocks agree
        _, finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    order = np.full(part.max() + 1, -1)
    order[part[0]] = 0
    rest = [p for p in range(part.max() + 1) if p != part[0]]
    order[rest] = np.arange(1, len(rest) + 1)
    part = order[part]
    n = part.max() + 1
    small, ok = np.zeros((n, table.shape[1]), np.int64), np.zeros(n, bool)
    small[part] = part[table]
    ok[part] = accept
    dead = [s for s in range(n) if not ok[s] and (small[s] == s).all()]
    return Dfa(small[:, klass].astype(np.int32).reshape(-1), ok, dead[0] if dead else -1)


class Scanner:
    """The compiled rules. Built once on the driver; the arrays travel to the
    tasks, which unfold them into rows of successor rows on first use."""

    def __init__(self, rules=RULES):
        self.rules = tuple(rules)
        trees = [_Parser(r.pattern, r.ignore_case).parse() for r in rules]
        self.backward = compile_dfa([_reverse(t) for t in trees], anywhere=True)
        self.forward = [compile_dfa([t], anywhere=False) for t in trees]
        self._groups = [_Parser(r.group, False).parse()[1][0][1] if r.group else None for r in rules]
        self._rows = None

    def __getstate__(self):
        return self.__dict__ | {"_rows": None}

    @staticmethod
    def _unfold(d: Dfa) -> list:
        rows = [[None] * 257 for _ in d.accept]
        for s, row in enumerate(rows):
            row[:256] = [rows[t] for t in d.step[s * 256:s * 256 + 256]]
            row[256] = bool(d.accept[s])
        return rows

    def starts(self, data: bytes) -> list[int]:
        """Bytes at which some rule matches, ascending; one pass, all rules."""
        if self._rows is None:
            self._rows = self._unfold(self.backward)
        row, found, i = self._rows[0], [], len(data)
        for b in reversed(data):
            row = row[b]
            i -= 1
            if row[256]:
                found.append(i)
        found.reverse()
        return found

    @staticmethod
    def _longest(d: Dfa, data: bytes, at: int) -> int:
        """End of the longest match that starts at ``at``, or -1."""
        s, end, step = 0, -1, d.step
        for i in range(at, len(data)):
            s = int(step[s * 256 + data[i]])
            if s == d.dead:
                break
            if d.accept[s]:
                end = i + 1
        return end

    def spans(self, data: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in bytes, by start and then by the rules' order."""
        starts = self.starts(data)
        found = []
        for k, (rule, d, group) in enumerate(zip(self.rules, self.forward, self._groups)):
            free = 0
            for at in starts:
                if at < free:
                    continue
                end = self._longest(d, data, at)
                if end < 0:
                    continue
                free = end
                tail = at
                if group is not None:
                    tail = self._value_start(rule, data, at, end, group)
                if end - tail >= rule.least:
                    found.append((at, k, end))
        return [(self.rules[k].kind, a, e) for a, k, e in sorted(found)]

    @staticmethod
    def _value_start(rule: Rule, data: bytes, at: int, end: int, group) -> int:
        """Where the trailing group starts: after the key, its separator and quotes."""
        i = min(x for x in (data.find(b":", at, end), data.find(b"=", at, end)) if x >= 0) + 1
        while data[i] == 0x20:
            i += 1
        return i if data[i] in group else i + 1


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def code_points(data: bytes, offsets: list[int]) -> dict[int, int]:
    """Code point offset of each byte offset (offsets ascending)."""
    out, last, n = {}, 0, 0
    for o in offsets:
        n += len(data[last:o].decode("utf-8", "surrogatepass"))
        out[o] = n
        last = o
    return out


def find_secrets(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): spans in code points, end exclusive, of every rule."""
    scanner = Scanner(rules)

    def scan(batches):
        for batch in batches:
            out = []
            for text in batch.column("text"):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                found = scanner.spans(data)
                at = code_points(data, sorted({x for _, a, e in found for x in (a, e)}))
                out.append([{"kind": k, "start": at[a], "end": at[e]} for k, a, e in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, _SPAN_TYPE)], names=["doc_id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return keyed_text(docs, id_col, text_col).mapInArrow(scan, f"doc_id {kind}, spans {SPANS}")


def redact(docs: DataFrame, rules=RULES, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every secret span of the text replaced by ``mark``
    (touching or overlapping spans by one mark). Null texts stay null; the
    other columns, their names and order stay as they are."""
    bound_batches(docs.sparkSession)
    scanner = Scanner(rules)

    @F.pandas_udf("string")
    def clean(texts):
        import pandas as pd

        def one(text):
            if text is None:
                return None
            data = text.encode("utf-8", "surrogatepass")
            out, at, hidden = [], 0, False
            for _, a, e in scanner.spans(data):
                if not hidden or a > at:
                    out += [data[at:a], mark.encode()]
                at, hidden = max(at, e), True
            return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass") if out else text
        return pd.Series([one(t) for t in texts], dtype=object)

    return docs.select(*[clean(F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from ``find_secrets``."""
    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    kinds = [r.kind for r in BASE_RULES]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select(
        "doc_id",
        *[count(k) for k in kinds],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))
