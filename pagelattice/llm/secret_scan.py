"""Operator 6: secret scans over a trigram inverted index.

Method: each rule's regular expression is parsed into a Boolean query over trigrams that
every match must hold; a batch of documents is indexed by those trigrams (trigram ->
sorted document numbers), the postings are intersected and united as the query says, and
only the candidates are verified with the expression. A rule without mandatory trigrams
(a run of hexadecimal digits) scans every document.

Defined results: null text counts as empty and has no spans; repeated rows give repeated
results; ties in a span's start are ordered by the rule's place in ``RULES``; an empty
table gives an empty result; other columns are never read. Positions are code points.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as K  # the parse tree of the standard library
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm.common import ddl, fresh, quoted, sha, slices, table, text_buffer


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a match of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    base: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)


#: The three base rules, and published token formats beside them.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, base=True),
    Rule("hex", r"[0-9a-f]+", 24, base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 30),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 20),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
)

#: Alternatives that a partial string set may hold before it is cut.
MOST_STRINGS = 64


def _all(*queries):
    parts = [q for q in queries if q is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(dict.fromkeys(parts)))


def _any(*queries):
    if any(q is None for q in queries):
        return None
    parts = tuple(dict.fromkeys(queries))
    return parts[0] if len(parts) == 1 else ("or", parts)


def _grams(strings: set[str]):
    """The query that a text holding one of the strings satisfies; None if any of them is too short."""
    return _any(*[_all(*[("has", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def trigram_query(pattern: str):
    """The Boolean query over lower-case trigrams implied by a regular expression, or None.

    Walks the parse tree with the set of strings that the part read so far may end in. Where
    the next item has few strings the set is multiplied out; elsewhere what was gathered turns
    into a query and a new set begins.
    """

    def strings(op, arg) -> set[str] | None:
        """All strings of a small item, lower case; None if there are many."""
        if op is K.LITERAL:
            return {chr(arg).lower()}
        if op is K.IN and all(o is K.LITERAL for o, _ in arg):
            return {chr(a).lower() for _, a in arg}
        if op is K.SUBPATTERN:
            return sequence(arg[3])
        if op is K.BRANCH:
            found = [sequence(x) for x in arg[1]]
            return None if any(x is None for x in found) else set().union(*found)
        if op is K.MAX_REPEAT and arg[1] <= 4:
            one = sequence(arg[2])
            if one is not None:
                out, power = set(), {""}
                for n in range(arg[1] + 1):
                    if n >= arg[0]:
                        out |= power
                    power = {a + b for a in power for b in one}
                    if len(power) > MOST_STRINGS:
                        return None
                return out
        return None

    def sequence(items) -> set[str] | None:
        out = {""}
        for op, arg in items:
            if op is K.AT:
                continue
            found = strings(op, arg)
            if found is None or len(out) * len(found) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in found}
        return out

    def walk(items):
        query, running = None, {""}
        for op, arg in items:
            if op is K.AT:
                continue
            found = strings(op, arg)
            if found is not None and len(running) * len(found) <= MOST_STRINGS:
                running = {a + b for a in running for b in found}
                continue
            query, running = _all(query, _grams(running)), {""}
            if op is K.SUBPATTERN:
                query = _all(query, walk(arg[3]))
            elif op is K.BRANCH:
                query = _all(query, _any(*[walk(x) for x in arg[1]]))
            elif op is K.MAX_REPEAT and arg[0] > 0:
                query = _all(query, walk(arg[2]))
            elif found is not None:
                running = found
        return _all(query, _grams(running))

    return walk(_parser.parse(pattern, re.ASCII))


def _wanted(query, into: set[str]) -> set[str]:
    if query is not None:
        if query[0] == "has":
            into.add(query[1])
        else:
            for q in query[1]:
                _wanted(q, into)
    return into


class TrigramIndex:
    """Postings of a slice of documents for the trigrams that the queries ask for."""

    def __init__(self, trigrams: set[str]):
        self.trigrams = sorted(t for t in trigrams if t.isascii())
        self.number = np.zeros(1 << 21, np.uint8 if len(self.trigrams) < 255 else np.uint16)
        for i, t in enumerate(self.trigrams):
            a, b, c = t.encode()
            self.number[a << 14 | b << 7 | c] = i + 1
        self.postings: dict[str, np.ndarray] = {}
        self.rows = 0

    def index(self, data: np.ndarray, offsets: np.ndarray) -> None:
        lower = np.where((data >= 65) & (data <= 90), data + 32, data)
        low7 = (lower & 0x7F).astype(np.int32)
        codes = (low7[:-2] << 14) | (low7[1:-1] << 7) | low7[2:] if len(data) > 2 else np.zeros(0, np.int32)
        found = self.number[codes]
        at = np.flatnonzero(found)
        at = at[(lower[at] < 128) & (lower[at + 1] < 128) & (lower[at + 2] < 128)]
        row = np.searchsorted(offsets, at, "right") - 1
        whole = at + 3 <= offsets[row + 1]
        at, row = at[whole], row[whole]
        kinds = found[at]
        self.rows = len(offsets) - 1
        self.postings = {t: np.unique(row[kinds == i + 1]) for i, t in enumerate(self.trigrams)}

    def candidates(self, query) -> np.ndarray:
        if query is None:
            return np.arange(self.rows)
        if query[0] == "has":
            return self.postings.get(query[1], np.arange(self.rows) if not query[1].isascii() else np.zeros(0, int))
        parts = [self.candidates(q) for q in query[1]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


def spans_of(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if len(m[rule.group]) >= rule.least]


def _scanned(docs: DataFrame, rules: tuple[Rule, ...], text: str, keep: tuple[str, ...], finish, schema: str) -> DataFrame:
    """``finish(columns, texts, found)`` of every batch: the columns ``keep``, the text column, and for each row the
    (start, rule number, end) found, by start, then rule.

    One pass without a shuffle; an index covers one slice of about a megabyte at a time.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}

    def run(batches):
        compiled = [(i, r, queries[r.kind], quick(r)) for i, r in enumerate(rules)]
        index = TrigramIndex(set().union(*[_wanted(q, set()) for q in queries.values()]))
        for batch in batches:
            column = batch.column(len(keep))
            data, offsets = text_buffer(column)
            found: list[list] = [[] for _ in range(len(column))]
            for i, j in slices(offsets):
                index.index(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                texts: dict[int, str] = {}
                for n, r, query, pattern in compiled:
                    for k in index.candidates(query).tolist():
                        t = texts.get(k)
                        if t is None:
                            t = texts[k] = column[i + k].as_py() or ""
                        for a, b in spans_of(r, pattern, t):
                            found[i + k].append((a, n, b))
            yield finish([batch.column(c) for c in range(len(keep))], column, [sorted(x) for x in found])

    (scanned,) = fresh(keep, "scanned")
    return docs.select(*map(quoted, keep), F.col(quoted(text)).cast("string").alias(scanned)).mapInArrow(run, schema)


def scan_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row and ``found``: array of (kind, start, end), by start, then rule order."""

    def finish(columns, _, found):
        rows = [[{"kind": rules[n].kind, "start": a, "end": b} for a, n, b in x] for x in found]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([*columns, pa.array(rows, kind)], [*keep, "found"])

    return _scanned(docs, rules, text, keep, finish, ddl(docs.select(*map(quoted, keep)), "found array<struct<kind: string, start: int, end: int>>"))


def quick(rule: Rule) -> re.Pattern:
    """The rule's pattern; a run of one character class is asked for at its least length at once, which finds the same."""
    if m := re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern):
        return re.compile(f"{m[1]}{{{rule.least},}}", re.ASCII)
    return rule.compiled()


def redact(text: str, spans, mark: str = "[secret]") -> str:
    """The text with every span (start, end), overlaps united, replaced by ``mark``."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """The rows of ``docs`` with every secret in ``text`` replaced; null text stays null."""
    names = tuple(docs.columns)
    at = names.index("text")

    def finish(columns, column, found):
        if any(found):
            texts = column.to_pylist()
            for k, spans in enumerate(found):
                if spans:
                    texts[k] = redact(texts[k], [(a, b) for a, _, b in spans], mark)
            columns[at] = pa.array(texts, columns[at].type)
        return pa.RecordBatch.from_arrays(columns, list(names))

    return _scanned(docs, rules, "text", names, finish, ddl(docs))


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document counts of the base kinds, the digest of the base spans, and all spans."""
    base = [r.kind for r in rules if r.base]

    def finish(columns, _, found):
        counts = {k: [] for k in base}
        digests, spans = [], []
        for row in found:
            said = [(rules[n].kind, f"{rules[n].kind}:{a}:{b}") for a, n, b in row]
            for k in base:
                counts[k].append(sum(kind == k for kind, _ in said))
            digests.append(sha(",".join(s for k, s in said if k in base).encode()))
            spans.append(",".join(s for _, s in said))
        return pa.RecordBatch.from_arrays([columns[0], *[pa.array(counts[k], pa.int64()) for k in base], pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", *[f"n_{k}" for k in base], "base_sha256", "spans"])

    schema = "doc_id long, " + "".join(f"n_{k} long, " for k in base) + "base_sha256 string, spans string"
    return _scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rules, "text", ("doc_id",), finish, schema)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
