"""Operator 10: secret scan with a trigram inverted index.

From each rule's regular expression a Boolean query of trigrams is derived that every match must
satisfy. Each task indexes the lower-cased texts of its slice of rows (trigram to posting list,
only trigrams that some rule asks for), intersects and unites posting lists to find candidate
documents, and verifies these with the expression itself. A rule without mandatory trigrams is
verified on every document. Postings stay where the texts are, so nothing is shuffled.

Cases: null text counts as empty; repeated rows give repeated results; an empty table an empty one.
Spans are in code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as kinds
from re import _parser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.textwork import slices, text_buffer, text_rows

MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an expression, and the least length of a match or of one of its groups."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The formats of well-known credentials.
RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
)
BASE = ("assign", "access", "hex")

# A query is ("all",), ("tri", code), ("and", [queries]) or ("or", [queries]).
ALL = ("all",)


def _join(op: str, parts: list) -> tuple:
    """A conjunction or disjunction without parts that make no difference."""
    if op == "or" and (not parts or ALL in parts):
        return ALL
    parts = list(dict.fromkeys(p for p in parts if p != ALL))
    return ALL if not parts else parts[0] if len(parts) == 1 else (op, tuple(parts))


def _of_strings(strings: frozenset[str]) -> tuple:
    """What a text holds that contains one of these strings."""
    codes = lambda s: [("tri", a << 16 | b << 8 | c) for a, b, c in zip(s, s[1:], s[2:])]
    return _join("or", [_join("and", codes(s.encode())) for s in sorted(strings)])


def trigram_query(pattern: str) -> tuple:
    """The trigrams (of lower-cased text) that each match of an expression must contain."""

    def literal(strings: set[str]) -> frozenset[str] | None:
        lowered = frozenset(s.lower() for s in strings)
        return lowered if all(s.isascii() for s in lowered) and len(lowered) <= MOST_STRINGS else None

    def walk(items) -> tuple[frozenset[str] | None, tuple]:
        """The strings that a sequence can be, if few, or else a query."""
        queries, run = [], frozenset([""])
        for op, arg in items:
            exact, query = one(op, arg)
            if exact is not None and len(run) * len(exact) <= MOST_STRINGS:
                run = frozenset(a + b for a in run for b in exact)
                continue
            queries += [_of_strings(run), query]
            run = exact if exact is not None else frozenset([""])
            if exact is None:
                # mark the break: what follows doesn't join what came before
                queries.append(ALL)
        if not queries:
            return run, ALL
        return None, _join("and", [*queries, _of_strings(run)])

    def one(op, arg) -> tuple[frozenset[str] | None, tuple]:
        if op is kinds.LITERAL:
            return literal({chr(arg)}), ALL
        if op is kinds.IN:
            if all(k is kinds.LITERAL for k, _ in arg):
                return literal({chr(c) for _, c in arg}), ALL
            return None, ALL
        if op is kinds.SUBPATTERN:
            exact, query = walk(arg[3])
            return (exact if exact is not None and len(exact) <= MOST_STRINGS else None), query
        if op is kinds.BRANCH:
            parts = [walk(x) for x in arg[1]]
            if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= MOST_STRINGS:
                return frozenset().union(*(e for e, _ in parts)), ALL
            return None, _join("or", [_of_strings(e) if e is not None else q for e, q in parts])
        if op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
            low, high, inner = arg
            exact, query = walk(inner)
            if (low, high) == (0, 1) and exact is not None:
                return frozenset([*exact, ""]), ALL
            if low == high == 1:
                return exact, query
            if low:
                return None, _of_strings(exact) if exact is not None else query
        return None, ALL

    exact, query = walk(_parser.parse(pattern))
    return _of_strings(exact) if exact is not None else query


def _codes(query: tuple) -> set[int]:
    if query[0] == "tri":
        return {query[1]}
    return set().union(*map(_codes, query[1])) if query[0] in ("and", "or") else set()


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def postings(data: np.ndarray, bounds: np.ndarray, codes: np.ndarray) -> dict[int, np.ndarray]:
    """For each wanted trigram, the rows that hold it, in order. ``codes`` is sorted."""
    if len(data) < 3 or not len(codes):
        return {}
    d = _LOWER[data]
    wanted = np.zeros(1 << 16, dtype=bool)  # by first two bytes, a table that stays in the cache
    wanted[codes >> 8] = True
    first = d[:-1].astype(np.uint16)
    first <<= 8
    first |= d[1:]
    at = np.flatnonzero(wanted[first[:-1]])
    code = first[at].astype(np.int64) << 8 | d[at + 2]
    k = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
    row = np.searchsorted(bounds, at, side="right") - 1
    good = (codes[k] == code) & (at + 3 <= bounds[row + 1])
    pairs = np.unique(k[good] * np.int64(len(bounds)) + row[good])
    which, rows = pairs // len(bounds), pairs % len(bounds)
    cuts = np.searchsorted(which, np.arange(len(codes) + 1))
    return {int(c): rows[cuts[i] : cuts[i + 1]] for i, c in enumerate(codes)}


def candidates(query: tuple, index: dict[int, np.ndarray], everyone: np.ndarray) -> np.ndarray:
    """Rows that satisfy a query, by intersecting and uniting posting lists."""
    if query == ALL:
        return everyone
    if query[0] == "tri":
        return index.get(query[1], everyone[:0])
    parts = [candidates(q, index, everyone) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
    return out


def verified(text: str, rule: Rule, pattern: re.Pattern) -> list[tuple[int, str, int]]:
    """Leftmost matches that do not overlap and are long enough, as (start, kind, end)."""
    return [(m.start(), rule.kind, m.end()) for m in pattern.finditer(text) if len(m[rule.group]) >= rule.least]


def scanner(rules: tuple[Rule, ...]) -> Callable[[pa.RecordBatch], list[list[tuple[int, str, int]]]]:
    """A function from a slice of rows to each row's spans, by start and then by order of the rules."""
    queries = [trigram_query(r.pattern) for r in rules]
    codes = np.array(sorted(set().union(*map(_codes, queries))), dtype=np.int64)
    order = {r.kind: i for i, r in enumerate(rules)}
    patterns = []
    for r in rules:
        # one class repeated: its least length can be asked of the expression, which saves short matches
        whole = r.group == 0 and r.least and re.fullmatch(r"\[[^\]]*\]\+", r.pattern)
        patterns.append(re.compile(r.pattern[:-1] + f"{{{r.least},}}", re.ASCII) if whole else r.compiled())

    def scan(batch: pa.RecordBatch) -> list[list[tuple[int, str, int]]]:
        column = batch.column(batch.schema.get_field_index("text"))
        data, bounds = text_buffer(column)
        index, everyone = postings(data, bounds, codes), np.arange(batch.num_rows)
        spans: list[list[tuple[int, str, int]]] = [[] for _ in range(batch.num_rows)]
        texts: dict[int, str] = {}
        for rule, query, pattern in zip(rules, queries, patterns, strict=True):
            for i in candidates(query, index, everyone).tolist():
                if i not in texts:
                    texts[i] = column[i].as_py()
                spans[i] += verified(texts[i], rule, pattern)
        for found in spans:
            found.sort(key=lambda s: (s[0], order[s[1]]))
        return spans

    return scan


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Secrets in every whole text.

    Returns doc_id and spans, array<struct<kind, start, end>> ordered by start and then rule.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(rules)
        for part in slices(batches):
            rows = [[{"kind": k, "start": a, "end": b} for a, k, b in row] for row in find(part)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return text_rows(docs).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def redacted(text: str, spans: list[tuple[int, str, int]]) -> str:
    """A text with each stretch of secrets replaced by its first kind in brackets."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_column(text: str = "text", rules: tuple[Rule, ...] = RULES) -> Column:
    """A text column with secrets replaced; null stays null."""

    @F.pandas_udf("string")
    def redact(column: pd.Series) -> pd.Series:
        find = scanner(rules)
        known = column.notna()
        batch = pa.RecordBatch.from_arrays([pa.array(column[known], pa.string())], ["text"])
        done = []
        for part in slices(iter([batch])):
            texts = part.column("text").to_pylist()
            done += [redacted(t, s) if s else t for t, s in zip(texts, find(part), strict=True)]
        out = column.astype(object).copy()
        out[known] = done
        return out

    return redact(text)


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
