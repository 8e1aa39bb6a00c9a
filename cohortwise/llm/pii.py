"""Operator 5: personal data, by base expressions and a skip-chain conditional random field.

Units of a document are the base matches and other number groups and addresses. The field's nodes
are units with labels none, email, ip, card and phone. Potentials: unit features (weights of a
multinomial logistic regression), neighbouring units (chain), and units of the same normal form, with
the same last seven digits or the same address before the at sign, however far apart (skip edges; repeated
units are tied in a row and each to the nearest base match of its form, so edges are linear in units).

Base matches are observed. Loopy sum-product passing starts at them and goes on in each document until no
message is off by more than ``TOLERANCE``. The step is halved every ``SWEEPS`` sweeps, so that swinging
messages settle; a document whose messages still move when the step is under ``LEAST_STEP`` (4,500 sweeps)
keeps that state. A unit tied to base matches takes their label where its marginal is at least ``SURE``:
these are the spans added. Units without such a tie are left alone, so that plain numbers are never marked.

Potentials are fitted piecewise on the base matches of all documents. Equal units (label and features) are
counted first and enter the regression once, weighted by their share of their label; so labels weigh the
same, and a rare kind is learned whatever else the table holds. Units tied to a base match but not
matched themselves are unlabelled there.

Cases: null text counts as empty; repeated rows give repeated results; an empty table gives an empty
result; without any unit to learn from, the weights are zero. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.textwork import slices, text_rows

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
FEATURES = 1024
HELD = 50_000
SURE = 0.9
SWEEPS = 500
TOLERANCE = 1e-5
STEP = 0.5
LEAST_STEP = 1e-3
OBSERVED = 30.0
AGREE = 100.0

#: The base expressions, so written that each run of characters is read once: a match of ip
#: begins where a run of digits begins, and an address is looked for around each at sign.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Other units: an address with any domain, or a number group, clear of letters and digits on both sides.
HOST = re.compile(r"[A-Za-z0-9.-]++")
NUMBER = re.compile(r"(?<![A-Za-z0-9])\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])*(?![A-Za-z0-9])")
CLEAR = re.compile(r"(?<![A-Za-z0-9])")
_DIGITS = re.compile(r"[^0-9]")

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _addresses(text: str, domain: re.Pattern) -> Iterator[tuple[int, int, int]]:
    """For each at sign: where its run of local characters begins, its own place, and the domain's end."""
    before, at = 0, text.find("@")
    while at >= 0:
        found = domain.match(text, at + 1)
        if found:
            yield before + len(text[before:at].rstrip(LOCAL)), at, found.end()
        before, at = at + 1, text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Base matches by start and then kind: leftmost per kind, failing ones dropped."""
    out: list[Span] = []
    done = 0
    for start, at, end in _addresses(text, DOMAIN):
        start = max(start, done)  # what an earlier match holds is taken
        if start < at:
            out.append((start, 0, end))
            done = end
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def unit_spans(text: str) -> Iterator[tuple[int, int]]:
    """Addresses and number groups, leftmost first, without overlap; an address wins where both begin."""
    done = 0
    number = NUMBER.search(text)
    for start, at, end in _addresses(text, HOST):
        while True:
            clear = CLEAR.search(text, max(start, done), at) if max(start, done) < at else None
            begin = clear.start() if clear else at
            if number is None or number.start() >= begin:
                break
            yield number.span()
            done = number.end()
            number = NUMBER.search(text, done)
        if begin < at:
            yield begin, end
            done = end
            if number and number.start() < done:
                number = NUMBER.search(text, done)
    while number:
        yield number.span()
        number = NUMBER.search(text, number.end())


@dataclass
class Units:
    """Units of one document with labels (0 none, -1 unknown), features, and tied pairs."""

    spans: list[tuple[int, int]] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)
    features: list[list[int]] = field(default_factory=list)
    ties: list[tuple[int, int]] = field(default_factory=list)
    linked: list[bool] = field(default_factory=list)


def _feature(name: str, value: str) -> int:
    return crc32(f"{name}={value}".encode()) % FEATURES


def _shape(piece: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[A-Za-z]", "a", re.sub(r"[0-9]", "9", piece[:80])))


def _keys(piece: str) -> list[str]:
    """Normal forms that tie units."""
    if "@" in piece:
        name = piece.lower().strip(".")
        local = name.split("@")[0]
        return [name] + [f"{local}@"] * (len(local) >= 4)
    digits = _DIGITS.sub("", piece)
    return [digits, f"~{digits[-7:]}"] if len(digits) >= 7 else []


def units_of(text: str, base: list[Span]) -> Units:
    """The document's units: base matches (the first of overlapping ones) and others clear of them."""
    units, taken, at = Units(), [], 0
    for start, kind, end in base:
        if start >= at:
            taken.append((start, end, kind + 1))
            at = end
    found, k = [], 0
    for start, end in unit_spans(text):
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k == len(taken) or taken[k][0] >= end:
            found.append((start, end, 0))
    last: dict[str, int] = {}
    bases: dict[str, list[int]] = {}
    rows = sorted(taken + found)
    keys = [_keys(text[a:b]) for a, b, _ in rows]
    for i, (_, _, label) in enumerate(rows):
        for key in keys[i] if label else ():
            bases.setdefault(key, []).append(i)
    for i, (start, end, label) in enumerate(rows):
        piece = text[start:end]
        before = text[max(0, start - 24) : start].lower().split()
        units.spans.append((start, end))
        units.labels.append(label)
        digits = len(_DIGITS.sub("", piece))
        features = {
            _feature("bias", ""),
            _feature("shape", _shape(piece)),
            _feature("digits", str(min(digits, 20))),
            _feature("marks", "".join(sorted(set(re.sub(r"[A-Za-z0-9]", "", piece[:80]))))),
            _feature("before", before[-1] if before else ""),
        }
        units.features.append(sorted(features))
        for key in keys[i]:
            if key in last and last[key] != i:
                units.ties.append((last[key], i))
            last[key] = i
            if not label and key in bases:
                at = bisect_left(bases[key], i)
                nearest = min(bases[key][max(0, at - 1) : at + 1], key=lambda b: abs(b - i))
                units.ties.append((min(nearest, i), max(nearest, i)))
    units.ties = sorted(set(units.ties))
    units.linked = [any(key in bases for key in own) for own in keys]
    return units


@dataclass
class Field:
    """The field's potentials: unit weights, chain and skip tables. Bounded whatever the corpus."""

    weights: np.ndarray
    bias: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _association(counts: np.ndarray, agree: float = 0.0) -> np.ndarray:
    """Log of how much more often two labels meet than by chance; ``agree`` is a prior count of equal labels."""
    c = counts + counts.T + 1.0 + agree * np.eye(len(counts))
    p = c / c.sum()
    return np.log(p) - np.log(p.sum(axis=1)[:, None]) - np.log(p.sum(axis=0)[None, :])


def fit(docs: DataFrame) -> Field:
    """Fit the potentials piecewise on all documents."""
    schema = pa.schema([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("at", pa.list_(pa.int32())), ("n", pa.int64())])

    def packed(held: Counter) -> pa.RecordBatch:
        columns = [*zip(*held), held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for part in slices(batches):
            for text in part.column("text").to_pylist():
                u = units_of(text, base_spans(text))
                known = [lab if lab or not tied else -1 for lab, tied in zip(u.labels, u.linked, strict=True)]
                held.update(("unit", lab, 0, tuple(f)) for lab, f in zip(known, u.features, strict=True) if lab >= 0)
                held.update(("chain", a, b, ()) for a, b in zip(known, known[1:]) if a >= 0 and b >= 0)
                held.update(("skip", known[a], known[b], ()) for a, b in u.ties if known[a] >= 0 and known[b] >= 0)
            if len(held) > HELD:
                yield packed(held)
                held = Counter()
        if held:
            yield packed(held)

    counts = text_rows(docs).mapInArrow(observe, "kind string, a int, b int, at array<int>, n long")
    seen = counts.groupBy("kind", "a", "b", "at").agg(F.sum("n").alias("n")).persist()
    try:
        tables = {k: np.zeros((len(LABELS), len(LABELS))) for k in ("chain", "skip")}
        labels = {}
        for r in seen.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect():  # at most 55 rows
            if r["kind"] == "unit":
                labels[r["a"]] = r["n"]
            else:
                tables[r["kind"]][r["a"], r["b"]] = r["n"]
        weights, bias = np.zeros((FEATURES, len(LABELS))), np.zeros(len(LABELS))
        if len(labels) > 1:
            vector = F.udf(lambda at: SparseVector(FEATURES, at, np.ones(len(at))), VectorUDT())
            total = F.create_map(*[F.lit(x) for pair in sorted(labels.items()) for x in pair])
            units = seen.where("kind = 'unit'").withColumn("weight", F.col("n") / total[F.col("a")])
            ready = units.select(F.col("a").cast("double").alias("label"), vector("at").alias("features"), "weight").persist()
            try:
                model = LogisticRegression(maxIter=40, regParam=1e-3, standardization=False, family="multinomial", weightCol="weight").fit(ready)
            finally:
                ready.unpersist()
            used = model.coefficientMatrix.toArray().shape[0]
            weights[:, :used] = model.coefficientMatrix.toArray().T
            bias[:used] = model.interceptVector.toArray()
            bias[used:] = -OBSERVED
        return Field(weights, bias, _association(tables["chain"]), _association(tables["skip"], AGREE))
    finally:
        seen.unpersist()


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(model: Field, documents: list[Units]) -> np.ndarray:
    """Label marginals of all units of some documents, by loopy sum-product with damping."""
    shift = np.cumsum([0, *(len(u.spans) for u in documents)])
    score = np.array([model.weights[f].sum(axis=0) + model.bias for u in documents for f in u.features]).reshape(-1, len(LABELS))
    labels = np.array([lab for u in documents for lab in u.labels], dtype=np.int64)
    seen = np.flatnonzero(labels > 0)
    score[seen, labels[seen]] += OBSERVED
    chain = [(s + i, s + i + 1) for u, s in zip(documents, shift) for i in range(len(u.spans) - 1)]
    ties = [(s + a, s + b) for u, s in zip(documents, shift) for a, b in u.ties]
    edges = np.array(chain + ties, dtype=np.int64).reshape(-1, 2)
    table = np.concatenate([np.broadcast_to(model.chain, (len(chain), 5, 5)), np.broadcast_to(model.skip, (len(ties), 5, 5))])
    # a message in each direction; message k and k + n are each other's reverse
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    table = np.concatenate([table, table.transpose(0, 2, 1)])
    # documents end one by one, so that none depends on those it shares a slice with
    owner = np.searchsorted(shift, edges[:, 0], side="right") - 1
    message = np.zeros((len(source), len(LABELS)))
    # what is observed speaks first: otherwise many like units would settle among themselves before they hear of it
    told = labels[source] > 0
    message[told] = table[told, labels[source[told]]]
    message[told] -= message[told].max(axis=1, keepdims=True)
    belief, step, sweep = score.copy(), STEP, 0
    np.add.at(belief, target, message)
    while len(owner) and step >= LEAST_STEP:
        back = np.roll(message, len(owner), axis=0)
        new = _logsumexp((belief[source] - back)[:, :, None] + table, 1)
        new -= new.max(axis=1, keepdims=True)
        change = new - message
        message += step * change
        np.add.at(belief, target, step * change)
        off = np.zeros(len(documents))
        np.maximum.at(off, np.tile(owner, 2), np.abs(change).max(axis=1))
        live = off[owner] > TOLERANCE
        if not live.all():
            both = np.tile(live, 2)
            owner, source, target, table, message = owner[live], source[both], target[both], table[both], message[both]
        sweep += 1
        if sweep % SWEEPS == 0:
            step /= 2
    return np.exp(belief - _logsumexp(belief, 1)[:, None]) if len(belief) else belief


def find(docs: DataFrame, model: Field) -> DataFrame:
    """Personal data in every whole text.

    Returns doc_id and two lists of spans, array<struct<kind, start, end>> by start and then kind:
    base, and spans (base and what the field adds).
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    row = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            base = [base_spans(t) for t in texts]
            # only documents with a base match can get more
            some = [i for i, b in enumerate(base) if b]
            units = [units_of(texts[i], base[i]) for i in some]
            everything, at = [list(b) for b in base], 0
            p = marginals(model, units) if some else np.zeros((0, len(LABELS)))
            best, sure = p.argmax(axis=1), p.max(axis=1) >= SURE
            for i, u in zip(some, units, strict=True):
                for k, (a, b) in enumerate(u.spans):
                    if u.labels[k] == 0 and u.linked[k] and sure[at + k] and best[at + k]:
                        everything[i].append((a, int(best[at + k]) - 1, b))
                everything[i].sort()
                at += len(u.spans)
            columns = [part.column("doc_id"), pa.array(map(row, base), kind), pa.array(map(row, everything), kind)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "base", "spans"])

    span = "array<struct<kind: string, start: long, end: long>>"
    return text_rows(docs).mapInArrow(run, f"doc_id long, base {span}, spans {span}")
