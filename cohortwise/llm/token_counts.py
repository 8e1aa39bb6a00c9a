"""Operator 1: the exact token count at every prefix of a text.

A prefix dynamic program over the bytes of a piece keeps, for each prefix, the last token of its
BPE encoding and the number of tokens: the encoding of a prefix is the encoding of a shorter prefix
and one more token, namely the only vocabulary string that ends there and may stand next to the
shorter prefix's last token. Counts of pieces add up to counts at every prefix of the text, so that
truncation and budget questions need no second encoding.

A prefix here is the text cut after any code point, encoded on its own. Cases: null text counts as
empty (0 tokens, counts [0]); repeated rows give repeated results; an empty table an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.bpe import PieceCache, Vocabulary, shared_vocabulary, split_special, splitter
from cohortwise.llm.textwork import text_rows

NEVER = 1 << 60
COUNTED_PIECES = 1 << 19
MOST_PAIRS = 1 << 19


class PrefixCounter:
    """Token counts of all prefixes, by piece and by text."""

    def __init__(self, vocabulary: Vocabulary):
        self.special = vocabulary.special
        self.find = splitter()
        self.merges = vocabulary.merges
        self.parts = {made: (key >> 32, key & 0xFFFFFFFF, rank) for key, (rank, made) in vocabulary.merges.items()}
        # every beginning of a vocabulary string: its token, or -1 if it is only a beginning
        reachable = {vocabulary.strings[i]: i for i in [*vocabulary.symbols, *self.parts]}
        self.tree = {s[:k]: -1 for s in reachable for k in range(1, len(s))} | reachable
        self.fits: dict[int, bool] = {}
        self.pieces = PieceCache(self.piece_counts, COUNTED_PIECES)

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols at one edge of a token's merge tree and the rank at which each is used up."""
        out, used = [], NEVER
        while True:
            out.append((token, used))
            if token not in self.parts:
                return out
            used = self.parts[token][2]
            token = self.parts[token][side]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens stay apart: no symbols at the seam would merge earlier.

        A merge at the seam happens if both symbols still exist at its rank. At equal ranks the
        leftmost pair goes first: a merge inside the left token before the seam, the seam before
        one inside the right token.
        """
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            known = True
            others = self.spine(right, 0)
            for a, a_used in self.spine(left, 1):
                for b, b_used in others:
                    found = self.merges.get(a << 32 | b)
                    if found and found[0] < a_used and found[0] <= b_used:
                        known = False
            if len(self.fits) > MOST_PAIRS:
                self.fits.clear()
            self.fits[key] = known
        return known

    def byte_counts(self, data: bytes) -> list[int]:
        """Token counts of the prefixes of a piece, at every byte (index 0: nothing)."""
        n = len(data)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        known, fits, tree = self.fits, self.may_follow, self.tree
        for start in range(n):
            before, more = last[start], count[start] + 1
            for end in range(start + 1, n + 1):
                token = tree.get(data[start:end])
                if token is None:
                    break  # no vocabulary string begins like this
                if token < 0 or count[end]:
                    continue
                if start:
                    ok = known.get(before << 32 | token)
                    if ok is None:
                        ok = fits(before, token)
                    if not ok:
                        continue
                last[end], count[end] = token, more
        return count

    def piece_counts(self, piece: str) -> bytes:
        """Counts after each code point of a piece, as unsigned 32-bit integers."""
        data = piece.encode()
        count = self.byte_counts(data)[1:]
        if len(data) != len(piece):  # counts inside a character are left out
            count = [c for c, after in zip(count, data[1:] + b" ", strict=True) if after & 0xC0 != 0x80]
        if piece in ("'re", "'ve", "'ll"):  # a contraction's second prefix is two pieces
            count[1] = self.total("'") + self.total(piece[1])
        return pack(f"<{len(count)}I", *count)

    def total(self, piece: str) -> int:
        return int.from_bytes(self.pieces[piece][-4:], "little")

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token counts of ``text[:k]`` for k from 0 to its length."""
        out, base = [np.zeros(1, dtype=np.int64)], 0
        before, after = "", ""  # the ordinary part so far and the piece it ends with
        for part, special in split_special(text, self.special):
            if special is None:
                counts, after = self.ordinary(part)
                out.append(counts + base)
                before = part
            else:
                # inside a special string the prefix is ordinary text and may join the last piece
                start = base - self.count(after)
                joined = [start + self.count(after + part[:k]) for k in range(1, len(part))]
                base += 1
                out.append(np.array([*joined, base], dtype=np.int64))
                before = after = ""
            if before and special is None:
                base = int(out[-1][-1])
        return np.concatenate(out)

    def count(self, text: str) -> int:
        return sum(self.total(p) for p in self.find(text))

    def ordinary(self, text: str) -> tuple[np.ndarray, str]:
        """Counts at every prefix of a text without special strings, and its last piece."""
        pieces = self.find(text)
        if not pieces:
            return np.zeros(0, dtype=np.int64), ""
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        counts = np.frombuffer(b"".join(map(self.pieces.__getitem__, pieces)), dtype="<u4").astype(np.int64)
        ends = np.cumsum(lengths)
        totals = np.cumsum(counts[ends - 1])
        counts[lengths[0] :] += np.repeat(totals[:-1], lengths[1:])
        if re.search(r"\s\s", text):
            # A run of white space gives its last character to the next piece only when something
            # follows; cut right after the run, it is one piece.
            for i in range(len(pieces) - 1):
                if pieces[i].isspace() and pieces[i + 1][0].isspace():
                    whole = pieces[i] + pieces[i + 1][0]
                    counts[ends[i]] = (totals[i - 1] if i else 0) + self.count(whole)
        return counts, pieces[-1]


def _counter(load: Callable[[], tuple[Vocabulary, dict]]) -> PrefixCounter:
    tables, kept = load()
    if "count" not in kept:
        kept["count"] = PrefixCounter(tables)
    return kept["count"]


def within(counts: np.ndarray, budget: int) -> int:
    """The length of the longest prefix that needs at most ``budget`` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


def token_counts(docs: DataFrame, vocabulary: str, budgets: list[int], keep_prefixes: bool = True) -> DataFrame:
    """Token counts of whole texts and answers to budget questions.

    Args: ``docs`` with doc_id and text; ``vocabulary``, the path of a byte-level BPE file;
    ``budgets``, token limits to answer; ``keep_prefixes`` adds the stored table itself.
    Returns doc_id, n_bytes and n_tokens (long), fits (array<long>: for each budget the number of
    code points of the longest prefix within it), and prefix_counts (array<int>, one per prefix,
    from the empty one) if asked for.
    """
    load = shared_vocabulary(docs.sparkSession, vocabulary)
    names = ["doc_id", "n_bytes", "n_tokens", "fits"] + ["prefix_counts"] * keep_prefixes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(load)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [t.as_py() for t in part.column("text")]
                counts = [counter.prefix_counts(t) for t in texts]
                columns = [
                    part.column("doc_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array([int(c[-1]) for c in counts], pa.int64()),
                    pa.array([[within(c, b) for b in budgets] for c in counts], pa.list_(pa.int64())),
                ]
                if keep_prefixes:
                    columns.append(pa.array([c.astype(np.int32) for c in counts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_bytes long, n_tokens long, fits array<long>" + ", prefix_counts array<int>" * keep_prefixes
    return text_rows(docs).mapInArrow(run, schema)


def truncate(docs: DataFrame, counted: DataFrame, budget: int, budgets: list[int] | None = None) -> DataFrame:
    """Texts cut to ``budget`` tokens, from counts made before, without encoding again.

    With stored prefix counts (``keep_prefixes``) any budget is answered; without, one of ``budgets``,
    the list that the counts were made for. Rows are matched by doc_id, which must be unique here.
    Returns doc_id and text.
    """
    if "prefix_counts" in counted.columns:
        longest = F.transform("prefix_counts", lambda c, i: F.when(c <= budget, i))
        kept = counted.select("doc_id", F.array_max(longest).alias("keep"))
    elif budgets and budget in budgets:
        kept = counted.select("doc_id", F.col("fits")[budgets.index(budget)].cast("int").alias("keep"))
    else:
        raise ValueError(f"counts for {budgets} cannot answer {budget}: keep the prefix counts")
    return text_rows(docs).join(kept, "doc_id").select("doc_id", F.expr("substring(text, 1, keep)").alias("text"))
