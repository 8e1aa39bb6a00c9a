"""Operator 11: alignment of the tokens that two tokenizers make of one text.

Each tokenizer gives an ascending list of byte offsets at which its tokens end. The shorter list drives
a galloping intersection: blocks of it bracket themselves in the longer one by steps that double, and
are looked up by binary search inside the bracket. Offsets that both lists hold cut the tokens into
groups; the ranks at which a token's own start and end fall in the other list give the range of tokens
that it overlaps.

A text is encoded with one space before it, by a byte-level vocabulary (side a) and a piece model (side
b), without special tokens; their strings inside a text are plain text. Before a space that follows a
visible character neither tokenizer joins anything (checked for the pieces when they are loaded), so a
text is encoded in the parts between such spaces, and parts met before are looked up. Memory is bounded
by the texts' longest run without such a space.

Cases: null and empty texts, and texts that either tokenizer changes (its token bytes joined are not
the text, as when the text holds U+2581), have no tokens; repeated rows give repeated results and count
each; an empty table gives an empty one; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from pathlib import Path
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.llm.bpe import byte_letters
from cohortwise.llm.textwork import settle, slices, text_rows

DRIVEN = 256
BLOCK_BYTES = 4 << 20
KNOWN_PARTS = 1 << 17
LONGEST_KNOWN = 48
TOGETHER = 2048

_UNEVEN = re.compile(r"(?<![!-~\w]) | \Z")
_EVEN = re.compile(r"[!-~\w]\Z")
_CUT = re.compile(r"(?<=[!-~\w])(?= .)", re.DOTALL)


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in two ascending lists of the values that both hold, driven by the first list."""
    in_short, in_long, at = [], [], 0
    for k in range(0, len(short), DRIVEN):
        wanted = short[k : k + DRIVEN]
        step = len(wanted)
        while at + step < len(long) and long[at + step - 1] < wanted[-1]:
            step *= 2
        bracket = long[at : at + step]
        place = np.searchsorted(bracket, wanted)
        inside = np.flatnonzero(place < len(bracket))
        hit = inside[bracket[place[inside]] == wanted[inside]]
        in_short.append(hit + k)
        in_long.append(place[hit] + at)
        at += int(place[-1])
        if at >= len(long):
            break
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(in_short), np.concatenate(in_long)) if in_short else (none, none)


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the ends they share; the shorter one drives."""
    if len(a) <= len(b):
        return gallop(a, b)
    in_b, in_a = gallop(b, a)
    return in_a, in_b


def overlap_ranges(ends: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token its overlapping tokens of the other side: first and one past the last.

    Both lists hold ends of tokens of the same bytes, none of them empty.
    """
    starts = np.concatenate([np.zeros(1, dtype=ends.dtype), ends[:-1]])
    return np.searchsorted(others, starts, side="right"), np.searchsorted(others, ends, side="left") + 1


class Tokenizers:
    """Both tokenizers and the bytes of their tokens, loaded in a task."""

    def __init__(self, vocabulary: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(vocabulary)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        back = {c: b for b, c in enumerate(byte_letters())}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            known = all(c in back for c in token)
            self.a_bytes[i] = bytes(back[c] for c in token) if known else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_length, self.b_length = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        #: no piece goes on with a space after another character, so a cut before such a space changes nothing
        self.may_cut = not any("▁" in p.lstrip("▁") for p in pieces)
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.older = self.known

    def parts(self, text: str) -> list[str]:
        """A text in parts, to be encoded with a space before each; the spaces between them are left out."""
        if not self.may_cut:
            return [text]
        if not _UNEVEN.search(text):
            return text.split(" ")
        return [p[1:] for p in _CUT.split(f" {text}")]

    def learn(self, parts: list[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """Ids of parts on both sides, packed in 32 bits; no ids where the tokens are not the part's bytes."""
        a = [e.ids for e in self.a.encode_batch([f" {p}" for p in parts], add_special_tokens=False)]
        b = self.b.encode(parts, num_threads=1)
        found: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        for part, *ids in zip(parts, a, b, strict=True):
            data = b" " + part.encode()
            for out, strings, own in zip(found, (self.a_bytes, self.b_bytes), ids, strict=True):
                out[part] = pack(f"<{len(own)}I", *own) if b"".join(map(strings.__getitem__, own)) == data else b""
        return found

    def learn_together(self, parts: list[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """The same for parts that end with a visible character: many are encoded as one text and told apart by their ends."""
        found: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        runs = [parts[k : k + TOGETHER] for k in range(0, len(parts), TOGETHER)]
        texts = [" ".join(run) for run in runs]
        a = [e.ids for e in self.a.encode_batch([f" {t}" for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        for run, text, *ids in zip(runs, texts, a, b, strict=True):
            data = b" " + text.encode()
            ends = np.cumsum([len(p.encode()) + 1 for p in run])
            if not all(b"".join(map(s.__getitem__, x)) == data for s, x in zip((self.a_bytes, self.b_bytes), ids, strict=True)):
                for out, own in zip(found, self.learn(run), strict=True):
                    out |= own
                continue
            for out, length, own in zip(found, (self.a_length, self.b_length), ids, strict=True):
                own = np.array(own, dtype="<u4")
                cuts = (4 * np.searchsorted(np.cumsum(length[own]), ends, side="right")).tolist()
                packed = own.tobytes()
                out |= {p: packed[low:high] for p, low, high in zip(run, [0, *cuts], cuts, strict=False)}
        return found

    def look_up(self, wanted: set[str]) -> list[str]:
        """Have the ids of all wanted parts in ``known``; returns those too long to be kept there.

        Two generations: when the younger one is full it becomes the older one, from which parts asked
        for again come back. So memory is bounded and frequent parts stay.
        """
        if len(self.known[0]) > KNOWN_PARTS:
            self.older, self.known = self.known, ({}, {})
        new = []
        for part in wanted.difference(self.known[0]):
            if part in self.older[0]:
                for known, older in zip(self.known, self.older, strict=True):
                    known[part] = older[part]
            else:
                new.append(part)
        even = [p for p in new if _EVEN.search(p)]
        odd = list(set(new).difference(even))
        for some, learn in ((even, self.learn_together), (odd, self.learn)):
            if some:
                for known, own in zip(self.known, learn(some), strict=True):
                    known |= own
        return [p for p in new if len(p) > LONGEST_KNOWN]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides for each text; none where the tokens are not the text's bytes."""
        parts = [self.parts(t) if t else [] for t in texts]
        long = self.look_up(set().union(*parts))
        ids = [[np.frombuffer(b"".join(map(known.__getitem__, p)), dtype="<u4") for p in parts] for known in self.known]
        for part in long:
            del self.known[0][part], self.known[1][part]
        size = [len(t.encode()) + 1 if t else 0 for t in texts]
        same = [self.a_length[x].sum() == n == self.b_length[y].sum() for x, y, n in zip(*ids, size, strict=True)]
        return tuple([x if good else x[:0] for x, good in zip(side, same, strict=True)] for side in ids)


_LOADED: dict[int, Tokenizers] = {}


def shared_tokenizers(spark, vocabulary: str, model: str) -> Callable[[], Tokenizers]:
    """Broadcast two vocabulary files (fixed sizes, 2 MB here) and load them once per worker."""
    source = spark.sparkContext.broadcast((Path(vocabulary).read_text(encoding="utf-8"), Path(model).read_bytes()))

    def load() -> Tokenizers:
        key = hash(source.value)
        if key not in _LOADED:
            _LOADED[key] = Tokenizers(*source.value)
        return _LOADED[key]

    return load


@dataclass
class Aligned:
    """Alignments of some rows, one after the other: ids, row bounds, and where groups end on each side."""

    a: np.ndarray
    b: np.ndarray
    a_rows: np.ndarray
    b_rows: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    a_cuts: np.ndarray
    b_cuts: np.ndarray
    group_rows: np.ndarray


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return np.concatenate([np.zeros(0, dtype="<u4"), *lists]).astype(np.int64), bounds


def align_texts(tokenizers: Tokenizers, texts: list[str]) -> Aligned:
    """Align some texts at once: their bytes are laid one after the other, and each text's end is common."""
    (a, a_rows), (b, b_rows) = map(_flat, tokenizers.encode(texts))
    a_ends, b_ends = np.cumsum(tokenizers.a_length[a]), np.cumsum(tokenizers.b_length[b])
    in_a, in_b = common_ends(a_ends, b_ends)
    a_cuts, b_cuts = in_a + 1, in_b + 1
    return Aligned(a, b, a_rows, b_rows, a_ends, b_ends, a_cuts, b_cuts, np.searchsorted(a_cuts, a_rows, side="right"))


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))


def _own(values: np.ndarray, bounds: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Values counted from the beginning of their own row."""
    return values - np.repeat(base, np.diff(bounds))


def align(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """The alignment itself, for every whole text.

    Args: ``docs`` with doc_id and text; the paths of a byte-level vocabulary and of a piece model.
    Returns doc_id and arrays of integers: a_ids, b_ids; a_cuts, b_cuts (for each group, how many tokens
    of the side the text has up to the group's end); b_from, b_to (for each token of side a the tokens of
    side b that it overlaps, from the first to before the last).
    """
    load = shared_tokenizers(docs.sparkSession, vocabulary, model)
    names = ["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts", "b_from", "b_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = align_texts(load(), part.column("text").to_pylist())
            first, last = overlap_ranges(x.a_ends, x.b_ends)
            columns = [
                part.column("doc_id"),
                _lists(x.a, x.a_rows),
                _lists(x.b, x.b_rows),
                _lists(_own(x.a_cuts, x.group_rows, x.a_rows[:-1]), x.group_rows),
                _lists(_own(x.b_cuts, x.group_rows, x.b_rows[:-1]), x.group_rows),
                _lists(_own(first, x.a_rows, x.b_rows[:-1]), x.a_rows),
                _lists(_own(last, x.a_rows, x.b_rows[:-1]), x.a_rows),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, " + ", ".join(f"{n} array<int>" for n in names[1:])
    return text_rows(docs).mapInArrow(run, schema)


class GroupText:
    """Digests of ``a1,a2|b1;a3|b2,b3``, from tables of each id's digits with each separator."""

    def __init__(self, most: int):
        digits = np.array([str(i) for i in range(most)], dtype="S")
        self.tables = {mark: np.char.add(digits, mark) for mark in (b",", b"|", b";")}

    def digests(self, x: Aligned) -> list[str]:
        groups = np.arange(len(x.a_cuts))
        a_group, b_group = (np.repeat(groups, np.diff(cuts, prepend=0)) for cuts in (x.a_cuts, x.b_cuts))
        first_b = np.concatenate([[0], x.b_cuts[:-1]])
        out = np.empty(len(x.a) + len(x.b), dtype=self.tables[b","].dtype)
        # a group's tokens of side a come before those of side b
        a_at, b_at = np.arange(len(x.a)), np.arange(len(x.b))
        if len(groups):
            a_at, b_at = a_at + first_b[a_group], b_at + x.a_cuts[b_group]
        out[a_at], out[b_at] = self.tables[b","][x.a], self.tables[b","][x.b]
        ends = x.a_cuts - 1
        out[a_at[ends]] = self.tables[b"|"][x.a[ends]]
        ends = x.b_cuts - 1
        out[b_at[ends]] = self.tables[b";"][x.b[ends]]
        found, bounds = [], x.a_rows + x.b_rows
        for r in range(len(bounds) - 1):
            text = out[bounds[r] : bounds[r + 1]].tobytes().replace(b"\0", b"")
            found.append(sha256(text[:-1]).hexdigest() if text else "")
        return found


def aligned_blocks(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """Alignments in short, for counting links: a row for neighbouring texts of about ``BLOCK_BYTES``.

    Returns block (a number, once the result is written), arrays with an entry for each text (doc_id, n_a,
    n_b, groups_sha256, n_links), pair and n (the distinct links of the block, a id * 2**32 + b id, and how
    many there are) and codes (packed places in ``pair`` of all links, in order).
    """
    load = shared_tokenizers(docs.sparkSession, vocabulary, model)
    names = ["block", "doc_id", "n_a", "n_b", "groups_sha256", "n_links", "pair", "n", "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, rows, links = TaskContext.get().partitionId() << 32, 0, [], []
        tokenizers = load()
        texts = GroupText(max(len(tokenizers.a_bytes), len(tokenizers.b_bytes)))

        def made() -> pa.RecordBatch:
            codes, pair = pd.factorize(np.concatenate(links))
            per_text = [pa.concat_arrays(x) for x in zip(*rows, strict=True)]
            values = [*per_text, pa.array(pair), pa.array(np.bincount(codes, minlength=len(pair)))]
            columns = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values]
            packed = codes.astype(np.uint16 if len(pair) <= 1 << 16 else np.uint32).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([block]), *columns, pa.array([packed], pa.binary())], names)

        for part in slices(batches):
            x = align_texts(tokenizers, part.column("text").to_pylist())
            counts = [pa.array(np.diff(bounds)) for bounds in (x.a_rows, x.b_rows, x.group_rows)]
            rows.append([part.column("doc_id"), *counts[:2], pa.array(texts.digests(x), pa.string()), counts[2]])
            links.append(x.a[x.a_cuts - 1] << 32 | x.b[x.b_cuts - 1])
            size += part.nbytes
            if size >= BLOCK_BYTES:
                yield made()
                block, size, rows, links = block + 1, 0, [], []
        if rows:
            yield made()

    kinds = ["long", *(f"array<{k}>" for k in ("long", "long", "long", "string", "long", "long", "long")), "binary"]
    return text_rows(docs).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def link_statistics(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """How well each document's links agree with the corpus.

    A link is a pair of tokens, one of each side, that end together; the count of a pair of ids is the
    number of its links in all documents. Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose
    pair has the highest count of all pairs with its b id, ties included), count_sum (over links) and
    groups_sha256, all counts long.

    Links are counted within blocks of documents first, so that the most common pair has one row in each
    block; the counts go back to the blocks that hold the pair, and nowhere else.
    """
    blocks = settle(aligned_blocks(docs, vocabulary, model), "aligned")
    local = blocks.select("block", F.posexplode(F.arrays_zip("pair", "n")).alias("place", "link"))
    local = local.select("block", "place", F.col("link.pair").alias("pair"), F.col("link.n").alias("n"))
    pairs = local.groupBy("pair").agg(F.sum("n").alias("n"))
    # a window holds at most as many pairs as side a has ids
    highest = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))
    pairs = pairs.select("pair", "n", (F.col("n") == highest).alias("best"))
    known = local.select("block", "place", "pair").join(pairs, "pair").select(F.col("block").alias("within"), "place", "n", "best")

    def judge(rows: pa.Table, counts: pa.Table) -> pa.Table:
        order = np.argsort(counts.column("place").to_numpy())
        n, best = counts.column("n").to_numpy()[order], counts.column("best").to_numpy(zero_copy_only=False)[order]
        packed = rows.column("codes")[0].as_buffer()
        codes = np.frombuffer(packed, dtype=np.uint16 if len(n) <= 1 << 16 else np.uint32)
        doc_id, n_a, n_b, digest, own = (pc.list_flatten(rows.column(c)) for c in ("doc_id", "n_a", "n_b", "groups_sha256", "n_links"))
        bounds = np.concatenate([[0], np.cumsum(own.to_numpy())])

        def summed(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values[codes], dtype=np.int64)])
            return total[bounds[1:]] - total[bounds[:-1]]

        return pa.table([doc_id, n_a, n_b, own, own, summed(best), summed(n), digest], names=[x.split()[0] for x in schema.split(", ")])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    wanted = blocks.select("block", "doc_id", "n_a", "n_b", "groups_sha256", "n_links", "codes")
    return wanted.groupBy("block").cogroup(known.groupBy("within")).applyInArrow(judge, schema)
