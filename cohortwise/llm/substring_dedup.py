"""Operator 6: removal of repeated word sequences, found by difference-cover anchors.

A window is ``WINDOW`` consecutive words of a document. Two equal windows may start at any places i
and j; as COVER is a difference cover modulo PERIOD, some shift below PERIOD takes both to cover
positions. So runs of ``ANCHOR`` words are hashed at cover positions only (4 of 13), and equal
windows share an anchor at the same shift.

Anchors that occur once are settled by that. Around the others the match is extended: the windows
that hold a repeated anchor are compared whole, by their own hash, and the first in order of doc_id
and place stays. Nothing is paired: an anchor or window held by a third of all documents costs each
group of documents one entry.

Documents are dealt into ranges of doc_id, cut by bytes of text; an id (or rows without one) with more text
than a range is cut further by a hash of the text, and copies of one text in it are worked on once. Each range sends, per bucket of hashes, its distinct
hashes in order, as one packed row; a bucket answers with one bit for each hash in the same order,
which is all that travels back to the texts.

Hashes have 64 bits. Cases: null text counts as empty; a document of fewer words than a window
keeps all; rows without doc_id come last; equal doc_ids are ordered by a hash of their text; repeated rows
count as later copies; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.textwork import SLICE_BYTES, range_parts, run_hashes, text_buffer, text_rows, word_hashes

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
GROUP_BYTES = 6 << 20
NO_ID = 1 << 30

PACKED = "bucket long, part int, hashes binary, again binary"
ANSWER = "part int, step int, bucket long, bits binary"


class Group:
    """The documents of one range, in order, with the places of their words."""

    def __init__(self, table: pa.Table):
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        marks, copies = table.column("mark").to_pylist(), table.column("copies").to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (ids[i] is None, ids[i] or 0, marks[i], texts[i]))
        self.ids, self.texts, self.copies = [ids[i] for i in order], [texts[i] for i in order], [copies[i] for i in order]
        words, counts, at, size = [], [np.zeros(1, dtype=np.int64)], 0, 0
        for to, text in enumerate(self.texts, 1):
            size += len(text)
            if size >= SLICE_BYTES or to == len(self.texts):
                hashes, _, _, rows = word_hashes(*text_buffer(pa.array(self.texts[at:to], pa.large_string())), lower=False)
                words.append(hashes)
                counts.append(np.diff(rows))
                at, size = to, 0
        self.words = np.concatenate(words) if words else np.zeros(0, dtype=np.uint64)
        counts = np.concatenate(counts)
        self.rows = np.cumsum(counts)  # where each document's words begin
        row = np.repeat(np.arange(len(self.texts)), counts[1:])
        self.place = np.arange(len(self.words)) - self.rows[row]
        self.left = self.rows[row + 1] - np.arange(len(self.words))  # words from here to the document's end

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of anchors and their hashes."""
        cover = np.zeros(PERIOD, dtype=bool)
        cover[list(COVER)] = True
        at = np.flatnonzero(cover[self.place % PERIOD] & (self.left >= ANCHOR))
        return at, run_hashes(self.words, ANCHOR)[at] if len(at) else np.zeros(0, dtype=np.uint64)

    def windows(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of windows that hold one of these repeated anchors (places), in order."""
        mark = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.add.at(mark, repeated + 1, 1)
        before = np.cumsum(mark)
        start = np.flatnonzero(self.left >= WINDOW)
        start = start[before[start + PERIOD] > before[start]]
        return start, run_hashes(self.words, WINDOW)[start] if len(start) else np.zeros(0, dtype=np.uint64)


def _packed(hashes: np.ndarray, part: int, shift: np.uint64) -> pa.Table:
    """Distinct hashes in order, cut by bucket (high bits); ``again``: which of them occur twice here."""
    values, counts = np.unique(hashes, return_counts=True)
    bucket = (values >> shift).astype(np.int64) if shift < 64 else np.zeros(len(values), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(cuts[1:], len(values))
    return pa.table(
        {
            "bucket": pa.array(bucket[cuts], pa.int64()),
            "part": pa.array([part] * len(cuts), pa.int32()),
            "hashes": pa.array([values[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
            "again": pa.array([np.packbits(counts[a:b] > 1).tobytes() for a, b in zip(cuts, ends)], pa.binary()),
        }
    )


def _answer(step: int, decide: Callable) -> Callable[[pa.Table], pa.Table]:
    """One bucket: joins the hashes of all ranges and answers each range with bits."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("part")
        parts = table.column("part").to_pylist()
        lists = [np.frombuffer(x, dtype=np.uint64) for x in table.column("hashes").to_pylist()]
        again = [np.unpackbits(np.frombuffer(x, dtype=np.uint8))[: len(v)] for x, v in zip(table.column("again").to_pylist(), lists)]
        sizes = np.array([len(v) for v in lists])
        bits = decide(np.concatenate(lists), np.concatenate(again).astype(bool))
        ends = np.cumsum(sizes)
        return pa.table(
            {
                "part": pa.array(parts, pa.int32()),
                "step": pa.array([step] * len(parts), pa.int32()),
                "bucket": table.column("bucket"),
                "bits": pa.array([np.packbits(bits[e - n : e]).tobytes() for e, n in zip(ends, sizes)], pa.binary()),
            }
        )

    return run


def _repeated(hashes: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Whether a hash occurs in two ranges, or twice in one."""
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    more = counts > 1
    more[inverse[again]] = True
    return more[inverse]


def _first(hashes: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Whether this range is the first that holds a hash (ranges come in order)."""
    first = np.zeros(len(hashes), dtype=bool)
    first[np.unique(hashes, return_index=True)[1]] = True
    return first


def _flags(hashes: np.ndarray, answers: pa.Table, step: int, shift: np.uint64) -> np.ndarray:
    """The answered bit of each hash: a bucket's bits stand for its distinct hashes in order."""
    values, inverse = np.unique(hashes, return_inverse=True)
    if not len(values):
        return np.zeros(0, dtype=bool)
    own = answers.filter(pc.equal(answers.column("step"), step)).sort_by("bucket")
    sizes = np.unique(values >> shift, return_counts=True)[1]
    bits = [np.unpackbits(np.frombuffer(x, dtype=np.uint8))[:n] for x, n in zip(own.column("bits").to_pylist(), sizes.tolist(), strict=True)]
    return np.concatenate(bits).astype(bool)[inverse]


def repeats_removed(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Remove each word that lies in a window whose word sequence also starts earlier.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; earlier means a smaller doc_id, or the same
    document and an earlier start; windows are judged on the input. ``group_bytes`` of text are
    worked on in one task at a time. Returns doc_id, n_words, n_removed and kept (the words left,
    joined by one space).
    """
    rows = text_rows(docs).withColumn("mark", F.xxhash64("text"))
    parts, split, part = range_parts(rows, group_bytes)
    shift = np.uint64(64 - max(6, parts.bit_length()))
    placed = rows.withColumn("part", part).withColumn("copies", F.lit(1).cast("long"))
    if split:  # here copies of a row could fill a part: they become one row with their number
        shared_ids = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in split], "part int"))
        many = placed.join(shared_ids, "part", "left_semi").groupBy("doc_id", "text", "mark", "part").agg(F.count("*").alias("copies"))
        placed = placed.join(shared_ids, "part", "left_anti").unionByName(many)
    # one exchange of the texts, which all three passes below read
    dealt = placed.select("doc_id", "text", "mark", "part", "copies").repartition("part")

    def send_anchors(key: tuple, table: pa.Table) -> pa.Table:
        return _packed(Group(table).anchors()[1], key[0].as_py(), shift)

    def candidate_windows(table: pa.Table, answers: pa.Table) -> tuple[Group, np.ndarray, np.ndarray]:
        group = Group(table)
        at, hashes = group.anchors()
        start, found = group.windows(at[_flags(hashes, answers, 1, shift)])
        return group, start, found

    def send_windows(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _packed(np.zeros(0, dtype=np.uint64), 0, shift)
        return _packed(candidate_windows(table, answers)[2], key[0].as_py(), shift)

    def remove(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "n_removed", "kept", "copies"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        if not table.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
        group, start, hashes = candidate_windows(table, answers)
        original = np.zeros(len(start), dtype=bool)
        original[np.unique(hashes, return_index=True)[1]] = True
        original &= _flags(hashes, answers, 2, shift)
        step = np.zeros(len(group.words) + 1, dtype=np.int64)
        step[start[~original]] += 1
        np.add.at(step, start[~original] + WINDOW, -1)
        keep = np.cumsum(step)[:-1] == 0
        kept, removed = [], []
        for r, text in enumerate(group.texts):
            own = keep[group.rows[r] : group.rows[r + 1]]
            words = text.encode().split()
            removed.append(int((~own).sum()))
            kept.append(b" ".join(compress(words, own.tolist()) if removed[-1] else words).decode())
        columns = [group.ids, np.diff(group.rows).tolist(), removed, kept, group.copies]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    shared = dealt.groupBy("part").applyInArrow(send_anchors, PACKED).groupBy("bucket").applyInArrow(_answer(1, _repeated), ANSWER)
    firsts = (
        dealt.groupBy("part")
        .cogroup(shared.groupBy("part"))
        .applyInArrow(send_windows, PACKED)
        .groupBy("bucket")
        .applyInArrow(_answer(2, _first), ANSWER)
    )
    answers = shared.unionAll(firsts)
    schema = "doc_id long, n_words long, n_removed long, kept string, copies long"
    out = dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(remove, schema)
    if not split:
        return out.drop("copies")
    # every window of a later copy starts earlier: nothing of it stays, unless it is shorter than a window
    later = (F.col("copy") > 1) & (F.col("n_words") >= WINDOW)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "doc_id",
        "n_words",
        F.when(later, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(later, "").otherwise(F.col("kept")).alias("kept"),
    )
