"""Operator 4: byte-level BPE encoding and decoding.

Encoding splits a text into pieces by the vocabulary's pattern and merges each piece with a
priority queue of merge ranks over a doubly linked list of symbols; entries whose pair is gone when
they come up are skipped. Decoding concatenates the vocabulary's byte strings.

Cases: null text counts as empty (no ids); repeated rows give repeated results; an empty table gives
an empty one; special strings inside a text become their own id, as in the tokenizers library's
default.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import groupby
from pathlib import Path
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cohortwise.llm.textwork import text_rows

CACHE_PIECES = 1 << 18
LONGEST_KEPT = 64


@cache
def newer_characters() -> tuple[str, str]:
    """Letters and numbers that the tokenizers library knows and this Python's Unicode tables don't."""
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    free = (chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn")
    known = [c for c in free if regex.match(r"[\p{L}\p{N}]", c)]
    kinds = []
    for mark in "a1":  # a letter joins a letter before it, a number a number
        ends = {end for _, (_, end) in split("".join(f" {mark}{c}" for c in known))}
        starts = {start for _, (start, _) in split("".join(f" {mark}{c}" for c in known))}
        kinds.append("".join(c for k, c in enumerate(known) if 3 * k + 2 not in starts and 3 * k + 3 in ends))
    return kinds[0], kinds[1]


def _class(chars: str) -> str:
    """Ranges of a character class that hold exactly these characters, given in order."""
    out = ""
    for _, run in groupby(enumerate(chars), lambda x: ord(x[1]) - x[0]):
        part = [c for _, c in run]
        out += f"{part[0]}-{part[-1]}"
    return out


@cache
def piece_pattern() -> re.Pattern:
    """Contractions, letters, numbers, other marks (each with one space before), or white space."""
    # White space as Unicode's White_Space property has it (str.isspace adds U+001C to U+001F).
    space = "\t-\r \x85\xa0  -     　"
    new_letters, new_numbers = newer_characters()
    # numbers that are not decimal digits, which the re module counts as word characters
    odd = _class([chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No")])
    number, letter = odd + _class(new_numbers), _class(new_letters)
    letters = rf"(?:[^\W\d_{odd}]|[{letter}])" if letter else rf"[^\W\d_{odd}]"
    common = rf"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_{odd}]+"
    rest = rf" ?[\d{number}]+| ?(?:[^\w{space}{letter}{number}]|_)+|[{space}]+(?![^{space}])|[{space}]+"
    if not letter:
        return re.compile(f"{common}|{rest}")
    return re.compile(rf"{common}(?:[{letter}]{letters}*)?| ?[{letter}]{letters}*|{rest}")


@cache
def splitter() -> Callable[[str], list[str]]:
    """Pieces of a text. Texts without rare characters, on which both patterns agree, take the faster one."""
    # The pattern of byte-level vocabularies, in terms of Python's own character classes.
    plain = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
    exact = piece_pattern().findall
    odd = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No") or 0x1C <= c <= 0x1F]
    # two searches, as a class of characters below U+10000 alone is looked up in a bitmap
    low = re.compile(f"[{_class([c for c in sorted({*odd, *newer_characters()[0], *newer_characters()[1]}) if c < chr(65536)])}]").search
    high = re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: exact(text) if low(text) or high(text) else plain(text)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    letters = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


@dataclass
class Vocabulary:
    """Tables of one byte-level BPE vocabulary. ``merges`` maps left * 2**32 + right to (rank, id)."""

    symbols: list[int]
    merges: dict[int, tuple[int, int]]
    strings: list[bytes]
    special: dict[str, int]

    @classmethod
    def parse(cls, source: str) -> Vocabulary:
        doc = json.loads(source)
        ids, letters = doc["model"]["vocab"], byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        special = {t["content"]: t["id"] for t in doc.get("added_tokens", [])}
        strings = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for text, i in ids.items():
            strings[i] = text.encode() if text in special else bytes(back[c] for c in text)
        for text, i in special.items():
            strings[i] = text.encode()
        merges = {}
        for rank, pair in enumerate(doc["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            merges.setdefault(ids[left] << 32 | ids[right], (rank, ids[left + right]))
        return cls([ids[c] for c in letters], merges, strings, special)


_LOADED: dict[int, tuple[Vocabulary, dict]] = {}


def shared_vocabulary(spark, path: str) -> Callable[[], tuple[Vocabulary, dict]]:
    """Broadcast a vocabulary file; the result gives its tables and a cache, once per worker.

    A vocabulary file has a fixed size (1.5 MB here), whatever the corpus.
    """
    source = spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    def load() -> tuple[Vocabulary, dict]:
        text = source.value
        key = hash(text)
        if key not in _LOADED:
            _LOADED[key] = (Vocabulary.parse(text), {})
        return _LOADED[key]

    return load


def merge_symbols(symbols: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """Merge pairs by rank, leftmost first, until none is left; ``symbols`` is changed."""
    n = len(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    queue = []
    for i in range(n - 1):
        if found := merges.get(symbols[i] << 32 | symbols[i + 1]):
            queue.append((found[0], i))
    heapq.heapify(queue)
    while queue:
        rank, i = heapq.heappop(queue)
        j = after[i]
        if symbols[i] < 0 or j >= n:
            continue
        found = merges.get(symbols[i] << 32 | symbols[j])
        if found is None or found[0] != rank:
            continue  # stale: one of the two has been merged since
        symbols[i], symbols[j] = found[1], -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if found := merges.get(symbols[i] << 32 | symbols[k]):
                heapq.heappush(queue, (found[0], i))
        if (h := before[i]) >= 0 and (found := merges.get(symbols[h] << 32 | symbols[i])):
            heapq.heappush(queue, (found[0], h))
    return [s for s in symbols if s >= 0]


def split_special(text: str, special: dict[str, int]) -> Iterator[tuple[str, int | None]]:
    """Parts of a text: ordinary ones with None, special strings with their id."""
    if not any(s in text for s in special):
        yield text, None
        return
    wanted = "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))
    for part in re.split(f"({wanted})", text):
        if part:
            yield part, special.get(part)


class PieceCache(dict):
    """Results by piece, made when first asked for.

    Two generations: when the younger one is full it becomes the older one, from which pieces asked
    for again come back. So memory is bounded and frequent pieces stay.
    """

    def __init__(self, make: Callable[[str], bytes], most: int = CACHE_PIECES):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, piece: str) -> bytes:
        made = self.older.get(piece)
        if made is None:
            made = self.make(piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = made
        return made


def encoder(vocabulary: Vocabulary) -> Callable[[str], bytes]:
    """A function from text to ids as little-endian unsigned 32-bit integers."""
    symbols, merges, find = vocabulary.symbols, vocabulary.merges, splitter()

    def make(piece: str) -> bytes:
        ids = merge_symbols([symbols[b] for b in piece.encode()], merges)
        return pack(f"<{len(ids)}I", *ids)

    pieces = PieceCache(make)

    def encode(text: str) -> bytes:
        return b"".join(
            b"".join(map(pieces.__getitem__, find(part))) if i is None else i.to_bytes(4, "little")
            for part, i in split_special(text, vocabulary.special)
        )

    return encode


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Token ids of every whole text.

    Args: ``docs`` with doc_id and text; ``vocabulary``, the path of a byte-level BPE file.
    Returns doc_id, n_tokens (long) and ids (binary, little-endian unsigned 32-bit integers).
    """
    load = shared_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, kept = load()
        if "encode" not in kept:
            kept["encode"] = encoder(tables)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [kept["encode"](t.as_py()) for t in part.column("text")]
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return text_rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Texts of packed ids: adds ``text`` to doc_id, n_tokens and ids as ``encode`` gives them.

    Bytes that are not UTF-8 become U+FFFD; an unknown id is an error.
    """
    load = shared_vocabulary(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = load()[0].strings
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [
                    b"".join(map(strings.__getitem__, np.frombuffer(x.as_py() or b"", dtype="<u4").tolist())).decode("utf-8", "replace")
                    for x in part.column("ids")
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "text"])

    plain = encoded.select("doc_id", "n_tokens", "ids")
    return plain.mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")
