"""Operator 13 against plain dictionaries of prefixes."""

from __future__ import annotations

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from cohortwise.llm import prefix_trie
from hypothesis import given
from hypothesis import strategies as st

from plain import words

SCHEMA = "conv_id long, turn long, role string, text string, node string, top int, n long"


def plain_sequences(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = sha256(f"{len(role)}:{role}{text}".encode()).digest()
            turns.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    return {c: [t[3:] for t in sorted(x)] for c, x in turns.items()}


def plain_continued(turns):
    out = {}
    for c, own in turns.items():
        h = crc32(str(c).encode()) % 4
        out[c] = turns.get(c - c % 20, [])[:h] + own[h:]
    return out


def plain_trie(turns):
    members = {}
    for c, own in turns.items():
        for d in range(len(own) + 1):
            members.setdefault(tuple(own[:d]), []).append(c)
    children = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    leaves, saved, out = {}, {}, []
    for key in sorted(members, key=len, reverse=True):
        below = children.get(key, [])
        leaves[key] = sum(leaves[x] for x in below) or 1
        saved[key] = sum(saved[x] for x in below) + (len(members[key]) - 1) * (len(words(key[-1][1])) if key else 0)
        ends = ",".join(str(c) for c in sorted(members[key]) if len(turns[c]) == len(key))
        up = min(members[key[:-1]]) if key else None
        out.append((min(members[key]), len(key), up, len(members[key]), len(below), leaves[key], saved[key], sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


def made(seed, n, long=0):
    random.seed(seed)
    rows = []
    for c in range(n):
        for k in range(random.choice([1, 2, 2, 3, 5, 8])):
            rows.append((c, k, random.choice(["user", "assistant"]), random.choice(["a b c", "d", "", "e  f\tg", None])))
    for k in range(long):
        rows += [(n, k, "user", f"turn {k % 7}"), (n + 1, k, "user", f"turn {k % 7}" if k < long - 5 else "x")]
    return rows


@given(st.lists(st.tuples(st.integers(-1, 10**6), st.integers(-9, 9)), max_size=60))
def test_centroid_sums(nodes):
    up = np.array([p % (k + 1) - 1 for k, (p, _) in enumerate(nodes)], dtype=np.int64)
    values = np.array([[v, 1] for _, v in nodes], dtype=np.int64).reshape(-1, 2)
    wanted = values.copy()
    for k in reversed(range(len(up))):
        if up[k] >= 0:
            wanted[up[k]] += wanted[k]
    assert prefix_trie.subtree_sums(up, values).tolist() == wanted.tolist()


@pytest.mark.parametrize("shape", ["chain", "star", "broom"])
def test_centroid_sums_of_large_trees(shape):
    n = 20_000
    up = np.arange(n) - 1 if shape == "chain" else np.where(np.arange(n) < (1 if shape == "star" else n // 2), np.arange(n) - 1, 0 if shape == "star" else n // 2 - 1)
    values = np.ones((n, 1), dtype=np.int64)
    assert prefix_trie.subtree_sums(up, values)[:, 0].tolist() == prefix_trie._sizes(up).tolist()
    if shape == "chain":
        assert prefix_trie._sizes(up).tolist() == list(range(n, 0, -1))


@pytest.mark.parametrize("limits", [{}, {"FRAGMENT": 4, "GROUP_NODES": 8, "CHUNK": 3, "ENDS": 4}])
def test_trie(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(prefix_trie, name, value)
    rows = made(1, 60, 40)
    frame = spark.createDataFrame([(*r, "z", 1, 2) for r in rows], SCHEMA).repartition(5)
    turns = plain_sequences(rows)
    assert collected(prefix_trie.prefix_trie(frame)) == plain_trie(turns)
    assert collected(prefix_trie.trie(*prefix_trie.continued(frame))) == plain_trie(plain_continued(turns))


def test_odd_conversations(spark):
    rows = [
        (0, 1, "user", "hello there"), (0, None, "user", "first"), (0, None, None, None), (20, 0, "user", "one"), (21, 0, "user", "own"), (22, 0, "user", "own"),
        (23, 0, "a", "bc"), (23, 1, "ab", "c"), (23, 1, "ab", "c"), (None, 0, "user", "nobody"), (41, 0, "user", None), (45, 0, "user", ""), (-3, 0, "user", "below zero"),
    ]
    rows += [(60 + k, 0, "user", "x " * 20_000) for k in range(8)]
    turns = plain_sequences(rows)
    frame = spark.createDataFrame([(*r, "z", 1, 2) for r in rows], SCHEMA)
    assert collected(prefix_trie.prefix_trie(frame)) == plain_trie(turns)
    rows = [r for r in rows if r[0] is None or r[0] >= 0]  # the sign of a remainder is the language's
    frame = frame.where("conv_id >= 0 or conv_id is null")
    assert collected(prefix_trie.trie(*prefix_trie.continued(frame))) == plain_trie(plain_continued(plain_sequences(rows)))
    assert prefix_trie.prefix_trie(frame.limit(0)).count() == 0
    assert prefix_trie.trie(*prefix_trie.continued(frame.limit(0))).count() == 0


def test_turnless_conversations(spark):
    """Conversation c keeps nothing when its h turns are all its own and the first of them is absent."""
    ids = [c for c in range(1, 20) if crc32(str(c).encode()) % 4 >= 1]
    rows = [(c, 0, "user", "gone") for c in ids]
    frame = spark.createDataFrame([(*r, "z", 1, 2) for r in rows], SCHEMA)
    got = collected(prefix_trie.trie(*prefix_trie.continued(frame)))
    assert got == [(ids[0], 0, None, len(ids), 0, 1, 0, sha256(",".join(map(str, ids)).encode()).hexdigest())]
