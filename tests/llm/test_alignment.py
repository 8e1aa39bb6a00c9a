"""Operator 11 against a plain merge of both token lists."""

from __future__ import annotations

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from cohortwise.llm import alignment
from hypothesis import given
from hypothesis import strategies as st

ODD = ["a▁b", "<0x41> </s> <|endoftext|> <s>", "naïve ½ 漢字 🙂\x1c", "  two  spaces ", "\t\n x", "a\u0000b", "ﬁ é́"]


@pytest.fixture(scope="module")
def model():
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both(vocabulary, model):
    return alignment.Tokenizers(open(vocabulary, encoding="utf-8").read(), open(model, "rb").read())


def plain_tokens(both, text):
    """Whole texts encoded at once by the libraries: (id, end) of both sides."""
    if not text:
        return [], []
    out = []
    for ids, strings in (
        (both.a.encode(" " + text, add_special_tokens=False).ids, both.a_bytes),
        (both.b.encode(text), both.b_bytes),
    ):
        if b"".join(strings[i] for i in ids) != b" " + text.encode():
            return [], []
        ends, at = [], 0
        for i in ids:
            at += len(strings[i])
            ends.append((i, at))
        out.append(ends)
    return out[0], out[1]


def plain_statistics(both, rows):
    tokens = {k: plain_tokens(both, t) for k, (_, t) in enumerate(rows)}
    links = {k: [(i, j) for i, e in a for j, f in b if e == f] for k, (a, b) in tokens.items()}
    count = Counter(p for x in links.values() for p in x)
    highest = {}
    for (_, j), n in count.items():
        highest[j] = max(highest.get(j, 0), n)
    out = []
    for k, (doc_id, _) in enumerate(rows):
        a, b = tokens[k]
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        groups, low = [], 0
        for high in cuts:
            groups.append("|".join(",".join(str(i) for i, e in side if low < e <= high) for side in (a, b)))
            low = high
        digest = sha256(";".join(groups).encode()).hexdigest() if a else ""
        counts = [count[p] for p in links[k]]
        best = sum(count[p] == highest[p[1]] for p in links[k])
        out.append((doc_id, len(a), len(b), len(groups), len(counts), best, sum(counts), digest))
    return out


@given(st.lists(st.integers(0, 60), max_size=80), st.lists(st.integers(0, 5000), max_size=30), st.integers(1, 9))
def test_gallop(a, b, block):
    alignment.DRIVEN = block
    a, b = np.unique(np.array(a, dtype=np.int64)), np.unique(np.array(b, dtype=np.int64))
    in_a, in_b = alignment.common_ends(a, b)
    assert a[in_a].tolist() == b[in_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_parts_are_exact(both, monkeypatch):
    monkeypatch.setattr(alignment, "KNOWN_PARTS", 40)
    monkeypatch.setattr(alignment, "LONGEST_KNOWN", 6)
    monkeypatch.setattr(alignment, "TOGETHER", 3)
    random.seed(5)
    marks = ["a", "the", " ", "  ", "\n", "don't", "1", "½", "漢", "!", " ", "　", "_", "x\ty", "'s", "🙂"]
    marks += ["▁", "é́"]
    for _ in range(200):
        texts = ["".join(random.choice(marks) for _ in range(random.randint(1, 25))) for _ in range(5)]
        for text, *got in zip(texts, *both.encode(texts), strict=True):
            assert [x.tolist() for x in got] == [[i for i, _ in side] for side in plain_tokens(both, text)], repr(text)


def test_alignment_arrays(spark, documents, both, vocabulary, model):
    for r in alignment.align(documents, vocabulary, model).limit(40).collect():
        text = documents.where(f"doc_id = {r['doc_id']}").first()["text"]
        a, b = plain_tokens(both, text)
        assert (r["a_ids"], r["b_ids"]) == ([i for i, _ in a], [i for i, _ in b])
        a_ends, b_ends = [0, *(e for _, e in a)], [0, *(e for _, e in b)]
        assert [a_ends[k] for k in r["a_cuts"]] == [b_ends[k] for k in r["b_cuts"]] == sorted(set(a_ends[1:]) & set(b_ends[1:]))
        for k, (low, high) in enumerate(zip(r["b_from"], r["b_to"], strict=True)):
            over = [j for j in range(len(b)) if b_ends[j] < a_ends[k + 1] and a_ends[k] < b_ends[j + 1]]
            assert over == list(range(low, high))


@pytest.mark.parametrize("block", [1000, 4 << 20])
def test_statistics(spark, documents, both, vocabulary, model, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect() if len(r["text"]) < 3000]
    rows += [(10_000 + k, t) for k, t in enumerate(ODD)] + [(None, None), (7, ""), rows[0], (None, rows[1][1])]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, block int, a string").repartition(3)
    got = sorted(map(tuple, alignment.link_statistics(docs, vocabulary, model).collect()), key=repr)
    assert got == sorted(plain_statistics(both, rows), key=repr)


def test_odd_rows(odd, odd_rows, empty, both, vocabulary, model):
    got = sorted(map(tuple, alignment.link_statistics(odd, vocabulary, model).select("doc_id", "n_a", "n_b").collect()), key=repr)
    assert got == sorted([(d, *map(len, plain_tokens(both, t))) for d, t in odd_rows], key=repr)
    assert alignment.link_statistics(empty, vocabulary, model).count() == 0
    assert alignment.align(empty, vocabulary, model).count() == 0
