"""Operators 2, 6, 7 and 9 against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import plain
import pyarrow as pa
import pytest
from cohortwise.llm import components, decontamination, fingerprints, near_dedup, substring_dedup, textwork
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string"


def buffer(texts):
    return textwork.text_buffer(pa.array(texts, pa.large_string()))


def varied(n: int, seed: int) -> list[tuple[int, str]]:
    """Texts with copies, near copies, shared passages and short ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = []
    for d in range(n):
        kind = rng.random()
        if rows and kind < 0.35:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 3)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 5, 40, 120, 200])))
            if kind > 0.8:
                text += " " + passage
        rows.append((d * 3, text.upper() if kind > 0.95 else text))
    return rows


def test_word_hashes_follow_the_words():
    texts = ["Ab cd\x0bEF", "", " ab  cd ", "\x1fx é\x85É", "a" * 3_000_000 + " ab"]
    hashes, starts, ends, rows = textwork.word_hashes(*buffer(texts))
    known: dict[str, int] = {}
    for r, text in enumerate(texts):
        found = plain.words(text)
        assert rows[r + 1] - rows[r] == len(found)
        for w, h in zip(found, hashes[rows[r] : rows[r + 1]].tolist()):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    assert textwork.word_hashes(*buffer([]))[3].tolist() == [0]


def test_shingles_match_plain_sets():
    texts = [t for _, t in varied(60, 1)]
    sets = textwork.distinct_shingles(*buffer(texts))
    for t, s in zip(texts, sets):
        assert len(s) == len(plain.shingles(t))
    for i in range(0, 60, 7):
        for k in range(60):
            assert len(np.intersect1d(sets[i], sets[k])) == len(plain.shingles(texts[i]) & plain.shingles(texts[k]))


def test_fingerprint_likeness_is_unbiased():
    rng = random.Random(5)
    for overlap in (0, 40, 90, 120):
        errors = []
        for _ in range(40):
            own = [f"u{rng.random()}" for _ in range(124)]
            other = own[:overlap] + [f"v{rng.random()}" for _ in range(124 - overlap)]
            d, some = fingerprints.fingerprint_digits(*buffer([" ".join(own), " ".join(other)]))
            true = plain.jaccard(plain.shingles(" ".join(own)), plain.shingles(" ".join(other)))
            errors.append(fingerprints.digit_likeness(d[:1], some[:1], d[1:], some[1:])[0] - true)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_single_shingles_are_like_only_if_equal():
    d, some = fingerprints.fingerprint_digits(*buffer(["a b c", "a b d", "A  b\tc", "", " "]))
    like = lambda i, k: fingerprints.digit_likeness(d[i : i + 1], some[i : i + 1], d[k : k + 1], some[k : k + 1])[0]
    assert like(0, 2) == 1 and like(0, 1) < 0.05 and like(0, 3) == 0 and like(3, 4) == 1


@pytest.mark.parametrize("group_bytes", [2_000, 1 << 22])
def test_edited_fingerprints(spark, group_bytes):
    import hashlib

    rows = varied(120, 2)
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(spark.createDataFrame(rows, SCHEMA), group_bytes).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (d, text), (following_id, following) in zip(order, order[1:] + order[:1]):
        edited = fingerprints.edited_text(text, following)
        r = got[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - (plain.jaccard(plain.shingles(text), plain.shingles(edited)) if plain.shingles(text) or plain.shingles(edited) else 1)) < 0.12
        assert (r["fingerprint"] == got[following_id]["fingerprint"]) <= (r["near_next"] == 1.0)


def test_likeness_column_and_odd_rows(spark, odd, empty):
    prints = fingerprints.fingerprints(odd)
    assert prints.count() == odd.count()
    pairs = prints.withColumnRenamed("fingerprint", "a").crossJoin(prints.limit(1).select(prints["fingerprint"].alias("b")))
    assert all(0 <= r[0] <= 1 for r in pairs.select(fingerprints.likeness("a", "b")).collect())
    assert fingerprints.edited_fingerprints(odd).count() == odd.count()
    assert fingerprints.edited_fingerprints(odd, 100).count() == odd.count()
    assert fingerprints.edited_fingerprints(empty).count() == 0


def test_cover_is_a_difference_cover():
    for d in range(substring_dedup.PERIOD):
        assert any((a - b) % substring_dedup.PERIOD == d for a in substring_dedup.COVER for b in substring_dedup.COVER)


@pytest.mark.parametrize("group_bytes", [1_500, 1 << 22])
def test_repeats_removed(spark, group_bytes):
    rows = varied(150, 3) + [(1001, "x " * 90), (1002, "x " * 25)]
    got = substring_dedup.repeats_removed(spark.createDataFrame(rows, SCHEMA), group_bytes).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == plain.repeats_removed(rows)


def test_ranges_are_cut_by_bytes(spark):
    rows = [(d, "a b") for d in range(2000)] + [(2000 + d, "word " * 2000) for d in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    cuts = textwork.range_bounds(docs, 30_000)
    sizes = docs.groupBy(textwork.range_group("doc_id", cuts).alias("part")).agg(F.sum(F.length("text")).alias("n")).collect()
    assert max(r["n"] for r in sizes) <= 30_000 and len(sizes) < 30


def test_rows_without_id_are_split(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9, 30)) for _ in range(200)]
    copied, short = " ".join(f"c{x}" for x in range(30)), "too short to lose a word"
    rows = [(None, t) for t in texts + [copied] * 500 + [short] * 20] + [(7, texts[0]), (8, t := "x y " * 30), (8, t)]
    docs = spark.createDataFrame(rows, SCHEMA)
    marked = docs.withColumn("mark", F.xxhash64("text"))
    n, split, part = textwork.range_parts(marked, 2_000)
    dealt = marked.distinct().groupBy(part.alias("part")).agg(F.sum(F.length("text")).alias("n")).collect()
    assert len(split) > 20 and max(r["n"] for r in dealt) < 4_000
    got = substring_dedup.repeats_removed(docs, 2_000).collect()
    tuples = lambda rows: sorted(map(tuple, rows), key=str)
    assert tuples(got) == tuples(substring_dedup.repeats_removed(docs).collect()) and len(got) == len(rows)
    kept = [r["kept"] for r in got]
    assert kept.count(copied) == 1 and kept.count("") >= 499 and kept.count(short) == 20


def test_repeats_of_odd_rows(odd, empty):
    got = substring_dedup.repeats_removed(odd).collect()
    assert len(got) == odd.count() and sorted(r["n_removed"] for r in got)[-1] == 60_000
    assert substring_dedup.repeats_removed(empty).count() == 0


def test_near_duplicates(spark):
    rows = varied(160, 4)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    wanted = plain.components(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == wanted
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) and r["n_shingles"] == len(plain.shingles(dict(rows)[r["doc_id"]])) for r in got)


def test_links_that_pass_the_hub(spark, monkeypatch):
    """A chain whose ends are not similar: each text shifts by a few words, so hubs differ from links."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    words = [f"c{i}" for i in range(400)]
    rows = [(k, " ".join(words[12 * k : 12 * k + 120])) for k in range(20)]
    rows = [(d * 7 % 20, t) for d, t in rows]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == plain.components(rows)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    x, y = (rng.integers(0, 1 << 63, 900, dtype=np.uint64) for _ in range(2))
    a, b = np.unique(np.concatenate([x, y[:300]])), np.unique(np.concatenate([x[:600], y]))
    r = near_dedup.registers([a, b, np.union1d(a, b)])
    assert (near_dedup.merge(r[0], r[1]) == r[2]).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(near_dedup.estimate(r[:1], r[1:2], np.array([len(a)]), np.array([len(b)]))[0] - true) < 0.12


def test_sketches_miss_less_than_bands():
    n, floor = near_dedup.REGISTERS, 0.75 - near_dedup.MARGIN
    a = np.full((n + 1, n), 1000)
    b = a + np.where(np.arange(n) < np.arange(n + 1)[:, None], 0, np.where(np.arange(n) % 2, 1, -1))  # row k: k equal
    size = np.full(n + 1, 500.0)
    lost = np.flatnonzero(near_dedup.estimate(a, b, size, size) < floor)
    missed = sum(math.comb(n, int(k)) * 0.75**k * 0.25 ** (n - k) for k in lost)
    assert 0 < missed < (1 - 0.75**near_dedup.ROWS) ** near_dedup.BANDS


def test_near_duplicates_of_odd_rows(odd, empty):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["component_id"] == 1 and by[1]["n_shingles"] == 0 and by[2]["kept"] and by[3]["kept"]
    assert by[None]["component_id"] is None and by[None]["kept"] and by[6]["kept"]
    assert near_dedup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("local", [10, 100_000])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL_LINKS", local)
    rng = random.Random(9)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(500, 560)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for pair in links for x in pair}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x != r}


def test_contaminations(spark):
    rng = random.Random(11)
    fresh = lambda n: " ".join(f"q{rng.randrange(10**6)}" for _ in range(n))
    items = [(i, fresh(n)) for i, n in enumerate([3, 5, 9, 16, 33, 70, 150, 0])] + [(50, None)]
    docs = []
    for d in range(120):
        item = rng.choice(items)[1] or ""
        words = item.split()
        cut = rng.random()
        inside = words[: int(len(words) * 0.9)] if cut < 0.3 else words[len(words) // 3 :] if cut < 0.5 else words
        docs.append((d, f"{fresh(rng.choice([0, 5, 400, 3000]))} {' '.join(inside).upper()} {fresh(rng.choice([0, 5, 300]))}"))
    long = items[6][1].split()  # the parts of one item far apart
    docs.append((500, f"{fresh(900)} {' '.join(long[:75])} {fresh(2000)} {' '.join(long[75:])} {fresh(900)}"))
    docs.append((501, None))
    found = decontamination.contaminations(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    wanted = set()
    for d, text in docs:
        for i, item in items:
            s = plain.shingles(item)
            shared = len(s & plain.shingles(text))
            if s and 100 * shared >= 75 * len(s):
                wanted.add((d, i, shared, len(s)))
    assert {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in found.collect()} == wanted and len(wanted) > 50
    flags = decontamination.contaminated_columns(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    held = spark.createDataFrame(docs, SCHEMA).where(flags[0]).collect()
    assert {r["doc_id"] for r in held} == {w[0] for w in wanted}


def test_shards_of_items_agree(spark, documents, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = {tuple(r) for r in decontamination.contaminations(documents, items).collect()}
    monkeypatch.setattr(decontamination, "SHARD_SHINGLES", 200)
    assert {tuple(r) for r in decontamination.contaminations(documents, items).collect()} == whole and whole


def test_contaminations_of_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "a row without an id, of nine words in all")], "item_id long, text string")
    assert sorted(str(r["doc_id"]) for r in decontamination.contaminations(odd, items).collect()) == ["8", "None"]
    assert decontamination.contaminations(empty, items).count() == 0
    assert decontamination.contaminations(odd, items.limit(0)).count() == 0


def test_links_in_a_bucket_of_many_blocks(spark, monkeypatch):
    """A template gives all members a third of their shingles; a few are near each other. Texts go out for those only."""
    monkeypatch.setattr(near_dedup, "BLOCK", 10)
    rng = random.Random(12)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    template = [word() for _ in range(60)]
    rows = [(d, " ".join(template + [word() for _ in range(60)])) for d in range(60)]
    for d in range(60, 72):  # near copies of some
        words = rows[d - 55][1].split()
        words[-3] = "other"
        rows.append((d, " ".join(words)))
    docs = spark.createDataFrame(rows, SCHEMA)
    sketches = near_dedup._sketched(docs).select(F.lit(7).alias("bucket"), F.col("doc_id").alias("node"), F.col("doc_id").alias("root"), F.col("n_shingles").alias("n"), "registers")
    asked, texts = [], near_dedup._texts
    monkeypatch.setattr(near_dedup, "_texts", lambda docs, pairs: asked.append(pairs.distinct().count()) or texts(docs, pairs))
    links = near_dedup._links_across(sketches, docs, 75).collect()
    assert asked == [24]
    roots = {d: d for d, _ in rows}
    for a, b in sorted(tuple(sorted(x)) for x in links):
        roots[b] = roots[a]
    assert roots == plain.components(rows)
