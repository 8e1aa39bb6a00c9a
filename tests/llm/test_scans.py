"""Operators 3, 5, 8 and 10, and the pipeline."""

from __future__ import annotations

import itertools
import random
import re
import time
import zlib

import corpus_pipeline
import numpy as np
import plain
import pyarrow as pa
import pytest
from cohortwise.llm import licenses, near_dedup, pii, queries, secret_scan, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


# operator 3


def test_toxicity_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.QUERIES["op3_toxicity"](spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in held) / len(held) > 0.9


def test_toxicity_without_classes(spark, odd, empty):
    labels = spark.createDataFrame([(4, 0), (5, None), (None, 1)], "doc_id long, label int")
    model = toxicity.fit(odd, labels)
    scores = [r["score"] for r in toxicity.score(odd, model).collect()]
    assert len(scores) == odd.count() and max(scores) < 0.01
    assert toxicity.score(empty, toxicity.fit(empty, labels.limit(0))).count() == 0


def test_sample_is_bounded(spark, documents):
    labels = documents.select("doc_id", (F.col("doc_id") % 2).alias("label"))
    assert toxicity._sample(documents, labels, 50).count() <= 100


def test_grams_are_distinct_and_per_row():
    row, bucket = toxicity.gram_buckets(["abc abc", "", "ABC"])
    pairs = list(zip(row.tolist(), bucket.tolist()))
    assert len(set(pairs)) == len(pairs) and set(row.tolist()) <= {0, 1, 2}
    alone = toxicity.gram_buckets(["abc"])[1]
    assert sorted(bucket[row == 2].tolist()) == sorted(alone.tolist())


# operator 5


def base_plain(text: str) -> list[tuple[int, str, int]]:
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for k, (kind, pattern) in enumerate(
        [
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
        ]
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans(spark):
    random.seed(2)
    parts = ["a@b.co", "x.y+z@q-r.example.org", "@", "1.2.3.4", "256.1.1.1", "001.02.3.255", "4785380592391139", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (262) 555-3752", "+12345", " ", "  ", ".", "-", "é", "12", "1" * 30]
    for _ in range(500):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 12)))
        assert pii.base_spans(text) == base_plain(text), text
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        assert pii.base_spans(r["text"]) == base_plain(r["text"])


UNIT = r"(?<![A-Za-z0-9])(?:[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])*)(?![A-Za-z0-9])"


def test_units_against_one_expression():
    random.seed(3)
    parts = ["a@b.co", "x.y@", "@", "1.2", "4785", "(12) 3", "+1", " ", ".", "-", "é", "ab", "(", ")", "_", "5@6", "%"]
    for _ in range(5000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 9)))
        assert list(pii.unit_spans(text)) == [m.span() for m in re.finditer(UNIT, text)], text
        assert pii.base_spans(text) == base_plain(text), text


LONG = {
    "digits": "7" * 10**6, "letters": "x" * 10**6 + "@", "letters_between": "a@" + "x" * 10**6 + "@b", "dots": "." * 10**6 + "@", "dashes": "-" * 10**6,
    "zeros": "0" * 10**6 + "1.1.1.1", "digits_and_dots": "1." * 500_000, "signs": "@" * 10**6, "pluses": "+1" * 500_000, "phone": "+1" + "." * 10**6,
    "number_and_letter": "1 " * 500_000 + "1a", "brackets": "(" * 10**6,
}


@pytest.mark.parametrize("kind", LONG)
def test_long_runs_take_linear_time(kind):
    text = LONG[kind]
    short = text[:1500] + text[-500:] if len(text) > 2000 else text
    assert pii.base_spans(short) == base_plain(short)
    assert list(pii.unit_spans(short)) == [m.span() for m in re.finditer(UNIT, short)]
    started = time.process_time()
    base = pii.base_spans(text)
    list(pii.unit_spans(text))
    assert time.process_time() - started < 2  # a second each on a quiet core
    assert len(base) == {"zeros": 1, "digits_and_dots": 125_000}.get(kind, 0)


def enumerated(model, units):
    """Marginals of one document, summed over all labelings."""
    n = len(units.spans)
    score = [model.weights[f].sum(axis=0) + model.bias for f in units.features]
    pairs = [(i, i + 1, model.chain) for i in range(n - 1)] + [(a, b, model.skip) for a, b in units.ties]
    total = np.zeros((n, 5))
    for labels in itertools.product(range(5), repeat=n):
        seen = sum(pii.OBSERVED for got, known in zip(labels, units.labels) if known > 0 and got == known)
        weight = np.exp(seen + sum(s[k] for s, k in zip(score, labels)) + sum(t[labels[a], labels[b]] for a, b, t in pairs))
        total[range(n), labels] += weight
    return total / total.sum(axis=1, keepdims=True)


def test_marginals_against_all_labelings():
    """Exact without ties (a chain); with ties, what is sure agrees with the exact marginals."""
    rng = np.random.default_rng(6)
    model = pii.Field(rng.normal(0, 0.4, (pii.FEATURES, 5)), rng.normal(0, 0.3, 5), rng.normal(0, 0.5, (5, 5)), 2 * np.eye(5) + rng.normal(0, 0.1, (5, 5)))
    for text in ("call 12 or a@b.co , 34 , 10.0.0.1 then 56 78x 99", "1 , 2 , 3 , 4 , 5"):
        units = pii.units_of(text, pii.base_spans(text))
        assert not units.ties and 4 <= len(units.spans) <= 6
        assert np.allclose(pii.marginals(model, [units]), enumerated(model, units), atol=1e-4)
    for text in ("+1 (262) 555-3752 and 262 555 3752 , 17 , 2625553752", "5553752 , 5553752 , 8 , +1 262 555 3752"):
        units = pii.units_of(text, pii.base_spans(text))
        assert units.ties
        got, exact = pii.marginals(model, [units]), enumerated(model, units)
        sure = got.max(axis=1) >= pii.SURE
        assert sure.any() and (got.argmax(axis=1) == exact.argmax(axis=1))[sure].all()


def test_field_carries_labels_to_distant_mentions(spark):
    rng = random.Random(4)
    number = lambda: f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    rows = [(d, f"call {number()} or {number()} in {rng.randint(1900, 2020)} , {rng.randint(1, 99)} items") for d in range(300)]
    rows.append((900, "call +1 (262) 555-3752 now. " + "word " * 300 + "again 262 555 3752 then, not 262 444 1111 nor 1999."))
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {r["doc_id"]: r for r in pii.find(docs, pii.fit(docs)).collect()}
    text = rows[-1][1]
    added = [text[s["start"] : s["end"]] for s in found[900]["spans"] if s not in found[900]["base"]]
    assert added == ["262 555 3752"]
    assert all(r["base"] == r["spans"] for d, r in found.items() if d != 900)


def test_ties_reach_any_number_of_repeats(spark):
    rng = random.Random(4)
    number = lambda: f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    rows = [(d, f"call {number()} or {number()} in {rng.randint(1900, 2020)} , {rng.randint(1, 99)} items") for d in range(300)]
    repeats = "again 262 555 3752 then, " * 30
    rows.append((900, f"{repeats} call +1 (262) 555-3752 now. {repeats} not 262 444 1111"))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = pii.fit(docs)
    (found,) = pii.find(docs.where("doc_id = 900"), model).collect()
    assert len(found["base"]) == 1 and len(found["spans"]) == 61
    assert "262 444 1111" not in [rows[-1][1][s["start"] : s["end"]] for s in found["spans"]]
    # the messages have settled, and a document does not depend on its neighbours in a slice
    units = [pii.units_of(t, pii.base_spans(t)) for _, t in rows[-3:]]
    together = pii.marginals(model, units)
    assert np.array_equal(together, np.concatenate([pii.marginals(model, [u]) for u in units]))


def test_field_is_fitted_on_all_documents(spark):
    plenty = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("in 1999 , 12 items").alias("text"))
    rare = "call +1 (262) 555-3752 or +1 (262) 555-3752 now. in 1999 , 12 items , later 262 555 3752 then 12 items"
    docs = plenty.unionAll(spark.createDataFrame([(10**6 + d, rare) for d in range(2)], SCHEMA))
    model = pii.fit(docs)
    # none-none within each plain document and both rare ones, phone-phone and phone-none in the rare ones
    counts = np.zeros((5, 5))
    counts[0, 0], counts[4, 4], counts[4, 0] = 60_002, 2, 2
    assert np.allclose(model.chain, pii._association(counts))
    skips = np.zeros((5, 5))
    skips[4, 4] = 2
    assert np.allclose(model.skip, pii._association(skips, pii.AGREE))
    for r in pii.find(docs.where("doc_id >= 1000000"), model).collect():
        assert [rare[s["start"] : s["end"]] for s in r["spans"] if s not in r["base"]] == ["262 555 3752"]


def test_pii_of_odd_rows(odd, empty):
    assert pii.find(odd, pii.fit(odd)).count() == odd.count()
    assert pii.find(empty, pii.fit(empty)).count() == 0


# operator 8


def licenses_plain(text: str, templates=licenses.TEMPLATES) -> tuple:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(plain.LOWER))
    places, base, own = [], set(), {}
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        if at:
            base.add(label)
    for label, notice in templates:
        t, n = set(licenses.template_words(notice)), 64
        while n < 2 * len(re.findall("[a-z0-9]+", notice.lower())):
            n *= 2
        for start in range(-(n // 2), len(w), n // 2):
            share = len(t & set(w[max(0, start) : start + n])) / len(t)
            if share >= licenses.CONTAINMENT - 1e-9:
                own[label] = max(own.get(label, 0), share)
    score = 1.0 if places else max(own.values(), default=0.0)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(own))), score


def test_licenses(spark, odd_rows):
    rng = random.Random(6)
    filler = ["the", "license", "version", "under", "mit", "x", "2", "apache", "cc", "by", "nc", "é"]
    texts = [t for _, t in odd_rows]
    for _ in range(150):
        parts = [" ".join(rng.choice(filler) for _ in range(rng.randint(0, 40)))]
        if rng.random() < 0.5:
            notice = rng.choice(licenses.TEMPLATES)[1].split()
            parts += [" ".join(x for x in notice if rng.random() < 0.95), " ".join(rng.choice(filler) for _ in range(30))]
        texts.append(rng.choice([" ", "\n", ", "]).join(parts))
    rows = list(enumerate(texts))
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for d, text in rows:
        assert got[d][:-1] == licenses_plain(text)[:-1], text
        assert got[d][-1] == pytest.approx(licenses_plain(text)[-1])


def test_templates_of_any_length(spark):
    """Templates of 5 to 300 words, whole or with a few words gone, at any place of a block."""
    rng = random.Random(8)
    notice = lambda n, tag: " ".join(f"{tag}{rng.randint(0, n)}" if rng.random() < 0.8 else "the" for _ in range(n))
    templates = tuple((f"t{n}", notice(n, f"w{n}x")) for n in (1, 5, 32, 33, 40, 80, 300))
    rows, whole = [], {}
    for label, text in templates:
        for shift in (0, 1, 31, 33, 63, 127, 250, 300, 511, 1000):
            words = text.split()
            whole[len(rows)] = label
            rows.append((len(rows), " ".join(["filler"] * shift + words + ["the"] * 7)))
            rows.append((len(rows), " ".join(["filler"] * shift + [x for x in words if rng.random() < 0.93])))
    found = licenses.license_scan(spark.createDataFrame(rows, SCHEMA), templates=templates).collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in found}
    for d, text in rows:
        wanted = licenses_plain(text, templates)
        assert got[d][:-1] == wanted[:-1] and got[d][-1] == pytest.approx(wanted[-1]), text
        assert d not in whole or whole[d] in got[d][5].split(",") and got[d][-1] == 1.0
    with pytest.raises(ValueError, match="without words"):
        licenses.license_scan(spark.createDataFrame(rows, SCHEMA), templates=(("x", " -- "),))


def test_licenses_over_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.license_scan(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        assert got[r["doc_id"]] == licenses_plain(r["text"])


def test_license_scan_has_no_python(documents, odd, empty):
    plan = licenses.license_scan(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert licenses.license_scan(odd).count() == odd.count()
    assert licenses.license_scan(empty).count() == 0


# operator 10


def secrets_plain(text: str) -> list[tuple[int, int, int]]:
    out = []
    for k, rule in enumerate(secret_scan.RULES):
        for m in rule.compiled().finditer(text):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_trigram_queries():
    code = lambda s: ord(s[0]) << 16 | ord(s[1]) << 8 | ord(s[2])
    assert secret_scan.trigram_query(r"AKIA[A-Z0-9]+") == ("and", (("tri", code("aki")), ("tri", code("kia"))))
    assert secret_scan.trigram_query(r"[0-9a-f]+") == secret_scan.ALL
    assert secret_scan.trigram_query(r"ab?c*xyz") == ("tri", code("xyz"))
    assert secret_scan.trigram_query(r"(abc|[de]fg)x") == ("or", (("and", (("tri", code("abc")), ("tri", code("bcx")))), ("and", (("tri", code("dfg")), ("tri", code("fgx")))), ("and", (("tri", code("efg")), ("tri", code("fgx"))))))


def test_secrets(spark):
    rng = random.Random(8)
    parts = ["password", "PassWd=", "apikey: ", "API_KEY", "token", '"', "'", " = ", ":", "=", "abcdefghijkl", "deadbeefdeadbeef", "AKIA", "ABCDEFGHIJKLMNOP", "ghp_" + "a1B2" * 9, "eyJhbGciOi.eyJzdWIiOi.abcdefgh123", "-----BEGIN RSA PRIVATE KEY-----", "\n", " ", "é", "ſecret", "sk_live_" + "x" * 20]
    rows = [(d, "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))) for d in range(600)]
    rows += [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    names = [r.kind for r in secret_scan.RULES]
    got = secret_scan.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"]: [(s["start"], names.index(s["kind"]), s["end"]) for s in r["spans"]] for r in got} == {d: secrets_plain(t) for d, t in rows}


def test_candidates_are_few_and_complete(documents):
    column = pa.array([r["text"] for r in documents.select("text").collect()])
    data, bounds = secret_scan.text_buffer(column)
    query = secret_scan.trigram_query(r"AKIA[A-Z0-9]+")
    import numpy as np

    codes = np.array(sorted(secret_scan._codes(query)))
    rows = secret_scan.candidates(query, secret_scan.postings(data, bounds, codes), np.arange(len(column))).tolist()
    wanted = [i for i, t in enumerate(column.to_pylist()) if "aki" in t.lower() and "kia" in t.lower()]
    assert rows == wanted and len(rows) < len(column)


def test_redaction_and_odd_rows(spark, odd, empty):
    docs = spark.createDataFrame([(1, "x token=abcdefghijklmnop y"), (2, None), (3, "")], SCHEMA)
    assert [r["text"] for r in docs.withColumn("text", secret_scan.redact_column()).orderBy("doc_id").collect()] == ["x [assign] y", None, ""]
    assert secret_scan.scan(odd).count() == odd.count() and secret_scan.scan(empty).count() == 0
    assert odd.withColumn("text", secret_scan.redact_column()).count() == odd.count()


# the pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = queries.toxicity_model(docs, spark, SF)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    kept = [(d, t) for d, t in rows.items() if scores[d] < 0.5]
    roots = plain.components(kept)
    kept = [(d, t) for d, t in kept if roots[d] == d]
    items = [plain.shingles(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def clean(text):
        own = plain.shingles(text)
        return not any(s and 100 * len(s & own) >= 75 * len(s) for s in items)

    wanted = {}
    for d, t in kept:
        if clean(t):
            spans = [(a, secret_scan.RULES[k].kind, e) for a, k, e in secrets_plain(t)]
            wanted[d] = secret_scan.redacted(t, spans)
    out = corpus_pipeline.run(spark, SF)
    got = {r["doc_id"]: r for r in out.collect()}
    assert got.keys() == wanted.keys()
    import hashlib

    assert all(got[d]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for d, t in wanted.items())


def test_pipeline_of_odd_rows(spark, odd_rows, tmp_path):
    rows = [(d, t, "en", "s", len(t or "")) for d, t in odd_rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (4, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() <= docs.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_every_operator_has_a_query():
    numbers = {int(m[1]) for name in queries.QUERIES if (m := re.match(r"op(\d+)_", name))}
    assert numbers == set(range(1, 11)) and near_dedup.REGISTERS == near_dedup.BANDS * near_dedup.ROWS
