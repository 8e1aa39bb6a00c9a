"""The registered queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.llm import alignment, bpe, decontamination, fingerprints, licenses, near_dedup, neighbours, pii, prefix_trie, secret_scan, substring_dedup, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return keep


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_token_counts")
def _(spark: SparkSession, sf: str) -> DataFrame:
    budgets = [512, 2048]
    counted = token_counts.token_counts(_table(spark, sf, "documents"), _vocabulary(), budgets, keep_prefixes=False)
    return counted.select(
        "doc_id",
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > 512).alias("over_limit"),
        F.col("fits")[0].alias("chars_in_512"),
        F.col("fits")[1].alias("chars_in_2048"),
    )


@query("op4_bpe")
def _(spark: SparkSession, sf: str) -> DataFrame:
    encoded = bpe.encode(_table(spark, sf, "documents"), _vocabulary())
    return bpe.decode(encoded, _vocabulary()).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op2_fingerprints")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf, "documents"))


def toxicity_model(docs: DataFrame, spark: SparkSession, sf: str) -> toxicity.ToxicityModel:
    """Fitted on the labelled rows of ``docs`` outside the held-out fold."""
    labels = _table(spark, sf, "labels").where(~toxicity.held_out())
    return toxicity.fit(docs, labels.select("doc_id", F.col("toxic").alias("label")))


@query("op3_toxicity")
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, spark, sf))
    return scored.select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


# Words and shingles as the operators take them, for the SQL below.
_WORDS_SQL = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHINGLES_SQL = f"""
  SELECT {{id}} AS id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM (SELECT {{id}}, {_WORDS_SQL.replace("coalesce(text, '')", _LOWER_SQL)} AS w FROM {{table}})
"""


@query(
    "op6_substring_dedup",
    f"""
    WITH w AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
    win AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 20], ' ')) AS h
            FROM w, unnest(range(0, len(w) - 19)) AS t(i) WHERE len(w) >= 20),
    dup AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
    gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 20)))) AS spots FROM dup GROUP BY doc_id)
    SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(spots), 0)::BIGINT AS n_removed,
           sha256(array_to_string(CASE WHEN spots IS NULL THEN w ELSE list_transform(
             list_sort(list_where(range(1, len(w) + 1), list_transform(range(0, len(w)), lambda i: NOT list_contains(spots, i)))), lambda i: w[i]) END, ' ')) AS kept_sha256
    FROM w LEFT JOIN gone USING (doc_id)
    """,
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.repeats_removed(_table(spark, sf, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


@query("op8_licenses")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf, "documents"))


@query(
    "op9_decontamination",
    f"""
    WITH d AS ({_SHINGLES_SQL.format(id="doc_id", table="documents")}), b AS ({_SHINGLES_SQL.format(id="item_id", table="benchmark")}),
    du AS (SELECT id, unnest(s) AS h FROM d), bu AS (SELECT id, len(s) AS n, unnest(s) AS h FROM b)
    SELECT du.id AS doc_id, bu.id AS item_id, count(*) AS n_shared, n AS n_item, count(*) / n AS containment
    FROM bu JOIN du USING (h) GROUP BY du.id, bu.id, n HAVING 100 * count(*) >= 75 * n
    """,
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.contaminations(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


@query("op10_secret_scan")
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf, "documents"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))
    return found.select(
        "doc_id",
        *map(number, secret_scan.BASE),
        F.sha2(secret_scan.joined(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


@query(
    "op7_near_dedup",
    f"""
    WITH RECURSIVE d AS ({_SHINGLES_SQL.format(id="doc_id", table="documents")}),
    cls AS (SELECT min(id) AS id, any_value(s) AS s, list(id) AS ids FROM (SELECT id, list_sort(s) AS s FROM d WHERE len(s) > 0) GROUP BY hash(s), len(s)),
    u AS (SELECT id, len(s) AS n, unnest(s) AS h FROM cls),
    pair AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.h = b.h AND a.id < b.id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
             GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
    edge AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
    reach AS (SELECT id AS a, id AS b FROM cls UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
    root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a),
    member AS (SELECT unnest(ids) AS doc_id, root FROM cls JOIN root USING (id))
    SELECT d.id AS doc_id, len(s)::BIGINT AS n_shingles, coalesce(root, d.id) AS component_id, coalesce(root, d.id) = d.id AS kept
    FROM d LEFT JOIN member ON member.doc_id = d.id
    """,
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf, "documents"))


@query("op5_pii")
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return pii.find(docs, pii.fit(docs)).select(
        "doc_id",
        *map(number, pii.KINDS),
        F.sha2(secret_scan.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


@query("op11_cross_tokenizer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.link_statistics(_table(spark, sf, "documents"), _vocabulary(), public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_nearest")
def _(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _table(spark, sf, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


# The bits of a decimal text, with the polynomial of crc32, byte by byte; only the remainder by 4 is wanted.
_CRC_STEP = "xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1))"
_CRC_SQL = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({}::VARCHAR, ''),"
    f" lambda s: [ord(s)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, e: {_CRC_STEP}))"
)


@query(
    "op13_prefix_trie",
    f"""
    WITH p AS (SELECT conv_id AS c, w, s, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, s) AS i FROM (
      SELECT conv_id, turn, len({_WORDS_SQL}) AS w, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS s
      FROM conversations WHERE conv_id IS NOT NULL)),
    convs AS (SELECT c, c - c % 20 AS b, {_CRC_SQL.format("c")} % 4 AS h FROM (SELECT DISTINCT c FROM p)),
    kept AS (SELECT convs.*, (SELECT count(*) FROM p WHERE p.c = b AND i <= h) AS k FROM convs),
    seq AS (SELECT kept.c, i AS d, w, s FROM kept JOIN p ON p.c = b AND i <= h UNION ALL SELECT kept.c, i - h + k, w, s FROM kept JOIN p ON p.c = kept.c AND i > h),
    whole AS (SELECT c, list(s ORDER BY d) FILTER (s IS NOT NULL) AS l, list(w ORDER BY d) FILTER (s IS NOT NULL) AS ws FROM kept LEFT JOIN seq USING (c) GROUP BY c),
    path AS (SELECT c, d, coalesce(len(l), 0) = d AS last, md5(array_to_string(coalesce(l[1:d], []), ',')) AS node,
               CASE WHEN d > 0 THEN md5(array_to_string(coalesce(l[1:d - 1], []), ',')) END AS parent, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w
             FROM whole, unnest(range(0, coalesce(len(l), 0) + 1)) AS t(d)),
    node AS (SELECT node, any_value(parent) AS parent, any_value(d) AS d, min(c) AS c, count(*) AS n, (count(*) - 1) * any_value(w) AS saved,
               sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends FROM path GROUP BY node),
    kids AS (SELECT parent AS node, count(*) AS n_children FROM node GROUP BY parent),
    total AS (SELECT path.node, sum(u.saved)::BIGINT AS saved, count(*) FILTER (kids.node IS NULL) AS leaves
              FROM path JOIN node u ON u.c = path.c AND path.d <= u.d LEFT JOIN kids ON kids.node = u.node GROUP BY path.node)
    SELECT node.c AS conv_id, node.d AS depth, up.c AS parent_conv_id, node.n AS n_convs, coalesce(n_children, 0) AS n_children,
           leaves AS n_leaves, total.saved AS saved_tokens, node.ends AS ends_sha256
    FROM node JOIN total USING (node) LEFT JOIN kids USING (node) LEFT JOIN node up ON up.node = node.parent
    """,
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.continued(_table(spark, sf, "conversations")))
