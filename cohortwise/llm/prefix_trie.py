"""Operator 13: the trie of all prefixes of conversations, with totals of its subtrees.

A node is a distinct sequence of first turns (role and text); its key is a sum over the turns of hashes
of each turn and its place, so that keys of all prefixes are running sums, also of a conversation that
is cut into chunks. Texts are reduced to digests and word counts where they are read.

Totals of subtrees are rolled up in fragments of the forest of parent edges. A bound of a subtree's size
(the turns that members have from its top on) puts every node in a class, a power of ``FRAGMENT``; nodes
of one class that hang together are a fragment, and fragments of a class are rolled up after those below
them, whose totals wait at the nodes they hang from. Within a group of fragments a centroid decomposition
works on all components at once: each component's centroid is taken out, the totals of the parts below
it are summed and added along the path from the centroid to the component's top, and the parts, of at
most half the size, are taken on in the same way.

Cases: rows without conv_id belong to no conversation; a null turn comes first, rows of one conversation
and turn come in the order of the digest of role and text and each count; null roles and texts are empty;
an empty table gives an empty one; other columns are ignored. A conversation of very many rows is
ordered and summed in chunks of ``CHUNK`` turn numbers; rows with one turn number are ordered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.llm.textwork import bound_batches, settle

FRAGMENT = 4096
CLASSES = 5
GROUP_NODES = 16_384
CHUNK = 1024
ENDS = 65_536
FIRST = -(1 << 40)


def _running(rows: DataFrame, key: str, chunk: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running sums by key, in order, from the first row on; ``chunk`` never falls along the order.

    A chunk is summed in one task; only totals of chunks are ordered per key.
    """
    rows = rows.withColumn("_chunk", chunk)
    upto = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(key, "_chunk").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    offsets = totals.select(key, "_chunk", *[F.sum(f"_{name}").over(before).alias(f"_{name}") for name in sums])
    offsets = offsets.where(" and ".join(f"_{name} is not null" for name in sums))  # none for a first chunk
    summed = rows.withColumns({name: F.sum(c).over(upto) for name, c in sums.items()}).join(offsets, [key, "_chunk"], "left")
    return summed.withColumns({name: F.col(name) + F.coalesce(f"_{name}", F.lit(0)) for name in sums}).drop("_chunk", *[f"_{name}" for name in sums])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv, place (from 1), digest (of role and text) and words of every turn, in order; texts end here."""
    bound_batches(conversations.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    turns = settle(turns, "turns")
    chunk = F.coalesce(F.floor(F.col("turn") / CHUNK).cast("long"), F.lit(FIRST))
    placed = _running(turns, "conv", chunk, [F.asc_nulls_first("turn"), F.asc("digest")], {"place": F.lit(1)})
    return placed.select("conv", "place", "digest", "words")


def _sizes(up: np.ndarray) -> np.ndarray:
    """Nodes in each node's subtree; ``up`` is each node's parent (-1: a top), parents come first."""
    depth, jump = (up >= 0).astype(np.int64), up.copy()
    while (on := jump >= 0).any():  # pointer doubling: edges to the top
        depth[on] += depth[jump[on]]
        jump[on] = jump[jump[on]]
    size = np.ones(len(up), dtype=np.int64)
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts):
        level = level[up[level] >= 0]
        np.add.at(size, up[level], size[level])
    return size


def _tops(up: np.ndarray) -> np.ndarray:
    """The top of each node's component."""
    top = np.where(up < 0, np.arange(len(up)), up)
    while True:
        further = top[top]
        if (further == top).all():
            return top
        top = further


def subtree_sums(up: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (a row per node) over each node's subtree, by centroid decomposition.

    ``up`` is each node's parent or -1. Sizes are counted once; after that each centroid's size and sum
    go to the nodes between it and its component's top. A component halves at least with each round.
    """
    up, sums, size = up.astype(np.int64), np.zeros_like(values), _sizes(up)
    live, top = np.arange(len(up)), _tops(up)
    while len(live):
        heavy = live[2 * size[live] >= size[top[live]]]
        below = np.zeros(len(up), dtype=bool)
        below[up[heavy][up[heavy] >= 0]] = True
        centroid = heavy[~below[heavy]]  # the deepest node with at least half of its component
        taken = np.zeros(len(up), dtype=bool)
        taken[centroid] = True
        live = live[~taken[live]]
        cut = live[(up[live] >= 0) & taken[up[live]]]
        owner, path = up[cut], up[centroid]
        up[cut] = up[centroid] = -1
        top = _tops(up)
        totals = np.zeros_like(values)  # of the new components, at their tops
        np.add.at(totals, top[live], values[live])
        own = values.copy()
        np.add.at(own, owner, totals[cut])
        gained, less = own[centroid], size[centroid]
        sums[centroid] += gained
        while (on := path >= 0).any():
            path, gained, less = path[on], gained[on], less[on]
            sums[path] += gained
            size[path] -= less
            path = up[path]
    return sums


def _roll_up(nodes: pa.Table) -> pa.Table:
    """Totals of some whole fragments: the nodes of the group with what hangs below them added up."""
    nodes = nodes.sort_by("depth")
    above = pc.index_in(nodes.column("parent"), value_set=nodes.column("node").combine_chunks())
    up = pc.fill_null(above, -1).to_numpy().astype(np.int64)
    column = lambda name: nodes.column(name).to_numpy().astype(np.int64)
    children = column("below") + np.bincount(up[up >= 0], minlength=len(up))
    saved = (column("n_convs") - 1) * column("words") + column("saved_below")
    leaves = (children == 0).astype(np.int64) + column("leaves_below")
    sums = subtree_sums(up, np.column_stack([leaves, saved]))
    conv = column("conv")
    outer = nodes.column("outer").to_numpy(zero_copy_only=False)  # known for tops
    parent_conv = pa.array(np.where(up >= 0, conv[up], 0), mask=up < 0)
    parent_conv = pc.if_else(pa.array(up >= 0), parent_conv, pa.array(outer, pa.int64(), from_pandas=True))
    return pa.table(
        {
            "node": nodes.column("node"), "parent": nodes.column("parent"), "top": pa.array(up < 0), "conv_id": conv, "depth": column("depth"),
            "parent_conv_id": parent_conv, "n_convs": column("n_convs"), "n_children": children, "n_leaves": sums[:, 0], "saved_tokens": sums[:, 1],
        }
    )


def _ends(rows: DataFrame) -> DataFrame:
    """node, ends_sha256: digest of the ids (conv) that end at each node, ascending, joined by commas.

    Ids are joined in blocks of ``ENDS`` numbers; a node's blocks stream through the hash in order.
    """
    blocks = rows.groupBy("node", F.floor(F.col("conv") / ENDS).alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done = []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node == at:
                    state.update(b",")
                else:
                    if at is not None:
                        done.append((at, state.hexdigest()))
                    at, state = node, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], ["node", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    in_order = blocks.repartition("node").sortWithinPartitions("node", "block").select("node", "ids")
    return in_order.mapInArrow(digest, "node binary, ends_sha256 string")


def _key(*sums: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws("_", *[s.cast("string") for s in sums])))


def trie(members: DataFrame, turns: DataFrame) -> DataFrame:
    """All nodes of the trie.

    Args: ``members``: conv and n, the number of its turns, of every conversation, those without turns
    too; ``turns``: conv, place (1 to n), digest, words.
    Returns for each node, the root (depth 0) included: conv_id (its smallest member), depth,
    parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens (words of last turns
    that members repeat, over the subtree), all long, and ends_sha256 of the members that end there.
    """
    spark = turns.sparkSession
    members = settle(members.select("conv", "n"), "members")
    root = members.agg(F.count("*"), F.min("conv"), F.sum(F.col("n") + 1)).first()
    schema = (
        "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    )
    if not root[0]:
        return spark.createDataFrame([], schema)

    # Keys of prefixes: two running sums of hashes of each turn and its place.
    term = {name: F.xxhash64(F.lit(k), "digest", "place").cast("decimal(38,0)") for k, name in enumerate(("one", "two"), 1)}
    summed = _running(turns, "conv", F.floor(F.col("place") / CHUNK).cast("long"), [F.asc("place")], term)
    paths = summed.join(members, "conv").select(
        "conv",
        F.col("place").alias("depth"),
        _key(F.col("one"), F.col("two")).alias("node"),
        _key(F.col("one") - term["one"], F.col("two") - term["two"]).alias("parent"),
        "words",
        (F.col("n") - F.col("place") + 1).alias("left"),
    )
    paths = settle(paths, "paths")
    root_key = _key(F.lit(0), F.lit(0))

    # Classes of nodes by the turns that their members have from there on, which never rise along a path.
    large = paths.groupBy("node").agg(F.sum("left").alias("weight"), F.min("conv").alias("outer")).where(F.col("weight") > FRAGMENT)
    rank = reduce(lambda a, b: a + b, [F.when(F.col("weight") > FRAGMENT**k, 1).otherwise(0) for k in range(1, CLASSES + 1)])
    large = settle(large.select("node", "outer", rank.alias("class")), "large")
    marked = paths.join(large.select("node", "class"), "node", "left").withColumn("class", F.coalesce("class", F.lit(0)))
    marked = settle(marked, "marked")
    fragment = marked.groupBy("conv", "class").agg(F.min_by("node", "depth").alias("fragment"))
    parents = large.select(F.col("node").alias("parent"), "outer").unionByName(
        spark.range(1).select(root_key.alias("parent"), F.lit(root[1]).cast("long").alias("outer"))
    )
    # members of a node agree in all but conv and left
    one = [F.any_value(c).alias(c) for c in ("parent", "depth", "words", "class", "fragment")]
    nodes = (
        marked.join(fragment, ["conv", "class"])
        .groupBy("node")
        .agg(*one, F.count("*").alias("n_convs"), F.min("conv").alias("conv"))
        .join(parents, "parent", "left")
    )
    nodes = settle(nodes, "nodes")

    counts = dict(map(tuple, nodes.groupBy("class").count().collect()))
    rolled: list[DataFrame] = []
    empty = spark.createDataFrame([], "node binary, below long, leaves_below long, saved_below long")

    def hanging() -> DataFrame:
        """What hangs below nodes, by node, from the fragments done so far."""
        tops = [r.where("top") for r in rolled]
        if not tops:
            return empty
        return reduce(DataFrame.unionByName, tops).groupBy(F.col("parent").alias("node")).agg(
            F.count("*").alias("below"), F.sum("n_leaves").alias("leaves_below"), F.sum("saved_tokens").alias("saved_below")
        )

    out = (
        "node binary, parent binary, top boolean, conv_id long, depth long, parent_conv_id long,"
        " n_convs long, n_children long, n_leaves long, saved_tokens long"
    )
    for level in sorted(counts):
        groups = -(-counts[level] // GROUP_NODES)
        below = ("below", "leaves_below", "saved_below")
        whole = nodes.where(F.col("class") == level).join(hanging(), "node", "left").na.fill(0, list(below))
        wanted = whole.select("node", "parent", "depth", "words", "n_convs", "conv", "outer", *below, F.pmod(F.xxhash64("fragment"), F.lit(groups)).alias("part"))
        rolled.append(settle(wanted.groupBy("part").applyInArrow(lambda t: _roll_up(t), out), "rolled"))

    under = hanging().where(F.col("node") == root_key).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("below", "leaves_below", "saved_below")])
    top = under.select(
        root_key.alias("node"),
        F.lit(root[1]).cast("long").alias("conv_id"),
        F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(root[0]).cast("long").alias("n_convs"),
        F.col("below").alias("n_children"),
        F.when(F.col("below") == 0, 1).otherwise(F.col("leaves_below")).cast("long").alias("n_leaves"),
        F.col("saved_below").alias("saved_tokens"),
    )
    ends = paths.where("left = 1").select("node", "conv").unionByName(members.where("n = 0").select(root_key.alias("node"), "conv"))
    columns = [c.split()[0] for c in schema.split(", ")]
    every = reduce(DataFrame.unionByName, [r.select("node", *columns[:-1]) for r in rolled], top)
    return (
        every.join(_ends(ends), "node", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))
        .select(*columns)
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are; see ``trie`` for what it returns."""
    turns = settle(numbered_turns(conversations), "numbered")
    return trie(turns.groupBy("conv").agg(F.max("place").alias("n")), turns)


def continued(conversations: DataFrame, every: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations that go on from the beginning of another: members and turns, as ``trie`` takes them.

    Conversation c begins with the first h turns (or all, if fewer) of conversation c - c % ``every`` as
    it was, if there is one, and goes on with its own turns after its first h; h is crc32 of c in decimal
    modulo ``most`` + 1.
    """
    turns = settle(numbered_turns(conversations), "numbered")
    first = turns.where((F.col("conv") % every == 0) & (F.col("place") <= most))
    heads = first.groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "digest", "words"))).alias("head"))
    convs = turns.groupBy("conv").agg(F.max("place").alias("own"))
    h = F.crc32(F.col("conv").cast("string")) % (most + 1)
    convs = convs.withColumn("base", F.col("conv") - F.col("conv") % every).withColumn("h", h).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<place:bigint,digest:binary,words:bigint>>")), F.lit(1), F.col("h").cast("int"))
    convs = convs.withColumn("head", head).withColumn("k", F.size("head").cast("long"))
    convs = settle(convs.select("conv", "own", "h", "k", "head"), "convs")
    members = convs.select("conv", (F.greatest(F.col("own") - F.col("h"), F.lit(0)) + F.col("k")).alias("n"))
    begun = convs.select("conv", F.inline("head"))
    going_on = turns.join(convs.select("conv", "h", "k"), "conv").where(F.col("place") > F.col("h"))
    going_on = going_on.select("conv", (F.col("place") - F.col("h") + F.col("k")).alias("place"), "digest", "words")
    return members, settle(begun.unionByName(going_on), "continued")
