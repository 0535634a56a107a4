"""The prefix trie of conversations by van Emde Boas recursion: depths are cut in halves down to single turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staygauge.session import settle

# Fixed values of the contract.
FAMILY = 20
MOST_SHARED = 4

IDS_PER_CHUNK = 4096
TIE_CHARS = 64

_NODE = ["depth", "a", "b"]


def _pair(*columns: str | Column) -> tuple[Column, Column]:
    """Two 64-bit hashes with different seeds."""
    return F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit(2), *columns)


def _bit(value: Column, k: int) -> Column:
    return F.shiftright(value, k).bitwiseAND(F.lit(1)) == 1


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, task, at, s1, s2, words): the turns of all conversations, ``at`` counting them within a task in their order; and
    (conv_id, task, first, n, before): where a task's part of a conversation begins, and its turns in earlier tasks.

    A range sort, so a conversation of any length is spread over tasks. Texts stay behind: a turn goes on as a hash of its role
    and text and its number of words.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    s1, s2 = _pair(role, text)
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.substring(role, 1, TIE_CHARS).alias("role"), F.substring(text, 1, TIE_CHARS).alias("text"), s1.alias("s1"), s2.alias("s2"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "s1", "s2"]
    turns = turns.repartitionByRange(*order, F.rand(7)).sortWithinPartitions(*order)  # equal rows may lie in several tasks
    turns = settle(turns.select("conv_id", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at"),
                                "s1", "s2", "words"), "turns")
    parts = turns.groupBy("conv_id", "task").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    return turns, settle(parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "parts")


def rebuilt_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, s1, s2, words, last): the turns of the rebuilt conversations; and (conv_id, length) of all of them."""
    turns, parts = ordered_turns(conversations)
    own = parts.groupBy("conv_id").agg(F.sum("n").alias("own"))
    known = own.withColumns({
        "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED, "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    base = own.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    shared = F.least("h", F.coalesce("base_turns", F.lit(0)))
    known = settle(known.join(base, "base", "left").select(
        "conv_id", "base", "h", shared.alias("shared"), (shared + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "lengths")
    places = settle(parts.join(known, "conv_id").select(
        "conv_id", "task", (F.col("before") - F.col("first") + 1).alias("shift"), "h", "shared", "length"), "places")
    ranked = settle(turns.join(places, ["conv_id", "task"]).withColumn("rank", F.col("at") + F.col("shift")), "ranked")
    kept = ranked.filter("rank > h").withColumn("depth", F.col("rank") - F.col("h") + F.col("shared"))
    heads = ranked.filter(F.col("rank") < MOST_SHARED).select(F.col("conv_id").alias("base"), F.col("rank").alias("depth"), "s1", "s2", "words")
    heads = heads.join(known, "base").filter("depth <= shared")
    fields = ["conv_id", "depth", "s1", "s2", "words", (F.col("depth") == F.col("length")).alias("last")]
    return settle(kept.select(*fields).unionAll(heads.select(*fields)), "rebuilt"), known.select("conv_id", "length")


def named_prefixes(turns: DataFrame, deepest: int) -> DataFrame:
    """(conv_id, depth, words, last, a, b): (a, b) names the prefix of that depth, equal for equal prefixes.

    Depths 0 to 2 ** levels - 1 are cut in half: the prefix up to the cut is named by what came before and the turns from there to
    the cut; what lies below it becomes a trie under that name, of half the depth, as is the trie above. Both halves of all tries
    of one size are one join; after ``levels`` of them the tries have a single depth left. Hashes of the turns between cuts come
    from pairs of neighbouring blocks, which are counted up to full ones only.
    """
    levels = deepest.bit_length()
    block = settle(turns.select("conv_id", (F.col("depth") - 1).alias("block"), F.col("s1").alias("d1"), F.col("s2").alias("d2")), "blocks")
    blocks = []
    for _ in range(levels):
        blocks.append(block)
        side = lambda d, odd: F.max(F.when(_bit(F.col("block"), 0) == odd, F.col(d)))
        halves = block.groupBy("conv_id", F.shiftright("block", 1).alias("block")).agg(
            *[side(d, odd).alias(f"{d}_{int(odd)}") for d in ("d1", "d2") for odd in (False, True)], F.count(F.lit(1)).alias("n"))
        d1, d2 = _pair("d1_0", "d2_0", "d1_1", "d2_1")
        if len(blocks) < levels:
            block = settle(halves.filter("n = 2").select("conv_id", "block", d1.alias("d1"), d2.alias("d2")), "blocks")
    named = turns.select("conv_id", "depth", "words", "last", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for k in reversed(range(levels)):
        # Depths in the upper half have an odd number here or none, and meet no cut.
        cut = blocks[k].filter(~_bit(F.col("block"), 0)).withColumnRenamed("block", "cut")
        a, b = _pair("a", "b", "d1", "d2")
        below = F.col("d1").isNotNull()
        named = named.withColumn("cut", F.shiftright("depth", k) - 1).join(cut, ["conv_id", "cut"], "left").select(
            "conv_id", "depth", "words", "last", F.when(below, a).otherwise(F.col("a")).alias("a"), F.when(below, b).otherwise(F.col("b")).alias("b"))
    return settle(named, "named")


def grafted(nodes: DataFrame, named: DataFrame, deepest: int, totals: list[str]) -> DataFrame:
    """``nodes`` with ``totals`` summed over each node's subtree.

    The recursion backwards: blocks of 1, 2, 4, ... depths are joined in pairs. The tries of the lower block have their totals
    already; those of a top node are grafted on all its ancestors in the upper block, which its smallest member passes through.
    A level moves a row per top node and ancestor in the block, never more than the turns.
    """
    level = F.col("depth") - 1
    k = 0
    while 1 << k <= deepest - 1:
        block = F.shiftright(level, k + 1).alias("block")
        tops = nodes.filter(level.bitwiseAND(F.lit((2 << k) - 1)) == 1 << k).select("conv_id", block, *totals)
        above = named.filter(~_bit(level, k)).select("conv_id", block, *_NODE)
        gains = above.join(tops, ["conv_id", "block"]).groupBy(*_NODE).agg(*[F.sum(c).alias(f"more_{c}") for c in totals])
        joined = nodes.join(gains, _NODE, "left")
        nodes = settle(joined.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in totals}).select(*nodes.columns), "grafted")
        k += 1
    return nodes


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of rows (depth, a, b, conv_id): the digest of the node's ids, ascending and comma-joined.

    Ids are joined in chunks of a range of IDS_PER_CHUNK numbers each; the chunks of a node stream into its digest in order.
    """
    chunk = F.floor(F.col("conv_id") / IDS_PER_CHUNK).alias("chunk")
    joined = F.array_join(F.sort_array(F.collect_set("conv_id")).cast("array<string>"), ",")
    chunks = ends.groupBy(*_NODE, chunk).agg(joined.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = digest = None
        for batch in batches:
            rows = []
            for depth, a, b, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (depth, a, b) != node:
                    if node is not None:
                        rows.append((*node, digest.hexdigest()))
                    node, digest = (depth, a, b), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _digest_batch(rows)
        yield _digest_batch([] if node is None else [(*node, digest.hexdigest())])

    return chunks.repartition(*_NODE).sortWithinPartitions(*_NODE, "chunk").mapInArrow(
        run, "depth long, a long, b long, ends_sha256 string")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [*_NODE, "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations (conv_id, turn, role, text): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by number, null first; rows of one number by role and text (their first 64 characters, then a hash), and
    repeated rows are turns of their own. Null roles and texts are empty. Rows of a null conv_id belong to no conversation. A
    conversation that is rebuilt without turns is a member of the root only. Other columns are not read; an empty table has no
    root and gives no row.

    A prefix is compared by 128 bits of hashes. A common prefix is counted on the map side and never gathered; its smallest
    member and its depth name it in the result. Nothing is read by the driver but the greatest length.
    """
    turns, known = rebuilt_conversations(conversations)
    deepest = known.agg(F.max("length")).first()[0] or 0
    named = named_prefixes(turns, deepest)
    nodes = settle(named.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words")), "nodes")
    # A node's parent is where its smallest member was one turn before.
    before = named.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"))
    linked = settle(nodes.join(before, ["conv_id", "depth"], "left"), "linked")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")]
    children = linked.filter("depth > 1").groupBy(*parent).agg(F.count(F.lit(1)).alias("n_children"))
    over = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"),
                        F.col("conv_id").alias("parent_conv_id"))
    whole = linked.join(over, ["depth", "up_a", "up_b"], "left").join(children, _NODE, "left")
    n_children = F.coalesce("n_children", F.lit(0))
    valued = settle(whole.select(
        *_NODE, "conv_id", "parent_conv_id", "n_convs", n_children.alias("n_children"),
        (n_children == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), "valued")
    below = grafted(valued, named, deepest, ["n_leaves", "saved_tokens"])
    zero = F.lit(0).cast("long")
    tops = below.filter("depth = 1").groupBy(zero.alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    first = known.groupBy(zero.alias("depth")).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    root = first.join(tops, "depth", "left").select(
        "depth", zero.alias("a"), zero.alias("b"), "conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        F.coalesce("n_leaves", zero + 1).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"))
    smallest = known.agg(F.min("conv_id").alias("conv_id")).scalar()
    every = below.withColumn("parent_conv_id", F.when(F.col("depth") == 1, smallest).otherwise(F.col("parent_conv_id"))).unionByName(
        root.withColumn("parent_conv_id", F.lit(None).cast("long")))
    ends = named.filter("last").select(*_NODE, "conv_id").unionAll(
        known.filter("length = 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id"))
    found = every.join(ends_digests(ends), _NODE, "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
