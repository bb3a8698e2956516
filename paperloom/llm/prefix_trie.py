"""Prefix trie of conversations by ROLLUP over positional turn-id columns.

A node is a distinct sequence of the first ``d`` turns (role and text) of a conversation; all conversations that start with
it are its members. Conversations are cut into blocks of ``WIDTH`` turns. A block is one row with the ids of its turns as
columns, and one ``GROUP BY prior, block, ROLLUP (turn 1, ..., turn WIDTH)`` aggregates all prefixes of all blocks
together; ``grouping_id`` tells the depth of a group. Later blocks are keyed by the node that the block before ends in.

A turn's id is a 128-bit hash of its role, text and position, so the exclusive or of the ids of a prefix names its node:
the prior node of every block is a running aggregate and needs no loop over blocks. That aggregate, like the places of
turns, is computed over range-dealt parts (``ordering``): a conversation with most of all turns lies in many tasks.

Aggregates over subtrees are aggregates over members as well, which the second ROLLUP sums. The member with the smallest
id stands for a node, and it stands for all nodes below on its way once it does. So a leaf is counted at the conversation
that stands for it, and the tokens that a node saves, (members - 1) times the bytes of its last turn, are those bytes
summed over the members that don't stand for it. A conversation adds to a node the bytes of its turns from there to the
place where it begins to stand: a difference of two running sums.

The digest of the members that end in a node takes their ids in numerical order. They are sorted by ranges, joined in
pieces of ``PIECE`` ids, and the pieces of a node pass through one running SHA-256, which holds nothing but its state.

Defined cases: a null role or text is empty; turns are ordered by turn (null first), then role, then the hash of the text,
so repeated turns stay apart and equal ties change nothing; rows without a conversation id belong to no conversation and
are left out; conversations without turns end in the root; no conversation at all gives no node; the user's other columns
are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .ordering import PLACE_BITS, in_order, numbered, running_before

#: Turns of a block: columns of the ROLLUP.
WIDTH = 8
#: Ids that are joined to one piece before a digest.
PIECE = 4096


def turn_digest(role: Column, text: Column) -> Column:
    """MD5 of a turn; the length of the role keeps role and text apart."""
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def numbered_turns(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``(conv_id, nth, digest, bytes)``: the turns of every conversation, numbered from 1. Texts go no further than here."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    small = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"),
        turn_digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
    )
    placed = in_order(small, "conv_id", F.col("turn").asc_nulls_first(), "role", "digest")
    return numbered(placed, "conv_id").select("conv_id", "nth", "digest", "bytes")


def with_shared_starts(turns: DataFrame, groups: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the start of another: ``(conversations, turns)``, turns as ``numbered_turns`` gives them.

    Conversation c gets the first h turns of conversation ``c - c % groups``, then its own after its first h; h is crc32 of
    c's digits modulo ``most + 1``.
    """
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    ids = lengths.select(
        "conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).alias("h"), (F.col("conv_id") - F.col("conv_id") % groups).alias("base"),
    )
    ids = ids.join(lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    ids = stored(ids.select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("shared")), "conversations")
    starts = turns.filter(F.col("nth") <= most).withColumnRenamed("conv_id", "base").join(ids.filter("shared > 0"), "base")
    starts = starts.filter("nth <= shared").select("conv_id", "nth", "digest", "bytes")
    own = turns.join(ids, "conv_id").filter("nth > h").select("conv_id", (F.col("nth") - F.col("h") + F.col("shared")).alias("nth"), "digest", "bytes")
    return ids.select("conv_id"), stored(starts.unionByName(own), "rebuilt")


def _xor(*columns: Column) -> Column:
    return functools.reduce(lambda a, b: a.bitwiseXOR(b), columns)


PLACES = range(1, WIDTH + 1)


def _blocks(turns: DataFrame) -> DataFrame:
    """``(conv_id, block, n, a1, b1, bytes1, ..., prior_a, prior_b, earlier)``: a row per block of a conversation."""
    at = (F.col("nth") - 1) % WIDTH + 1
    ids = turns.select(
        "conv_id", "bytes", F.floor((F.col("nth") - 1) / WIDTH).alias("block"), at.alias("k"),
        F.xxhash64("digest", "nth").alias("a"), F.xxhash64("nth", "digest", F.lit(1)).alias("b"),
    )
    placed = [F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in PLACES for c in ("a", "b", "bytes")]
    blocks = ids.groupBy("conv_id", "block").agg(
        F.count("*").alias("n"), F.bit_xor("a").alias("xor_a"), F.bit_xor("b").alias("xor_b"), F.sum("bytes").alias("sum_bytes"), *placed
    )
    ordered = in_order(stored(blocks, "blocks"), "conv_id", "block")
    xor, plus = (lambda a, b: a.bitwiseXOR(b)), (lambda a, b: a + b)
    return running_before(
        ordered, "conv_id", prior_a=(F.bit_xor, xor, F.col("xor_a")), prior_b=(F.bit_xor, xor, F.col("xor_b")), earlier=(F.sum, plus, F.col("sum_bytes"))
    ).drop("at")


def _rolled_up(rows: DataFrame, aggregates: str) -> DataFrame:
    """``(key_a, key_b, depth, parent_a, parent_b)`` of every prefix of the blocks in ``rows``, with the aggregates."""
    columns = ", ".join(f"(a{k}, b{k})" for k in PLACES)
    rolled = rows.sparkSession.sql(
        f"SELECT prior_a, prior_b, block, {', '.join(f'a{k}, b{k}' for k in PLACES)}, {WIDTH} - bit_count(grouping_id()) DIV 2 AS level, {aggregates}"
        f" FROM {{rows}} GROUP BY prior_a, prior_b, block, ROLLUP({columns})", rows=rows,
    )
    turn = lambda c: F.get(F.array(*(F.col(f"{c}{k}") for k in PLACES)), (F.col("level") - 1).cast("int"))
    # a group whose last column is null stands for conversations that ended before
    real = rolled.filter("level > 0").withColumns({"last_a": turn("a"), "last_b": turn("b")}).filter("last_a IS NOT NULL")
    key = {c: _xor(F.col(f"prior_{c}"), *(F.coalesce(f"{c}{k}", F.lit(0)) for k in PLACES)) for c in "ab"}
    kept = [c for c in rolled.columns if c not in {"prior_a", "prior_b", "block", *(f"{c}{k}" for c in "ab" for k in PLACES)}]
    keyed = real.select(*kept, "last_a", "last_b", (F.col("block") * WIDTH + F.col("level")).alias("depth"), key["a"].alias("key_a"), key["b"].alias("key_b"))
    return keyed.withColumns({"parent_a": F.col("key_a").bitwiseXOR(F.col("last_a")), "parent_b": F.col("key_b").bitwiseXOR(F.col("last_b"))}).drop("last_a", "last_b")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of a node, which follow each other."""
    now, state = None, None

    def told(keys: list, digests: list) -> pa.RecordBatch:
        columns = [pa.array([k[n] for k in keys], pa.int64()) for n in range(3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string())], names=["key_a", "key_b", "depth", "digest"])

    for batch in batches:
        keys, digests = [], []
        for *key, piece in zip(*(batch.column(c).to_pylist() for c in ("key_a", "key_b", "depth", "piece")), strict=True):
            if key == now:
                state.update(b"," + piece.encode())
                continue
            if now is not None:
                keys.append(now)
                digests.append(state.hexdigest())
            now, state = key, hashlib.sha256(piece.encode())
        yield told(keys, digests)
    if now is not None:
        yield told([now], [state.hexdigest()])


def _ends(conversations: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(key_a, key_b, depth, digest)`` of the nodes that conversations end in."""
    paths = blocks.groupBy("conv_id").agg(F.bit_xor("xor_a").alias("key_a"), F.bit_xor("xor_b").alias("key_b"), F.sum("n").alias("depth"))
    ends = conversations.join(paths, "conv_id", "left").na.fill(0, ["key_a", "key_b", "depth"])
    placed = in_order(stored(ends, "ends"), "key_a", "key_b", "depth", "conv_id")
    piece = (F.shiftright("at", PLACE_BITS), F.floor(F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) / PIECE))
    pieces = placed.groupBy("key_a", "key_b", "depth", piece[0].alias("part"), piece[1].alias("nth")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    joined = pieces.select("key_a", "key_b", "depth", "part", "nth", F.array_join(F.col("ids").cast("array<string>"), ",").alias("piece"))
    sorted_pieces = joined.repartition("key_a", "key_b", "depth").sortWithinPartitions("key_a", "key_b", "depth", "part", "nth")
    return sorted_pieces.drop("part", "nth").mapInArrow(_digests, "key_a long, key_b long, depth long, digest string")


def prefix_trie(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """A row per node: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``.

    ``conversations`` are the distinct ids, those without turns too; ``turns`` are ``(conv_id, nth, digest, bytes)`` as
    ``numbered_turns`` or ``with_shared_starts`` give them.
    """
    blocks = stored(_blocks(turns), "trie-blocks")
    key = ["key_a", "key_b", "depth"]
    nodes = stored(_rolled_up(blocks, "min(conv_id) AS conv_id, count(*) AS n_convs"), "nodes")
    children = nodes.groupBy(F.col("parent_a").alias("key_a"), F.col("parent_b").alias("key_b"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    children = stored(children, "children")
    counted = nodes.join(children, key, "left").na.fill(0, ["n_children"])

    # where a conversation begins to stand for its nodes, and whether it stands for the leaf that it ends in
    stands = counted.groupBy("conv_id").agg(F.min("depth").alias("from"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    before = lambda k: F.col("earlier") + sum((F.coalesce(f"bytes{j}", F.lit(0)) for j in range(1, k)), F.lit(0))
    begins = stands.withColumn("block", F.floor((F.col("from") - 1) / WIDTH)).join(blocks, ["conv_id", "block"])
    until = F.get(F.array(*(before(k) for k in PLACES)), ((F.col("from") - 1) % WIDTH).cast("int"))
    begins = begins.select("conv_id", "leaf", until.alias("until"))
    totals = blocks.groupBy("conv_id").agg(F.sum("sum_bytes").alias("total"))
    marks = totals.join(begins, "conv_id", "left").select("conv_id", F.coalesce("until", "total").alias("until"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    marked = blocks.join(stored(marks, "marks"), "conv_id").withColumns(
        {f"saved{k}": F.greatest(F.lit(0), F.col("until") - before(k)) for k in PLACES}
    )
    sums = _rolled_up(marked, "sum(leaf) AS n_leaves, " + ", ".join(f"sum(saved{k}) AS saved{k}" for k in PLACES))
    saved = F.get(F.array(*(F.col(f"saved{k}") for k in PLACES)), (F.col("level") - 1).cast("int"))
    sums = sums.select(*key, "n_leaves", saved.alias("saved_tokens"))

    digests = stored(_ends(conversations, blocks), "digests")
    no_digest = hashlib.sha256(b"").hexdigest()
    root = _root(conversations, nodes, marked)
    parents = nodes.select(F.col("key_a").alias("parent_a"), F.col("key_b").alias("parent_b"), F.col("depth").alias("parent_depth"), F.col("conv_id").alias("parent_conv_id"))
    parents = parents.unionByName(root.select(*(F.lit(0).cast("long").alias(c) for c in ("parent_a", "parent_b", "parent_depth")), F.col("conv_id").alias("parent_conv_id")))
    below = counted.join(sums, key).withColumn("parent_depth", F.col("depth") - 1).join(parents, ["parent_a", "parent_b", "parent_depth"])
    columns = [*key, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    every = below.select(columns).unionByName(root.select(columns)).join(digests, key, "left")
    told = every.withColumn("ends_sha256", F.coalesce("digest", F.lit(no_digest)))
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _root(conversations: DataFrame, nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """The node of depth 0, if there is a conversation: sums over all, without a text of its own."""
    all_of = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    top = nodes.filter("depth = 1").agg(F.count("*").alias("n_children"))
    below = marked.filter("block = 0").agg(F.coalesce(F.sum("saved1"), F.lit(0)).alias("saved_tokens"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_below"))
    # three rows that complete each other
    rows = all_of.unionByName(top, allowMissingColumns=True).unionByName(below, allowMissingColumns=True)
    joined = rows.agg(*(F.max(c).alias(c) for c in rows.columns)).filter("n_convs > 0")
    return joined.select(
        *(F.lit(0).cast("long").alias(c) for c in ("key_a", "key_b", "depth")), "conv_id",
        F.lit(None).cast(conversations.schema["conv_id"].dataType).alias("parent_conv_id"), "n_convs", "n_children",
        F.greatest("n_below", F.lit(1)).alias("n_leaves"), "saved_tokens",
    )
