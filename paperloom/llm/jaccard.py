"""Jaccard join on word shingles with token-combination prefixes.

A document is the set of its distinct five-word shingles ("tokens"). Two sets link when 100 * intersection >= 75 *
union. Sets that are equal are one node. A set of n tokens can miss at most n // 4 of them in a partner, and nothing but
this is used to leave anything out, so no link is lost:

* **First counts.** Of the ``n // 4 + t`` tokens of least hash, t = n // 6, a partner has t. So only these tokens are
  dealt out and sorted, and a node stays when enough of them occur in another node. Most documents have no partner and
  end here.
* **Exact frequencies.** For the nodes that stay all tokens are counted exactly, among those nodes. Tokens are put in one
  order for all sets: by frequency, then by hash. Tokens of frequency 1 meet nothing; they come first, and a set with
  more than n // 4 of them has no prefix left.
* **Index.** The prefix has ``n // 4 + 1`` units. A token of the rare class is a unit and is indexed alone. Tokens of
  more frequent classes are indexed in combinations of k (two, then three): they are dealt by a hash into parts, and m
  tokens of a part are m - k + 1 units (if fewer of them are missing, k of them are common). The prefix is extended until
  it has the units. The number of parts follows the size class of the set (bounds a factor 4/3 apart), and a set is
  indexed under its own class and the next, so that two sets that can link always share a class.
* **Verification.** Nodes that share an entry of at most ``LIGHT`` nodes are paired; of such a pair, both sets must share
  as many entries as their sizes demand, and then the sets are compared. Larger entries (groups of hundreds of near copies,
  passages that hundreds of documents hold) are not paired: their nodes are dealt into blocks of similar nodes, and blocks
  that share an entry are compared as matrices, which costs a table row per block pair and not per pair. A first round
  compares every block with itself and with one of its group; blocks that are then in one component as a whole are never
  compared with each other in the second round.

So a frequent passage costs combinations, a hub is in no join as such, and only links that span their blocks are written.
Links make components. All comparisons are exact on the whole sets.

Defined cases: a text of fewer than five words is one shingle; null texts and texts without words have no shingle and
link with nothing; ids may be null (never a component's id) or repeat; equal rows share a component; texts of any length
are used whole; an empty table gives an empty result. ``near_dedup`` carries the user's other columns along, whatever
their names; ``jaccard_components`` reads none of them.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, packed, stored
from .components import connected_components

SHINGLE = 5
#: The first counts take n // 4 + n // EXTRA tokens of a set.
EXTRA = 6
#: Tokens of more than so many nodes are indexed in combinations of two, three, ...
CLASS_FROM = (64, 2048)
#: Entries of at most so many nodes are paired, larger ones are compared in blocks.
LIGHT = 64
#: Tokens of a block, and nodes at most; columns of a matrix.
BLOCK_TOKENS, BLOCK_NODES, COLUMNS = 1 << 18, 256, 1 << 13
#: Distinct sets that a task remembers, so as to deal out copies once.
REMEMBERED = 100_000
#: Up to so many keys (about 60 bytes each) are broadcast to fetch texts; beyond, keys and texts are shuffled.
MAX_BROADCAST_KEYS = 200_000
FLUSH_ROWS = 100_000

# Size classes: consecutive bounds are a factor of 4/3 apart, rounded up, so sets that can link are at most one apart.
BOUNDS = [1]
while BOUNDS[-1] < 1 << 40:
    BOUNDS.append((4 * BOUNDS[-1] + 2) // 3)
BOUNDS = np.array(BOUNDS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes, both touch ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mix(out ^ h[k : len(h) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(out)


def set_digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(both and 100 * both >= 75 * (len(a) + len(b) - both))


def parts_of(size_class: int) -> int:
    """Into how many parts the tokens of a class are dealt under a size class; 0: they are indexed alone."""
    return int(BOUNDS[max(size_class - 1, 0)]) // 6


def size_class(n: int | np.ndarray) -> int | np.ndarray:
    return np.searchsorted(BOUNDS, n, side="right") - 1


def first_tokens(tokens: np.ndarray) -> np.ndarray:
    """Those of a set that the first counts take."""
    n = len(tokens)
    return tokens[: n // 4 + max(n // EXTRA, 1)]


def least_common(n: Column) -> Column:
    """How many of a set's first tokens are in another node if it has a partner: the partner may be the smaller one."""
    t = lambda x: F.greatest(F.lit(1), F.floor(x / EXTRA))
    return F.least(t(n), t(F.ceil(n * 3 / 4)))


def index_entries(tokens: np.ndarray, frequency: np.ndarray, n: int) -> np.ndarray:
    """The index entries (64-bit hashes) of a set of ``n`` tokens, of which ``tokens`` occur in other sets as well."""
    need = n // 4 + 1 - (n - len(tokens))
    if need <= 0:
        return np.zeros(0, np.uint64)
    order = np.lexsort((tokens, frequency))
    tokens, combined = tokens[order], 1 + np.searchsorted(CLASS_FROM, frequency[order])  # in combinations of so many
    own = int(size_class(n))
    dealt, reach = [], 0
    for c in (own, own + 1):
        m, part, units = parts_of(c), np.zeros(len(tokens), np.int64), np.ones(len(tokens), np.int64)
        if m:
            part = (_mix(tokens ^ np.uint64(c)) % np.uint64(m)).astype(np.int64)
            for k in np.unique(combined[combined > 1]):
                of = np.flatnonzero(combined == k)
                by = of[np.argsort(part[of], kind="stable")]
                begins = np.concatenate([[0], np.flatnonzero(np.diff(part[by])) + 1])
                place = np.arange(len(by)) - np.repeat(begins, np.diff(np.append(begins, len(by))))
                units[by[place < k - 1]] = 0
        dealt.append((c, m, part))
        reach = max(reach, min(int(np.searchsorted(np.cumsum(units), need)) + 1, len(tokens)))
    alone = combined == 1
    found = [tokens[:reach][alone[:reach]]]
    for c, m, part in dealt:
        for k in np.unique(combined[:reach][~alone[:reach]]):
            of = np.flatnonzero(combined[:reach] == k)
            if not m:
                found.append(_mix(tokens[of] + np.uint64(c + 1)))
                continue
            groups: dict[int, list] = {}
            for at in of:
                groups.setdefault(int(part[at]), []).append(tokens[at])
            several = [pair for g in groups.values() if len(g) >= k for pair in itertools.combinations(sorted(g), int(k))]
            if several:
                x = np.array(several, np.uint64)
                h = np.full(len(x), (c << 2) + int(k), np.uint64)
                for column in x.T:
                    h = _mix(_mix(h ^ column) * np.uint64(0x9E3779B97F4A7C15))
                found.append(h)
    return np.unique(np.concatenate(found))


def _members(rows: DataFrame) -> DataFrame:
    """``(id, text_hash, node, key, n)``: one pass over ``(id, text_hash, text)``; key is half of node, as a number."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py()) for text in batch.column("text")]
            nodes = [set_digest(s) if len(s) else None for s in sets]
            columns = [
                batch.column("id"), batch.column("text_hash"), pa.array(nodes, pa.binary()),
                pa.array([_key(x) if x else None for x in nodes], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "node", "key", "n"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(read, f"id {kind}, text_hash long, node binary, key long, n long")


def _key(node: bytes) -> int:
    return int.from_bytes(node[:8], "little", signed=True)


def _first_counts(rows: DataFrame) -> DataFrame:
    """``(key, common)``: how many of a node's first tokens other nodes have among theirs.

    Keys that fall together only raise the counts, so that a node may stay in vain.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, tokens, keys, size = set(), [], [], 0

        def flush() -> pa.RecordBatch:
            each = np.repeat(np.array(keys, np.int64), [len(t) for t in tokens])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(each)], names=["token", "key"])

        for batch in batches:
            for text in batch.column("text"):
                own = shingle_set(text.as_py())
                if not len(own):
                    continue
                key = _key(set_digest(own))
                if key in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(key)
                tokens.append(first_tokens(own))
                keys.append(key)
                size += len(tokens[-1])
                if size >= FLUSH_ROWS:
                    yield flush()
                    tokens, keys, size = [], [], 0
        if tokens:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come in order of token and key; the last one waits for what follows it
        token, key, known = np.zeros(0, np.int64), np.zeros(0, np.int64), False
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                token = np.concatenate([token, batch.column("token").to_numpy()])
                key = np.concatenate([key, batch.column("key").to_numpy()])
            if not len(token):
                continue
            first = np.concatenate([[True], (token[1:] != token[:-1]) | (key[1:] != key[:-1])])
            token, key = token[first], key[first]
            same = token[1:] == token[:-1]
            common = np.concatenate([[known], same]) | np.concatenate([same, [False]])
            end = len(token) if batch is None else len(token) - 1
            keys, counts = np.unique(key[:end][common[:end]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts.astype(np.int64))], names=["key", "common"])
            token, key, known = token[end:], key[end:], bool(common[-1])

    dealt = rows.select("text").mapInArrow(deal, "token long, key long")
    sorted_tokens = dealt.repartition("token").sortWithinPartitions("token", "key")
    return sorted_tokens.mapInArrow(count, "key long, common long").groupBy("key").agg(F.sum("common").alias("common"))


def _sets(staying: DataFrame, rows: DataFrame, scratch: list[str]) -> DataFrame:
    """``(sid, node, n, tokens)`` of the nodes ``(node, at_id, at_hash)``: a number for each, and its whole set."""
    keys = stored(staying, "keys", scratch)
    side = F.broadcast(keys) if keys.count() <= MAX_BROADCAST_KEYS else keys
    found = rows.join(side, (F.col("text_hash") == F.col("at_hash")) & F.col("id").eqNullSafe(F.col("at_id"))).select("node", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py()).view(np.int64) for text in batch.column("text")]
            sizes = np.array([len(s) for s in sets], np.int64)
            tokens = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), np.concatenate(sets) if sets else [])
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sizes), tokens], names=["node", "n", "tokens"])

    whole = found.mapInArrow(read, "node binary, n long, tokens array<long>")
    # rows that are equal in id and text give one set
    one = whole.groupBy("node").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    return stored(one.withColumn("sid", F.monotonically_increasing_id()), "sets", scratch)


def _postings(sets: DataFrame) -> DataFrame:
    """``(entry, sid, n)``: the index entries of all sets, by the exact frequencies of their tokens."""
    each = sets.select("sid", F.explode("tokens").alias("token"))
    frequent = each.groupBy("token").agg(F.count("*").alias("f")).filter("f > 1")
    known = each.join(frequent, "token").groupBy("sid").agg(F.collect_list(F.struct("token", "f")).alias("common"))  # of one set

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, sizes = batch.column("common"), batch.column("n").to_numpy()
            values, ends = common.flatten(), np.cumsum([len(x) for x in common])
            tokens, frequency = (values.field(c).to_numpy(zero_copy_only=False) for c in ("token", "f"))
            begins = np.concatenate([[0], ends[:-1]])
            entries = [index_entries(tokens[a:b].view(np.uint64), frequency[a:b], int(n)) for a, b, n in zip(begins, ends, sizes, strict=True)]
            each = [len(e) for e in entries]
            columns = [
                np.concatenate(entries).view(np.int64) if entries else np.zeros(0, np.int64), np.repeat(batch.column("sid").to_numpy(), each), np.repeat(sizes, each),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["entry", "sid", "n"])

    return known.join(sets.select("sid", "n"), "sid").select("sid", "n", "common").mapInArrow(read, "entry long, sid long, n long")


def _sizes_fit(a: str = "a_n", b: str = "b_n") -> Column:
    return 4 * F.least(a, b) >= 3 * F.greatest(a, b)


def _least_shared(a: str = "a_n", b: str = "b_n") -> Column:
    """How many entries two sets that link share at least.

    A prefix has n // 4 + 1 units; every token that the partner lacks costs one at most, and every unit that is left is a
    shared entry. This holds for the set whose prefix ends first.
    """
    common = F.ceil(3 * (F.col(a) + F.col(b)) / 7)
    units = lambda x: F.floor(F.col(x) / 4) + 1 - (F.col(x) - common)
    return F.greatest(F.lit(1), F.least(units(a), units(b)))


def _linked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for ones, others in batches:
        yield pd.Series([linked(np.asarray(a), np.asarray(b)) for a, b in zip(ones, others, strict=True)], dtype=bool)


def _light_links(postings: DataFrame, sets: DataFrame, scratch: list[str]) -> DataFrame:
    """Links ``(a, b)`` of nodes that share an entry of at most ``LIGHT`` nodes."""
    part = lambda x: postings.select("entry", F.col("sid").alias(x), F.col("n").alias(f"{x}_n"))
    met = part("a").join(part("b"), "entry").filter((F.col("a") < F.col("b")) & _sizes_fit())
    # a pair that shares a larger entry as well may fail this and is found there
    enough = met.groupBy("a", "b", "a_n", "b_n").agg(F.count("*").alias("shared")).filter(F.col("shared") >= _least_shared())
    pairs = stored(enough.select("a", "b"), "pairs", scratch)
    tokens = lambda x: sets.select(F.col("sid").alias(x), F.col("tokens").alias(f"{x}_tokens"))
    both = pairs.join(tokens("a"), "a").join(tokens("b"), "b")
    compare = F.pandas_udf(_linked, "boolean")
    return stored(both.select("a", "b", compare("a_tokens", "b_tokens").alias("link")).filter("link").select("a", "b"), "links", scratch)


def spanning_links(ones: list[np.ndarray], others: list[np.ndarray] | None) -> list[tuple[int, int]]:
    """Links between the sets of two blocks (or within one), as many as span their components.

    Places in ``others`` follow those in ``ones``. Intersections are products of 0/1 matrices, some columns at a time.
    """
    sets = [*ones, *(others or [])]
    sizes, n_ones = np.array([len(s) for s in sets]), len(ones)
    column, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    number = np.concatenate([[0], np.cumsum(column[1:] != column[:-1])])
    in_ones = np.bincount(number[row < n_ones], minlength=number[-1] + 1)
    in_others = np.bincount(number, minlength=number[-1] + 1) - in_ones
    useful = (in_ones > 0) & (in_others > 0) if others is not None else in_ones > 1
    number, row = (np.cumsum(useful) - 1)[number[useful[number]]], row[useful[number]]
    common = np.zeros((n_ones, len(sets)), np.float32)
    for begin in range(0, int(useful.sum()), COLUMNS):
        a, b = np.searchsorted(number, [begin, begin + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[row[a:b], number[a:b] - begin] = 1
        common += held[:n_ones] @ held.T
    union = sizes[:n_ones, None] + sizes[None, :] - common
    near = np.zeros((len(sets), len(sets)), bool)
    near[:n_ones] = (common > 0) & (100 * common >= 75 * union)
    if others is not None:
        near[:n_ones, :n_ones] = False
    near |= near.T
    np.fill_diagonal(near, False)
    found, unseen = [], np.ones(len(sets), bool)
    for start in range(len(sets)):
        todo = [start] if unseen[start] else []
        unseen[start] = False
        while todo:
            at = todo.pop()
            following = np.flatnonzero(near[at] & unseen)
            unseen[following] = False
            found += [(at, int(k)) for k in following]
            todo += following.tolist()
    return found


def _block_links(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        out = []
        for ones, others in zip(left, right, strict=True):
            nodes = [*ones, *(others if others is not None else [])]
            sets = [np.asarray(x["tokens"]) for x in nodes]
            links = spanning_links(sets[: len(ones)], None if others is None else sets[len(ones) :])
            out.append([{"a": nodes[i]["sid"], "b": nodes[j]["sid"]} for i, j in links])
        yield pd.Series(out, dtype=object)


def _class_of(n: str) -> Column:
    """The size class, for the bounds in ``BOUNDS``."""
    return F.size(F.filter(F.array(*(F.lit(int(b)) for b in BOUNDS)), lambda b: b <= F.col(n)))


def _compared_blocks(pairs: DataFrame, blocks: DataFrame, scratch: list[str]) -> DataFrame:
    """Links between the nodes of the blocks in ``pairs`` ``(one, other)``; other is null where a block meets itself."""
    of = lambda name, x: blocks.select(F.col("block").alias(name), F.col("nodes").alias(x))
    both = pairs.join(of("one", "ones"), "one").join(of("other", "others"), "other", "left")
    compare = F.pandas_udf(_block_links, "array<struct<a: long, b: long>>")
    found = both.repartition("one", "other").select(F.explode(compare("ones", "others")).alias("x"))
    return stored(found.select(F.least("x.a", "x.b").alias("a"), F.greatest("x.a", "x.b").alias("b")), "links", scratch)


def _dealt(nodes: DataFrame, sets: DataFrame, by: list[str], scratch: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(sid, primary, class, component)`` dealt into blocks: ``(block, nodes)``, and the nodes with ``block``."""
    room = F.least(F.lit(BLOCK_NODES), F.greatest(F.lit(1), F.floor(BLOCK_TOKENS / F.max("n"))))
    counts = nodes.groupBy(*by).agg(F.ceil(F.count("*") / room).alias("n_blocks"))
    with_block = nodes.join(counts, by).withColumn("nth", F.pmod(F.xxhash64("sid"), F.col("n_blocks")))
    with_block = stored(with_block.withColumn("block", F.xxhash64(*by, "nth")).drop("n_blocks"), "dealt", scratch)
    filled = with_block.select("sid", "block").join(sets.select("sid", "tokens"), "sid").groupBy("block")
    return stored(filled.agg(F.collect_list(F.struct("sid", "tokens")).alias("nodes")), "blocks", scratch), with_block


def _heavy_links(postings: DataFrame, sets: DataFrame, light: DataFrame, scratch: list[str]) -> list[DataFrame]:
    """Links of nodes that share an entry of more than ``LIGHT`` nodes: ``postings`` with ``size``, the entry's nodes."""
    # the entries of a node stay together, so that joins have a row per node
    own = postings.groupBy("sid", "n").agg(F.max_by("entry", F.struct("size", "entry")).alias("primary"), F.collect_list("entry").alias("entries"))
    heavy = stored(own.withColumn("class", _class_of("n")), "heavy", scratch)
    nodes = heavy.drop("entries")
    blocks, dealt = _dealt(nodes, sets, ["primary", "class"], scratch)
    group = dealt.select("primary", "class", "nth", "block").distinct()
    least = group.groupBy("primary", "class").agg(F.min("nth").alias("nth")).join(group, ["primary", "class", "nth"])
    others = group.join(least.select("primary", "class", F.col("block").alias("one")), ["primary", "class"]).filter("block <> one")
    itself = group.select(F.col("block").alias("one"), F.lit(None).cast("long").alias("other"))
    first = _compared_blocks(itself.unionByName(others.select("one", F.col("block").alias("other"))), blocks, scratch)

    components = stored(connected_components(light.unionByName(first), scratch), "components", scratch)
    known = nodes.join(components.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    sizes = known.groupBy("primary", "component").agg(F.count("*").alias("k"))
    main = sizes.groupBy("primary").agg(F.max_by("component", F.struct("k", "component")).alias("main"))
    known = known.join(main, "primary").withColumn("inside", F.col("component") == F.col("main"))
    blocks, dealt = _dealt(known.drop("main"), sets, ["primary", "class", "inside"], scratch)
    span = dealt.groupBy("block", "class").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    met = heavy.select("sid", "entries").join(dealt.select("sid", "block"), "sid").select("block", F.explode("entries").alias("entry")).distinct().join(span, "block")
    met = stored(met, "met", scratch)
    part = lambda x: met.select("entry", *(F.col(c).alias(f"{x}_{c}") for c in ("block", "class", "low", "high")))
    pairs = part("a").join(part("b"), "entry").filter(
        (F.col("a_block") <= F.col("b_block")) & (F.abs(F.col("a_class") - F.col("b_class")) <= 1)
        & (F.least("a_low", "b_low") != F.greatest("a_high", "b_high"))
    )
    pairs = pairs.select(F.col("a_block").alias("one"), F.when(F.col("a_block") != F.col("b_block"), F.col("b_block")).alias("other")).distinct()
    return [first, _compared_blocks(pairs, blocks, scratch)]


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Membership and links.

    Membership has one row per row of ``docs``: ``id, text_hash, node, n, component``; node and component are null for
    documents without shingles. Links are ``(a, b)``, pairs of nodes that were verified and that span the components.
    """
    spark, scratch = docs.sparkSession, []
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    members = stored(_members(rows), "members", scratch)
    nodes = members.filter("n > 0").groupBy("node", "key", "n").agg(F.min(F.struct("id", "text_hash")).alias("at"))
    counts = stored(_first_counts(rows), "first-counts", scratch)
    staying = nodes.join(counts, "key").filter(F.col("common") >= least_common(F.col("n")))
    sets = _sets(staying.select("node", F.col("at.id").alias("at_id"), F.col("at.text_hash").alias("at_hash")), rows, scratch)

    entries = stored(_postings(sets), "postings", scratch)
    sizes = entries.groupBy("entry").agg(F.count("*").alias("size")).filter("size > 1")
    postings = stored(entries.join(sizes, "entry"), "shared-postings", scratch)
    light = _light_links(postings.filter(F.col("size") <= LIGHT), sets, scratch)
    found = [light, *_heavy_links(postings.filter(F.col("size") > LIGHT), sets, light, scratch)]
    links = found[0].unionByName(found[1]).unionByName(found[2])
    components = connected_components(links, scratch)

    named = lambda c: sets.select(F.col("sid").alias(c), F.col("node").alias(f"{c}_node"))
    told = components.join(named("node"), "node").join(named("component"), "component").select(F.col("node_node").alias("node"), F.col("component_node").alias("component"))
    membership = members.join(told, "node", "left").select("id", "text_hash", "node", "n", F.coalesce("component", "node").alias("component"))
    membership = stored(membership, "membership")
    links = stored(links.join(named("a"), "a").join(named("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b")), "node-links")
    discard(spark, scratch)
    return membership, links


def component_ids(membership: DataFrame) -> DataFrame:
    """``membership`` with ``component_id``: the smallest id of the component, or a document's own id without shingles."""
    # written, so that Spark can split a component with most of all rows when it joins
    least = stored(membership.filter("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("component_id")), "least")
    joined = membership.join(least, "component", "left")
    return joined.withColumn("component_id", F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id")))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id, and all without shingles."""
    membership, _ = jaccard_components(docs, id_col, text_col)
    grouped = membership.filter("component IS NOT NULL")
    first = grouped.groupBy("component").agg(
        F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("text_hash"))).alias("first")
    ).select(F.col("first.id").alias("keep_id"), F.col("first.text_hash").alias("keep_hash"))
    bare = membership.filter("component IS NULL").select(F.col("id").alias("bare_id"), F.col("text_hash").alias("bare_hash")).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = packed(docs, id=F.col(id_col), text_hash=F.xxhash64(text))
    kept = rows.join(first, (F.col("text_hash") == F.col("keep_hash")) & F.col("id").eqNullSafe(F.col("keep_id")), "left_semi")
    kept = kept.groupBy("id", "text_hash").agg(F.first("row").alias("row"))  # one of equal rows
    alone = rows.join(bare, (F.col("text_hash") == F.col("bare_hash")) & F.col("id").eqNullSafe(F.col("bare_id")), "left_semi")
    return kept.select("row.*").unionByName(alone.select("row.*"))
