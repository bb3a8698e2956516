"""The prefix trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from paperloom.llm import prefix_trie as PT
from paperloom.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def _ordered(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), role.encode(), digest, role, text))
    return {c: [x[3:] for x in sorted(v)] for c, v in own.items()}


def brute_trie(paths):
    members = defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, below = defaultdict(int), defaultdict(lambda: [0, 0])
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, own in members.items():
        for d in range(len(path) + 1):
            below[path[:d]][0] += path not in children
            below[path[:d]][1] += (len(own) - 1) * len(path[-1][1].encode()) if path else 0
    out = []
    for path, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(paths[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(own), len(path), parent, len(own), children.get(path, 0), *below[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt(rows):
    own = _ordered(rows)
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def _random_rows(rnd, n_convs, longest):
    rows = []
    for c in rnd.sample(range(-40, 4 * n_convs), n_convs):
        for t in range(rnd.choice([1, 2, 5, 9, longest])):
            rows.append((c, rnd.choice([t, t, None]), rnd.choice(["user", "assistant", None]), rnd.choice(["é", "b", "", None, "long text"])))
    rnd.shuffle(rows)
    return rows


def _run(spark, tmp_path, rows, name="t"):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key_a", F.lit("mine")).withColumn("nth", F.lit("mine"))
    df.repartition(4).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
    return sorted((tuple(r) for r in QUERIES["op11_prefix_trie"](spark, f"{tmp_path}/{name}").collect()), key=str)


def test_query_against_brute_force(spark, tmp_path):
    rows = _random_rows(random.Random(4), 150, 30)
    assert _run(spark, tmp_path, rows) == brute_trie(rebuilt(rows))


def test_one_conversation_with_most_turns_and_many_copies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(PT, "PIECE", 7)
    rnd = random.Random(8)
    rows = [(1000, t, "user", rnd.choice("ab")) for t in range(1200)] + [(1003, t, "user", "a") for t in range(500)]
    rows += [(c, t, "user", f"same {t}") for c in range(-100, 300) for t in range(3)]
    rows += [(c, t, "user", f"same {t}") for c in range(400, 700, 5) for t in range(17)] + [(None, 0, "user", "left out")]
    assert _run(spark, tmp_path, rows) == brute_trie(rebuilt(rows))


def test_trie_of_plain_conversations(spark):
    rows = _random_rows(random.Random(6), 60, 20)
    df = spark.createDataFrame(rows, SCHEMA)
    turns = PT.numbered_turns(df)
    nodes = PT.prefix_trie(turns.select("conv_id").distinct(), turns)
    assert sorted((tuple(r) for r in nodes.collect()), key=str) == brute_trie(_ordered(rows))


def test_awkward_tables(spark, tmp_path):
    assert _run(spark, tmp_path, [], "empty") == []
    only_null = [(None, 1, "user", "x"), (None, None, None, None)]
    assert _run(spark, tmp_path, only_null, "null") == []
    # conversation 6 has no turn of its own beyond its first h, and conversation 5 doesn't exist: it is turnless
    c = next(c for c in range(6, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 3)
    rows = [(c, None, None, None), (c, None, None, None), (c, 3, "user", "x" * 100_000)]
    assert _run(spark, tmp_path, rows, "turnless") == brute_trie(rebuilt(rows)) and len(brute_trie(rebuilt(rows))) == 1
    repeated = [(5, 1, "user", "x")] * 4 + [(6, 1, "user", "x")] * 4 + [(5, 2, None, "t" * 300_000)]
    assert _run(spark, tmp_path, repeated, "repeated") == brute_trie(rebuilt(repeated))
