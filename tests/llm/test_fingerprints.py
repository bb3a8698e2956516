"""SimHash fingerprints and their search against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paperloom.llm import fingerprints as FP
from paperloom.llm.ordering import in_order, numbered, with_next
from paperloom.llm.queries import QUERIES


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    terms = [" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
    votes, total = [0] * 128, sum(map(len, terms))
    for term in terms:
        digest = hashlib.md5(term.encode()).hexdigest()
        for bit in range(128):
            votes[bit] += len(term) * (int(digest[bit // 32 * 8 : bit // 32 * 8 + 8], 16) >> bit % 32 & 1)
    return "".join(f"{sum(1 << k for k in range(32) if 2 * votes[32 * p + k] > total):08x}" for p in range(4))


def bits(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def brute_rows(rows):
    """The query's first seven columns for distinct ids."""
    order = sorted({(i is None, -(i or 0), i, t or "") for i, t in rows})
    order = [(i, t) for _, _, i, t in order]
    out = []
    for k, (i, t) in enumerate(order):
        following, third = order[(k + 1) % len(order)][1], len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        prints = [brute_fingerprint(x) for x in (t, edited, following)]
        near = [round(max(0.0, math.cos(math.pi / 128 * bits(prints[0], p))), 6) for p in prints[1:]]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), prints[0], prints[1], *near))
    return out


def _texts(rnd, n):
    vocabulary = [f"{a}{b}" for a, b in itertools.product(["Wö", "la", "ten", "I", "x\U0001f600"], range(30))]
    for _ in range(n):
        yield " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 2, 3, 12, 80]))) + rnd.choice(["", "\n", "  "])


def test_query_against_brute_force(tmp_path, spark, documents):
    rnd = random.Random(2)
    texts = list(_texts(rnd, 120))
    rows = [(7 * k - 50, t) for k, t in enumerate(texts)] + [(5000 + k, texts[k % 9]) for k in range(30)] + [(9000, None)]
    documents(rows).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_fingerprints"](spark, str(tmp_path)).collect()
    expected = brute_rows(rows)
    assert sorted(tuple(r)[:7] for r in got) == sorted(expected)
    every = [(r[0], r[3]) for r in expected]
    for r in got:
        near = Counter(bits(r.fingerprint, other) for _, other in every)
        wanted = (sum(n for d, n in near.items() if d <= FP.RADIUS), near[0]) if r.doc_id % 50 == 0 else (None, None)
        assert (r.n_near, r.n_equal) == wanted


def test_likeness_tells_edited_texts_from_others(spark):
    rows = QUERIES["op12_fingerprints"](spark, "/root/testdata/sf0.001").filter("n_chars > 1500").collect()
    assert sum(r.near_edited for r in rows) / len(rows) > 0.55
    assert sum(r.near_edited > r.near_next for r in rows) > 0.95 * len(rows)


@pytest.mark.parametrize(("radius", "blocks"), [(0, 1), (3, 5), (6, 8), (9, 10)])
def test_search_finds_all_within_the_radius(spark, radius, blocks):
    rnd = random.Random(radius)
    stems = [rnd.getrandbits(128) for _ in range(12)]
    prints = set()
    for _ in range(300):
        x = rnd.choice(stems)
        for b in rnd.sample(range(128), rnd.randint(0, 7)):
            x ^= 1 << b
        prints.add(f"{x:032x}")
    prints |= {"0" * 32, "f" * 32}
    index = spark.createDataFrame([(p,) for p in sorted(prints)], "fingerprint string").repartition(3)
    asked = index.sample(0.4, seed=1)
    got = Counter((r.fingerprint, r.near, r.bits) for r in FP.near_fingerprints(asked.unionByName(asked), index, radius, blocks).collect())
    wanted = {(r.fingerprint, p, bits(r.fingerprint, p)) for r in asked.collect() for p in prints if bits(r.fingerprint, p) <= radius}
    assert set(got) == wanted and set(got.values()) <= {1}  # each pair once, though it meets in many tables


def test_search_rejects_too_few_blocks(spark):
    with pytest.raises(ValueError, match="blocks"):
        FP.block_tables(spark.createDataFrame([("0" * 32,)], "fingerprint string"), 6, 6)


def test_awkward_rows(tmp_path, spark, awkward):
    awkward.withColumn("k1", F.lit("mine")).withColumn("kind", F.lit("mine")).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_fingerprints"](spark, str(tmp_path)).collect()
    assert len(got) == 8 and {r.fingerprint for r in got if r.n_chars < 4} == {"0" * 32}
    long = next(r for r in got if r.n_chars == 150_000)
    assert long.fingerprint == brute_fingerprint("word " * 3) and long.near_edited == 1.0
    copies = [tuple(r) for r in got if r.doc_id == 4]
    assert len(copies) == 2 and len(set(copies)) == 1
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op12_fingerprints"](spark, f"{tmp_path}/none").count() == 0
    awkward.filter("doc_id = 1").write.parquet(f"{tmp_path}/one/documents.parquet")
    assert [r.near_next for r in QUERIES["op12_fingerprints"](spark, f"{tmp_path}/one").collect()] == [1.0]


def test_order_over_parts(spark):
    rows = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 WHEN id % 7 = 0 THEN null ELSE id % 11 END AS key").repartition(7)
    placed = in_order(rows, F.col("key").asc_nulls_first(), F.col("id").desc())
    got = placed.orderBy("at").collect()
    assert [(r.key, r.id) for r in got] == sorted(((r.key, r.id) for r in got), key=lambda x: (x[0] is not None, x[0] or 0, -x[1]))
    nth, seen = {r.id: r.nth for r in numbered(placed, "key").collect()}, Counter()
    for r in got:
        seen[r.key] += 1
        assert nth[r.id] == seen[r.key]
    follows = {r.at: r.next_at for r in with_next(placed).collect()}
    assert follows == dict(zip([r.at for r in got], [r.at for r in [*got[1:], got[0]]], strict=True))
