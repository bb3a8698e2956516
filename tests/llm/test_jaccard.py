"""The Jaccard join against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import jaccard as JC
from paperloom.llm.components import connected_components


def _shingles(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def _brute(rows):
    sets = [(_shingles(t)) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            parent[root(b)] = root(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return {i: (len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows)}


def _corpus(seed, n_groups=12, copies=9):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("klmnop") + str(rnd.randint(0, 40))
    common = " ".join(word() for _ in range(60))
    texts = [None, "", " \n", "A b", "a  B", "one", "a b c d e", "A B C D E f"]
    for _ in range(n_groups):
        base = [word() for _ in range(rnd.choice([6, 12, 40, 120]))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rnd.randint(0, 1 + len(base) // 12)):
                own[rnd.randrange(len(own))] = word()
            texts.append(" ".join(own) + (f" {common}" if rnd.random() < 0.5 else ""))
    texts += [f"{' '.join(word() for _ in range(8))} {common}" for _ in range(15)] + [common] * 5
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("settings", [
    {}, {"CLASS_FROM": (2, 5), "LIGHT": 5}, {"CLASS_FROM": (1, 1), "LIGHT": 1, "BLOCK_NODES": 6, "COLUMNS": 64}, {"LIGHT": 0, "BLOCK_NODES": 1},
])
def test_components_against_brute_force(documents, monkeypatch, settings):
    for name, value in settings.items():  # more tokens in combinations, more entries compared in blocks, smaller blocks
        monkeypatch.setattr(JC, name, value)
    rows = _corpus(7)
    membership, links = JC.jaccard_components(documents(rows).repartition(5))
    got = {r.id: (r.n, r.component_id) for r in JC.component_ids(membership).collect()}
    assert got == _brute(rows)
    assert links.filter("a = b").count() == 0


def _random_sets(rnd, random_np):
    base = np.unique(random_np.integers(0, 2**64, rnd.choice([1, 2, 3, 5, 8, 11, 15, 20, 48, 150]), dtype=np.uint64))
    sets = [base]
    for _ in range(8):
        own = base[np.sort(random_np.permutation(len(base))[rnd.randint(0, len(base) // 3) :])]
        more = random_np.integers(0, 2**64, rnd.randint(0, len(base) // 3), dtype=np.uint64)
        sets.append(np.unique(np.concatenate([own, more])))
    return [s for s in sets if len(s)]


def test_every_link_shares_an_entry(monkeypatch):
    rnd, random_np = random.Random(5), np.random.default_rng(5)
    for _ in range(200):
        monkeypatch.setattr(JC, "CLASS_FROM", rnd.choice([(64, 2048), (2, 3), (1,), (1, 1, 1), (4, 6)]))
        sets = _random_sets(rnd, random_np)
        values, counts = np.unique(np.concatenate(sets), return_counts=True)
        entries = []
        for s in sets:
            f = counts[np.searchsorted(values, s)]
            entries.append(set(JC.index_entries(s[f > 1], f[f > 1], len(s)).tolist()))
        for (a, e), (b, f) in itertools.combinations(zip(sets, entries, strict=True), 2):
            assert e & f or np.array_equal(a, b) or not JC.linked(a, b)


def test_first_counts_keep_every_node_with_a_partner(spark):
    rnd, random_np = random.Random(6), np.random.default_rng(6)
    least = {n: spark.range(1).select(JC.least_common(F.lit(n))).first()[0] for n in range(1, 240)}
    for _ in range(200):
        for a, b in itertools.combinations(_random_sets(rnd, random_np), 2):
            if JC.linked(a, b):
                common = len(np.intersect1d(JC.first_tokens(a), JC.first_tokens(b)))
                assert common >= least[len(a)] and common >= least[len(b)]


def test_links_of_blocks_span_their_components(monkeypatch):
    monkeypatch.setattr(JC, "COLUMNS", 32)
    rnd, random_np = random.Random(7), np.random.default_rng(7)

    def components(n, links):
        root = list(range(n))
        for i, j in links:
            a, b = root[i], root[j]
            root = [a if x == b else x for x in root]
        return [root.index(x) for x in root]

    for _ in range(60):
        sets = [s for _ in range(3) for s in _random_sets(rnd, random_np)]
        cut = rnd.randint(1, len(sets))
        for others in (None, sets[cut:]) if sets[cut:] else (None,):
            used = sets if others is None else sets
            ones = sets if others is None else sets[:cut]
            wanted = [
                (i, j) for i, j in itertools.combinations(range(len(used)), 2)
                if JC.linked(used[i], used[j]) and (others is None or (i < cut <= j))
            ]
            got = JC.spanning_links(ones, others)
            assert {tuple(sorted(x)) for x in got} <= set(wanted)
            assert components(len(used), got) == components(len(used), wanted)


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (50, 60)], "a long, b long")
    got = {r.node: r.component for r in connected_components(chain).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 60: 50}


def test_near_dedup_awkward_rows(awkward):
    df = awkward.withColumn("node", F.lit(1)).withColumn("component", F.lit("mine"))
    kept = JC.near_dedup(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id if r.doc_id is not None else -1 for r in kept.collect()))
    assert got == [-1, 1, 2, 3, 4, 5]  # all without words, the long text, and one of the four "a b c"
    assert JC.near_dedup(df.limit(0)).count() == 0
    membership, _ = JC.jaccard_components(df.filter("doc_id < 3"))
    assert {(r.id, r.n, r.component_id) for r in JC.component_ids(membership).collect()} == {(1, 0, 1), (2, 0, 2)}


def test_intermediate_tables_are_deleted(documents, tmp_path, monkeypatch):
    monkeypatch.setattr("paperloom.llm.common.shared_dir", lambda spark: f"file://{tmp_path}")
    df = documents(_corpus(3))
    membership, links = JC.jaccard_components(df)
    assert membership.count() == df.count() and links.count() > 0
    assert {p.name[:-33] for p in tmp_path.iterdir() if p.is_dir()} == {"membership", "node-links"}
