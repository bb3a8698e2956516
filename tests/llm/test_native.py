"""Exact dedup, mixing and decontamination: brute force and awkward inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from paperloom.llm import decontaminate as DC
from paperloom.llm import exact_dedup as ED
from paperloom.llm import mixing as MX


def test_exact_dedup_splits_frequent_digests(documents):
    rnd = random.Random(1)
    rows = [(i, "hot") for i in range(120)] + [(200 + i, f"t{rnd.randint(0, 60)}") for i in range(150)] + [(900, None), (901, "")]
    rnd.shuffle(rows)
    df = documents(rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    keyed = df.select(F.col("doc_id").alias("id"), ED.text_digest("text").alias("digest"))
    frequent = ED.frequent_digests(keyed, 0.1).collect()
    assert [(r.n, r.keep_id, r.n_top) for r in frequent] == [(120, 119, 1)]
    got = {(r.id, r.keep_id, r.group_size, r.kept, r.digest) for r in ED.dedup_decisions(df, support=0.1).collect()}
    assert got == {
        (i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g
    }
    assert sorted(r.doc_id for r in ED.exact_dedup(df, support=0.1).collect()) == sorted(max(g) for g in groups.values())


def test_exact_dedup_awkward_rows(awkward):
    for support in (0.001, 0.3):
        decided = ED.dedup_decisions(awkward, support=support).collect()
        assert len(decided) == 8 and sum(r.kept for r in decided) == 4
        assert {(r.keep_id, r.group_size) for r in decided} == {(2, 3), (3, 1), (4, 3), (5, 1)}
        kept = ED.exact_dedup(awkward, support=support)
        assert kept.columns == awkward.columns and Counter(r.doc_id for r in kept.collect()) == Counter([2, 3, 4, 5])
    assert ED.dedup_decisions(awkward.limit(0)).count() == 0 and ED.exact_dedup(awkward.limit(0)).count() == 0


def test_exact_dedup_keeps_clashing_columns(documents):
    df = documents([(1, "a"), (2, "a")]).withColumn("digest", F.lit("mine")).withColumn("keep_id", F.lit(7)).withColumn("row", F.lit(1))
    assert [(r.doc_id, r.digest, r.keep_id, r.row) for r in ED.exact_dedup(df).collect()] == [(2, "mine", 7, 1)]


def _mixed(spark, n=4000):
    rows = [(i, "x" * (1 + i % 7), "en", "hot" if i % 3 == 0 else f"s{i % 11}" if i % 11 else None, 0) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_mixture_reaches_target_weights(spark):
    df = _mixed(spark)
    weights = {"hot": 0.2, "s1": 0.8}
    rates = {r.source: r for r in MX.source_rates(df, weights=weights).collect()}
    total = sum(r["size"] for r in rates.values())
    assert abs(rates["hot"].rate * rates["hot"]["size"] / total - 0.2) < 1e-9 and rates["s2"].rate == rates[None].rate == 0
    out = MX.mix_sources(df, weights=weights).select("row.*", "copy", "n_copies", "shuffle_key").collect()
    size = Counter()
    for r in out:
        size[r.source] += len(r.text)
    assert set(size) == {"hot", "s1"} and abs(size["hot"] / total - 0.2) < 0.02 and abs(size["s1"] / total - 0.8) < 0.08
    by_id = defaultdict(list)
    for r in out:
        by_id[r.doc_id].append((r.copy, r.n_copies))
    assert all(sorted(v) == [(k + 1, len(v)) for k in range(len(v))] for v in by_id.values())
    again = MX.mix_sources(df.repartition(5), weights=weights).select("row.doc_id", "copy").collect()
    assert Counter((r.doc_id, r.copy) for r in again) == Counter((r.doc_id, r.copy) for r in out)


def test_large_rates_are_sums_of_pieces(spark):
    df = spark.createDataFrame([(1, "a", "few"), *((i, "a", "many") for i in range(2, 3002))], "doc_id long, text string, source string")
    out = MX.mix_sources(df, weights={"few": 1.0}).select("row.doc_id", "copy").collect()
    assert {r.doc_id for r in out} == {1} and 2700 < len(out) < 3300
    without_broadcast = MX.MAX_BROADCAST_SOURCES
    MX.MAX_BROADCAST_SOURCES = 0
    try:
        assert MX.mix_sources(df, weights={"few": 1.0}).count() == len(out)
    finally:
        MX.MAX_BROADCAST_SOURCES = without_broadcast


def test_mixing_awkward_rows(awkward):
    df = awkward.withColumn("copy", F.lit("mine")).withColumn("src", F.lit("mine"))
    out = MX.mix_sources(df, epochs=3.0).select("row.*").collect()
    assert out and all(r.copy == r.src == "mine" for r in out)
    assert MX.mix_sources(df.limit(0)).count() == 0


def _words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def _brute_hits(docs, items):
    out = {}
    windows = defaultdict(set)
    for item, text in items:
        w = _words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(item))
    for i, text in docs:
        w, hit, found = _words(text), set(), set()
        for n in {len(g) for g in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k + 1, k + n + 1))
                    found |= own
        out[i] = (len(w), sorted(hit), sorted(found))
    return out


def test_hits_against_brute_force(spark, documents):
    rnd = random.Random(3)
    vocabulary = ["The", "a", "é1", "Ünd", "x", "y9", "of"]
    text = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocabulary) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate([12, 10, 9, 3, 15, 0, 11])] + [(10, None), (11, "?!")]
    docs = [(i, text(rnd.randint(0, 40))) for i in range(40)]
    docs += [(100 + k, f"{text(5)} {t} {text(5)}") for k, t in items if t] + [(200, None), (201, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bound in (DC.MAX_BROADCAST_WINDOWS, 0):
        got = DC.benchmark_hits(documents(docs), bench, max_broadcast=bound).collect()
        assert {r.id: (r.n_words, sorted(r.hit), list(r["items"])) for r in got} == _brute_hits(docs, items)
    kept = {r.doc_id for r in DC.decontaminate(documents(docs), bench).collect()}
    assert kept == {i for i, (_, hit, _) in _brute_hits(docs, items).items() if not hit}


def test_spans_are_removed_from_the_original_text(spark, documents):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    df = documents([(1, "Before, ONE two (Three) after."), (2, "Nothing here"), (3, "one two three"), (4, None), (5, "")]).withColumn("hit", F.lit(1))
    out = {r.doc_id: (r.text, r.hit) for r in DC.decontaminate(df, bench, remove="spans").collect()}
    assert out == {1: ("Before, after.", 1), 2: ("Nothing here", 1), 3: ("", 1), 4: (None, 1), 5: ("", 1)}


def test_decontamination_awkward_rows(spark, awkward):
    bench = spark.createDataFrame([(None, "b c"), (1, None)], "item_id long, text string")
    hits = {(r.id, r.n_rows, r.n_words, len(r.hit), tuple(r["items"])) for r in DC.benchmark_hits(awkward, bench).collect()}
    assert (4, 2, 3, 2, ()) in hits and (None, 1, 3, 2, ()) in hits and (3, 1, 30_000, 0, ()) in hits
    assert DC.decontaminate(awkward, bench).count() == 5
    assert DC.decontaminate(awkward, bench.limit(0)).count() == 8 and DC.decontaminate(awkward.limit(0), bench).count() == 0
