"""The pipeline against brute force, stage by stage, and the queries against their SQL."""

import re
from collections import defaultdict

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as CP
from paperloom.llm import load_queries
from paperloom.llm.common import stored, table

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load_queries()


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, base, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = base.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    expected = sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == expected


def test_registry():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries() and set(QUERIES) <= set(entry.queries())
    assert [n for n, _ in CP.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "decontaminate", "mix_sources"]


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def _near(rows):
    """The ids that stay: the smallest of every component."""
    sets = {i: _shingles(t) for i, t in rows.items()}
    where = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            where[x].add(i)
    group = {i: {i} for i in rows}
    for i, s in sets.items():
        for j in {j for x in s for j in where[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * len(s | sets[j]) and group[i] is not group[j]:
                group[i] |= group[j]
                for k in group[j]:
                    group[k] = group[i]
    return {min(g) for g in group.values()}


def _contaminated(text, windows):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))


def test_stages_against_brute_force(spark, tmp_path):
    docs, sizes = table(spark, SF, "documents"), {}
    columns = docs.columns
    for name, stage in CP.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = stored(stage(spark, docs, SF), name)
        rows = docs.collect()
        kept = {r.doc_id for r in rows}
        if name != "mix_sources":
            assert docs.columns == columns and len(rows) == len(kept) and kept <= set(before)
            assert {r.doc_id: r.text for r in rows} == {i: before[i] for i in kept}
        if name == "exact_dedup":
            last = {t or "": i for i, t in sorted(before.items())}
            assert kept == set(last.values())
        elif name == "ngram_jaccard":
            assert kept == _near(before)
        elif name == "decontaminate":
            windows = set()
            for r in table(spark, SF, "benchmark").collect():
                w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
                n = min(10, len(w))
                windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1 if n else 0)}
            assert kept == {i for i, t in before.items() if not _contaminated(t, windows)}
        elif name == "mix_sources":
            assert all(1 <= r.copy <= r.n_copies for r in rows) and kept <= set(before) and len(rows) > len(before) / 2
        sizes[name] = (len(before), len(kept))
    assert all(b >= k for b, k in sizes.values()) and sizes["exact_dedup"][0] > sizes["exact_dedup"][1]


def test_pipeline_of_awkward_tables(spark, tmp_path):
    """Null, empty and repeated texts, ids and labels, no benchmark, further columns with clashing names; then no rows."""
    rows = [(1, None), (2, ""), (3, "some words stand here now"), (3, "some words stand here now"), (None, "other words"), (None, None)]
    df = spark.createDataFrame([(i, t, "en", None, 0, 1, "x", "y") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, copy int, node string, row string")
    for name, data in (("full", df), ("empty", df.limit(0))):
        base = str(tmp_path / name)
        data.write.parquet(f"{base}/documents.parquet")
        spark.createDataFrame([(1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
        docs = table(spark, base, "documents")
        for _, stage in CP.STAGES[:-1]:
            docs = stored(stage(spark, docs, base), "stage")
            assert docs.columns == data.columns
        assert docs.count() == (3 if name == "full" else 0)  # the last empty text, the repeated text once, and the rest
        mixed = CP.STAGES[-1][1](spark, docs, base)
        assert mixed.columns == [*data.columns, "copy_", "n_copies", "shuffle_key"]
        stored(mixed, "mixed").count()
