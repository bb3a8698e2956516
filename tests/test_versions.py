"""Generations of a corpus, comparison from digests, streams of changing documents."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import audit as AU
from paperloom.sources import versions as V
from paperloom.streaming import ingest as ST

TEXT = "# T{k}\n\nBody {k}\n\n- item\n\n| a | b |\n|---|---|\n| {k} | 2 |\n"


def _corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture
def rows():
    return {k: TEXT.format(k=k) for k in range(40)} | {100: "", 101: None}


def _changed(rows):
    after = {k: v for k, v in rows.items() if k % 9 != 4}
    return after | {3: "# other\n\ntext\n", 7: rows[7].replace("| a | b |", "| a | b  |"), 500: "new\n"}


def test_update_equals_a_full_run(spark, tmp_path, rows):
    root, after = str(tmp_path / "corpus"), _changed(rows)
    first = V.update_document_tables(_corpus(spark, list(rows.items())), root)
    assert first == {"generation": 1, "parsed": 42, "removed": 0, "buckets": first["buckets"]}
    assert V.update_document_tables(_corpus(spark, list(rows.items())), root) == {"generation": 1, "parsed": 0, "removed": 0, "buckets": 0}
    second = V.update_document_tables(_corpus(spark, list(after.items())), root)
    assert (second["generation"], second["parsed"], second["removed"]) == (2, 3, len(rows) - len(after) + 1)
    parsed = spark.read.parquet(f"{root}/parsed/gen=2").select("doc_id").distinct()
    assert {r.doc_id for r in parsed.collect()} == {3, 7, 500}  # nothing else was parsed again
    whole = V.parsed_tables(_corpus(spark, list(after.items())), str(tmp_path / "whole"))
    for name, expected in whole.items():
        stored = V.read_relation(spark, root, name)
        assert sorted(map(str, stored.select(*expected.columns).collect())) == sorted(map(str, expected.collect())), name
    before = V.read_relation(spark, root, V.TEXTS, 1)
    assert {(r.doc_id, r.text) for r in before.collect()} == set(rows.items())  # the former generation can still be read


def test_a_run_that_breaks_off_changes_nothing(spark, tmp_path, rows):
    root = str(tmp_path / "corpus")
    V.update_document_tables(_corpus(spark, list(rows.items())), root, V.no_tables)

    def fails(corpus, folder):
        return {"broken": corpus.select("doc_id", F.raise_error(F.lit("stop")).alias("x"))}

    after = _corpus(spark, list(_changed(rows).items()))
    with pytest.raises(Exception, match="stop"):
        V.update_document_tables(after, root, fails)
    assert V.generation(spark, root) == 1
    assert {(r.doc_id, r.text) for r in V.read_relation(spark, root, V.TEXTS).collect()} == set(rows.items())
    assert V.update_document_tables(after, root, V.no_tables)["generation"] == 2
    assert {(r.doc_id, r.text) for r in V.read_relation(spark, root, V.TEXTS).collect()} == set(_changed(rows).items())


def test_audit_from_digests_equals_the_whole_audit(spark, tmp_path, rows, monkeypatch):
    root, after = str(tmp_path / "corpus"), _changed(rows)
    for version in (rows, after):
        V.update_document_tables(_corpus(spark, list(version.items())), root, V.no_tables)
    whole = AU.audit_status(AU.pair_versions(_corpus(spark, list(rows.items())), _corpus(spark, list(after.items()))))
    expected = {(r.doc_id, r.status) for r in whole.collect()}
    assert {(r.doc_id, r.status) for r in V.audit_incremental(spark, root, 1, 2).collect()} == expected
    assert {r.status for r in V.audit_incremental(spark, root, 2, 2).collect()} == {"PASS"}
    monkeypatch.setattr(V, "MAX_BROADCAST_IDS", 0)
    assert {(r.doc_id, r.status) for r in V.audit_incremental(spark, root, 1, 2).collect()} == expected


def test_changed_documents(spark, rows):
    digests = [V.document_digests(_corpus(spark, list(x.items()))) for x in (rows, _changed(rows))]
    got = {r.doc_id: (r.was is None, r.now is None) for r in V.changed_documents(*digests).collect()}
    gone = {k: (False, True) for k in rows if k % 9 == 4 and k < 100}
    assert got == gone | {3: (False, False), 7: (False, False), 500: (True, False)} | ({100: (False, True)} if 100 % 9 == 4 else {}) | (
        {101: (False, True)} if 101 % 9 == 4 else {}
    )


def test_counts_follow_changed_documents(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("source", "target", "state"))

    def deliver(*rows):
        spark.createDataFrame(rows, "doc_id long, version long, text string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, version long, text string").parquet(source)
        ST.follow_counts(stream, target, checkpoint).awaitTermination()
        got = ST.current_counts(spark.read.parquet(target)).collect()
        return {(r.doc_id, r.type): r.n for r in got}

    two, one = "intro\n\n## H\n\na\n", "a\n"
    assert deliver((1, 1, two), (2, 1, one), (2, 1, one), (None, 1, two), (3, None, two)) == {(1, "HEADING_2"): 1, (1, "PARAGRAPH"): 2, (2, "PARAGRAPH"): 1}
    assert deliver((1, 1, two), (2, 2, two)) == {(1, "HEADING_2"): 1, (1, "PARAGRAPH"): 2, (2, "HEADING_2"): 1, (2, "PARAGRAPH"): 2}
    assert deliver((2, 1, one), (1, 3, one), (1, 2, two), (4, 1, None)) == {(1, "PARAGRAPH"): 1, (2, "HEADING_2"): 1, (2, "PARAGRAPH"): 2}
    assert deliver((1, 4, None)) == {(2, "HEADING_2"): 1, (2, "PARAGRAPH"): 2}


def test_counts_leave_no_row_for_what_came_before(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("source", "target", "state"))
    for rows in ([(1, 2, "b\n\n# a\n"), (2, 1, "c\n")], [(1, 2, "b\n\n# a\n"), (1, 1, "old\n"), (2, 1, "c\n")], [(2, 2, "- d\n")]):
        spark.createDataFrame(rows, "doc_id long, version long, text string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, version long, text string").parquet(source)
        query = ST.follow_counts(stream, target, checkpoint)
        query.awaitTermination()
        assert query.lastProgress.stateOperators[0].numRowsTotal == 2  # one small row per document, kept by Spark's own state
    got = {(r.doc_id, r.version): r.counts for r in spark.read.parquet(target).collect()}
    assert got == {(1, 2): {"HEADING_1": 1, "PARAGRAPH": 1}, (2, 1): {"PARAGRAPH": 1}, (2, 2): {"BULLET_LIST": 1}}


@pytest.mark.parametrize("relation", sorted(ST.RELATIONS))
def test_every_relation_can_be_ingested(spark, tmp_path, rows, relation):
    source = str(tmp_path / "source")
    corpus = _corpus(spark, [(k, v) for k, v in rows.items() if v])
    corpus.write.parquet(source)
    stream = spark.readStream.schema("doc_id long, text string").parquet(source)
    ST.ingest(stream, relation, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    expected = ST.RELATIONS[relation](corpus)
    got = spark.read.schema(expected.schema).parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
