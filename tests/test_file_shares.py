"""Files are written by many tasks."""

import glob

import __spark_entry__ as entry
from paperloom.plans import stream_queries as SQ


def test_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SQ, "scratch", lambda s, name: f"{tmp_path}/{name}")
    assert entry.queries()["read_corpus_files"](spark, "/root/testdata/sf0.01").count() == 100
    files = [f.rsplit("/", 1)[1] for f in glob.glob(f"{tmp_path}/files/part-*")]
    assert len(files) == 100 and len({f.split("-")[1] for f in files}) > 4
