import pytest
from pyspark.sql import functions as F

from paperloom.operators import structure as S
from paperloom.sources import readers as RD
from paperloom.sources import routing as RT
from paperloom.sources import writers as WR
from paperloom.streaming import ingest as ST


@pytest.fixture
def folder(tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "b.md").write_bytes("# 제목\n\n본문".encode("cp949"))
    (src / "a.md").write_bytes(b"\xef\xbb\xbf" + "# A\n\n| h | v |\n|---|---|\n| x | 1 |".encode())
    (src / "c.txt").write_text("not read")
    return src


def test_files_are_decoded(spark, folder):
    with pytest.raises(ValueError, match="korean_session"):
        RD.decode_text(RD.read_corpus_files(spark, str(folder)))
    own = RD.korean_session(spark)
    rows = RD.decode_text(RD.read_corpus_files(own, str(folder)))
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == "false"
    assert sorted((r.text.split("\n")[0], r.error) for r in rows.collect()) == [("# A", None), ("# 제목", None)]
    with pytest.raises(FileNotFoundError):
        RD.read_corpus_files(spark, str(folder), "*.docx")


def test_undecodable_is_kept_with_a_reason(spark):
    spark = RD.korean_session(spark)
    df = spark.createDataFrame([(1, bytearray(b"\xff\xff")), (2, bytearray(b"ok"))], "doc_id long, bytes binary")
    out = RD.decode_text(df)
    assert {r.doc_id: r.error for r in out.collect()} == {1: "undecodable", 2: None}
    assert {r.status: r.documents for r in RD.batch_outcome(out).collect()} == {"failed": 1, "succeeded": 1}


def test_detect_format(spark):
    spark = RD.korean_session(spark)
    rows = [(1, b"x", ".docx"), (2, b"PK\x03\x04zz", None), (3, b"# hi", "bin"), (4, b"", None), (5, b"\x00\x01\x02abc", None),
            (6, "한글".encode("cp949"), None), (7, b"PK\x03\x04", "MD"), (8, ("a" + "글" * 3000).encode(), None)]
    df = spark.createDataFrame([(i, bytearray(b), h) for i, b, h in rows], "doc_id long, bytes binary, hint string")
    found = {r.doc_id: r.format for r in RD.detect_format(df).collect()}
    assert found == {1: "docx", 2: "docx", 3: "md", 4: "unknown", 5: "unknown", 6: "md", 7: "md", 8: "md"}


def test_registry_order_and_strictness(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, kind string")
    reg = RT.TransformRegistry()
    reg.register("late", F.lit(True) & (F.col("kind") != "c"), lambda d: d.withColumn("v", F.lit(1)), 200)
    reg.register("first", F.col("kind") == "a", lambda d: d)
    reg.register("second", F.col("kind") == "a", lambda d: d)
    assert reg.names == ["first", "second", "late"]
    assert {r.doc_id: r.branch for r in reg.route(df).collect()} == {1: "first", 2: "late", 3: None}
    out = {r.doc_id: (r.branch, r.error) for r in reg.convert(df, "quarantine").collect()}
    assert out == {1: ("first", None), 2: ("late", None), 3: (None, RT.UNROUTED)}
    with pytest.raises(Exception, match="no branch accepts"):
        reg.convert(df).collect()
    assert reg.convert(df.filter("doc_id < 3")).count() == 2


def test_sinks_read_back(spark, corpus, tmp_path):
    c = corpus("# A\n\n**b** c", "x\n\n| h |\n|---|\n| 1 |")
    WR.write_document_tables(c, str(tmp_path / "tables"), "demo")
    back = spark.read.parquet(str(tmp_path / "tables" / "blocks"))
    assert back.filter("corpus = 'demo'").count() == S.blocks(c).count()
    md = c.withColumnRenamed("text", "markdown")
    path = WR.write_markdown_corpus(md, str(tmp_path / "md"), "r1")
    assert {(r.doc_id, r.markdown) for r in spark.read.parquet(path).collect()} == {(r.doc_id, r.text) for r in c.collect()}
    with pytest.raises(Exception, match="(?i)exist"):
        WR.write_markdown_corpus(md, str(tmp_path / "md"), "r1")


def test_stream_equals_batch_and_runs_once(spark, folder, tmp_path):
    spark = RD.korean_session(spark)
    target, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        ST.ingest(ST.stream_files(spark, str(folder)), "table_cells", target, state).awaitTermination()
        return spark.read.parquet(target).count()

    assert run() == 4
    assert run() == 4
    (folder / "d.md").write_text("| h |\n|---|\n| 1 |\n| 2 |")
    assert run() == 7


def test_convert_once_reads_the_source_once(spark, tmp_path):
    import collections

    from pyspark.sql import functions as F

    from paperloom.sources.routing import TransformRegistry

    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def costly(n):
        seen.add(1)
        return n % 3 == 0

    rows = spark.range(60).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    reg = TransformRegistry()
    reg.register("a/b c", costly("doc_id"), lambda d: d.withColumn("text", F.lit("third")), priority=1)
    reg.register("even", F.col("doc_id") % 2 == 0, lambda d: d.filter("doc_id > 10"))
    got = reg.convert_once(rows, str(tmp_path / "parts"), "quarantine")
    assert seen.value == 60
    assert collections.Counter(r.branch for r in got.collect()) == collections.Counter(r.branch for r in reg.convert(rows, "quarantine").collect())
    assert sorted(map(str, got.collect())) == sorted(map(str, reg.convert(rows, "quarantine").select(*got.columns).collect()))
    assert "Range" not in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="no branch"):
        reg.convert_once(rows, str(tmp_path / "error"))


def test_failed_blocks_leave_a_marker(spark):
    from pyspark.sql import functions as F

    from paperloom.operators import render as R
    from paperloom.operators import structure as S

    texts = {1: "## A\n\n$$x_{1$$\n\nend", 2: "## A\n\n$$x_{1}$$", 3: "![p](data:image/png;base64,QUJDR)", 4: ""}
    spans = S.segment_blocks(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    rendered = R.render_outcome(spans)
    counts = {r.doc_id: (r.rendered, r.failed, r.status) for r in R.outcome_counts(rendered).collect()}
    assert counts == {1: (2, 1, "incomplete"), 2: (2, 0, "complete"), 3: (0, 1, "incomplete")}
    shown = {r.doc_id: r.markdown for r in R.assemble_from_blocks(rendered).collect()}
    assert shown[1] == "## A\n\n[Render Error: LATEX_BLOCK]\n\nend\n" and "Render Error" not in shown[2]
    own = R.render_outcome(spans, checks={"short": lambda code, lines: F.size(lines) > 0})
    assert {r.error for r in own.collect()} == {"short"}


def test_style_levels_of_long_chains_and_cycles(spark, tmp_path):
    from paperloom.operators import office as W

    rows = [("p", f"s{k}", "heading 4" if k == 0 else None, f"s{k - 1}" if k else None, None) for k in range(300)]
    rows += [("q", "a", None, "b", None), ("q", "b", None, "a", None), ("q", "c", None, "a", None), ("q", "d", None, "lost", None), ("q", "e", "heading 1", "a", None)]
    rows += [("q", "s5", None, None, 2), ("q", "self", None, "self", None)]
    styles = spark.createDataFrame(rows, "package string, style_id string, name string, base_style_id string, outline_lvl int")
    got = {(r.package, r.style_id): r.level for r in W.style_levels_stored(styles, str(tmp_path), ["package"]).collect()}
    assert got == {("p", f"s{k}"): 4 for k in range(300)} | {("q", x): None for x in ("a", "b", "c", "d", "self")} | {("q", "e"): 1, ("q", "s5"): 3}
    whole = {(r.package, r.style_id): r.level for r in W.style_levels(styles, ["package"]).collect()}
    assert got == whole
