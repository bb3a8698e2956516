"""Block ranges, typed blocks and Markdown of office documents."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import office as W
from paperloom.operators import office_flow as OW

BLOCK = (
    "doc_id long, block_idx long, kind string, text string, style_id string, num_id string, ilvl int, left_indent_pt double, "
    "all_bold boolean, outline_lvl int, n_rows int, n_cols int, fill string, bookmark string, has_object boolean"
)


def _blocks(spark, rows):
    """Rows ``(doc_id, block_idx, text, more)``."""
    names = [f.split()[0] for f in BLOCK.split(", ")]
    full = []
    for doc, idx, text, more in rows:
        own = {"doc_id": doc, "block_idx": idx, "kind": "p", "text": text, "all_bold": False, **more}
        full.append(tuple(own.get(n) for n in names))
    return spark.createDataFrame(full, BLOCK)


@pytest.fixture
def lookups(spark):
    styles = spark.createDataFrame([("Heading1", "heading 1", None, None)], "style_id string, name string, base_style_id string, outline_lvl int")
    numbering = spark.createDataFrame([("1", "10")], "num_id string, abstract_id string")
    levels = spark.createDataFrame([("10", 0, "decimal"), ("10", 1, "lowerLetter")], "abstract_id string, ilvl int, num_fmt string")
    return styles, numbering, levels


@pytest.mark.parametrize("chunk", [4, 4096])
def test_spans_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(W, "CHUNK", chunk)
    rnd = random.Random(chunk)
    blocks = [(rnd.choice([1, 1, 1, 2, 3, None]), rnd.randint(0, 60), f"b{k}") for k in range(300)]
    blocks = list({(d, i): (d, i, t) for d, i, t in blocks}.values())
    spans = [(rnd.choice([1, 1, 2, 9, None]), a := rnd.randint(-5, 60), rnd.choice([a, a + 1, a + 3, a + 9, a - 2])) for _ in range(12)]
    spans += [(2, 50, None), (3, -(1 << 40), 1 << 61), (1, None, 5), (1, 3, 4), (1, 3, 4)]

    def held(doc, i):
        return any(d == doc and d is not None and s is not None and s <= i and (e is None or i < e) for d, s, e in spans)

    b = spark.createDataFrame(blocks, "doc_id long, block_idx long, text string").repartition(3)
    s = spark.createDataFrame(spans, "doc_id long, start_idx long, end_idx long")
    marked = {tuple(r)[:3]: r.in_span for r in OW.mark_spans(b, s).collect()}
    assert marked == {x: held(x[0], x[1]) for x in blocks}
    assert {tuple(r) for r in OW.drop_spans(b, s).collect()} == {x for x in blocks if not held(x[0], x[1])}
    assert {tuple(r) for r in OW.keep_spans(b, s).collect()} == {x for x in blocks if held(x[0], x[1])}
    assert OW.drop_spans(b, s.limit(0)).count() == len(blocks) and OW.drop_spans(b.limit(0), s).count() == 0


def test_ranges_need_no_nested_loop(spark):
    b = spark.range(10).select(F.col("id").alias("doc_id"), F.col("id").alias("block_idx"))
    s = spark.range(10).select(F.col("id").alias("doc_id"), F.col("id").alias("start_idx"), (F.col("id") + 5).alias("end_idx"))
    plan = OW.drop_spans(b, s)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("Exchange hashpartitioning") < 6


@pytest.mark.parametrize("chunk", [2, 4096])
def test_typed_blocks(spark, monkeypatch, lookups, chunk):
    monkeypatch.setattr(W, "CHUNK", chunk)
    item = {"style_id": "ListNumber"}
    rows = [
        (1, 0, "Title", {"style_id": "Heading1"}), (1, 1, "  ", {}), (1, 2, "one", {"num_id": "1"}), (1, 3, "inner", {"num_id": "1", "ilvl": 1}),
        (1, 4, "between", {}), (1, 5, "two", {"num_id": "1"}), (1, 6, "inner again", {"num_id": "1", "ilvl": 1}), (1, 7, "skipped", {}),
        (1, 8, "new one", {"num_id": "1"}), (1, 9, "7) seen", item), (1, 10, "counted", item), (1, 11, "• dot", {}), (1, 12, "$$a+b$$", {}),
        (1, 13, "\nx = 1\n", {"bookmark": "_ibrep_CODE_BLOCK_py_0a1F"}), (1, 14, "rule", {"bookmark": "_ibrep_SEPARATOR"}),
        (1, 15, "NOTE: mind", {"kind": "t", "n_rows": 1, "n_cols": 1, "fill": "FFF3CD"}), (1, 16, "", {"kind": "t", "n_rows": 2, "n_cols": 2}),
        (2, 0, "other", {"num_id": "1"}),
    ]
    spans = spark.createDataFrame([(1, 7, 8)], "doc_id long, start_idx long, end_idx long")
    typed = OW.office_to_blocks(_blocks(spark, rows), *lookups, spans)
    got = [tuple(r) for r in typed.select("doc_id", "block_idx", "source_idx", "type", "level", "number", "text").orderBy("doc_id", "block_idx").collect()]
    assert got == [
        (1, 0, 0, "heading", 1, None, "Title"), (1, 1, 2, "number", 0, "1", "one"), (1, 2, 3, "number", 1, "1.a", "inner"),
        (1, 3, 4, "paragraph", None, None, "between"), (1, 4, 5, "number", 0, "2", "two"), (1, 5, 6, "number", 1, "2.a", "inner again"),
        (1, 6, 8, "number", 0, "1", "new one"), (1, 7, 9, "number", 0, "7", "seen"), (1, 8, 10, "number", 0, "1", "counted"),
        (1, 9, 11, "bullet", 0, None, "dot"), (1, 10, 12, "math", None, None, "a+b"), (1, 11, 13, "code", None, None, "x = 1"),
        (1, 12, 14, "separator", None, None, "rule"), (1, 13, 15, "callout", None, None, "NOTE: mind"), (1, 14, 16, "table", None, None, ""),
        (2, 0, 0, "number", 0, "1", "other"),
    ]
    cells = spark.createDataFrame(
        [(1, 16, 0, 0, "a|b", None), (1, 16, 0, 1, "n", "right"), (1, 16, 1, 0, None, "center"), (1, 16, 1, 1, "2", "right")],
        "doc_id long, block_idx long, row_idx int, col_idx int, text string, align string",
    )
    notes = spark.createDataFrame([(1, 2, "second"), (1, 1, "first")], "doc_id long, num int, text string")
    front = spark.createDataFrame([(1, "---\nkey: v\n---\n")], "doc_id long, frontmatter string")
    text = {r.doc_id: r.markdown for r in OW.office_to_markdown(typed, cells, notes, front).collect()}
    assert text[2] == "1. other\n"
    assert text[1] == (
        "---\nkey: v\n---\n\n# Title\n\n1. one\n\n  1.a. inner\n\nbetween\n\n2. two\n\n  2.a. inner again\n\n1. new one\n\n7. seen\n\n1. counted\n\n- dot\n\n"
        "$$\na+b\n$$\n\n```py\nx = 1\n```\n\n---\n\n> **[주의]**\n> NOTE: mind\n\n| a\\|b | n |\n| :---: | ---: |\n|  | 2 |\n\n## Citations\n1. first\n2. second\n"
    )


def test_flow_has_few_exchanges(spark, lookups):
    rows = _blocks(spark, [(1, k, f"t{k}", {"num_id": "1"}) for k in range(5)])
    spans = spark.createDataFrame([(1, 2, 3)], "doc_id long, start_idx long, end_idx long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan shows what is reused
    try:
        plan = OW.office_to_blocks(rows, *lookups, spans)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 8 and "NestedLoop" not in plan
    print(plan)
