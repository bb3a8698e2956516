from pyspark.sql import functions as F

import pytest

from paperloom.functions.running import running
from paperloom.operators import inline as I
from paperloom.operators import metadata as MD
from paperloom.operators import structure as S
from paperloom.operators import tables as T
from paperloom.options import ParseOptions

NL = "\n"


def types(df):
    return [(r.type, r.text) for r in df.orderBy("doc_id", "block_idx").collect()]


def test_full_document(corpus):
    text = NL.join([
        "---", "title: Annual review", "company: Sample Co", "---", "# Heading", "", "A **bold** word.", "",
        "| Item | 2025 |", "|---|---:|", "| Revenue | 1,200 |", "", "> [주의] be careful", "> second", "",
        "- one", "  - two", "3. third thing, listed",
    ])
    c = corpus(text)
    assert types(S.blocks(c)) == [
        ("HEADING_1", "Heading"), ("PARAGRAPH", "A **bold** word."), ("TABLE", None),
        ("BLOCKQUOTE", "be careful second"), ("BULLET_LIST", "one"), ("BULLET_LIST", "two"),
        ("NUMBERED_LIST", "third thing, listed"),
    ]
    meta = MD.document_metadata(c).first()
    assert (meta.title, meta.company, meta.sector) == ("Annual review", "Sample Co", "SECTOR")
    assert T.classify_table(S.segment_blocks(c)).first().table_type == "FINANCIAL"
    assert S.callouts(c).first().title == "주의"
    assert [r.indent_level for r in S.bullet_items(c).orderBy("block_idx").collect()] == [0, 1]


def test_blocks_inside_literal_regions(corpus):
    text = NL.join([
        "para line", "```", "still para", "", "```py", "# no heading", "| no | table |", "```", "$$", "a", "b", "$$",
        "$$", "$$", "$$x$$", "##### five", "```", "open to the end", "$$",
    ])
    assert types(S.blocks(corpus(text))) == [
        ("PARAGRAPH", "para line ``` still para"), ("CODE_BLOCK", "# no heading\n| no | table |"),
        ("LATEX_BLOCK", "a\nb"), ("LATEX_BLOCK", "x"), ("PARAGRAPH", "##### five ``` open to the end"),
    ]


def test_reference_region_ends_only_at_a_heading(corpus):
    text = NL.join(["## References", "1. a", "junk", "| t |", "```", "## ---", "kept", "see Sources here", "gone", "#### Back", "tail"])
    assert types(S.blocks(corpus(text))) == [
        ("SEPARATOR", None), ("PARAGRAPH", "kept"), ("HEADING_4", "Back"), ("PARAGRAPH", "tail"),
    ]
    strict = S.blocks(corpus("see Sources here\nstays"), ParseOptions(strict_reference_header=True))
    assert types(strict) == [("PARAGRAPH", "see Sources here stays")]


def test_every_line_belongs_to_one_block_or_none(corpus):
    text = "a\n\n# b\n| c |\n> d\n- e\n1. f, g\n![h](i)\n---\n$$j$$\n```\nk\n```"
    rows = S.segment_blocks(corpus(text)).collect()
    lines = sorted(n for r in rows for n in range(r.start_line, r.start_line + r.n_lines))
    assert lines == [n for n, x in enumerate(text.split(NL)) if x]
    assert all(r.lines == text.split(NL)[r.start_line:r.start_line + r.n_lines] for r in rows)


def test_invalid_frontmatter_is_content(corpus):
    bad = ["---\n# h\n---\nx", "---\nk: v\n\n\nz: w\n---\nx", "---\n**l:** v\n---\nx", "---\nplain\n---\nx",
           "---\nk: " + "v" * 121 + "\n---\nx", "---\nk: v\nx", "x\n---\nk: v\n---"]
    good = ["---\nk: v\n---\nx", "---\nk: v\n\nz: w\n---"]
    flags = [r.is_valid for r in S.frontmatter_valid(corpus(*bad, *good)).orderBy("doc_id").collect()]
    assert flags == [False] * len(bad) + [True] * len(good)


def test_wrapped_and_broken_embedded_images(corpus):
    ok = "![a](data:image/png;base64,AAAA\nBBBB\n\nCC==)\nnext"
    broken = "![a](data:image/png;base64,AAAA\nno-image\nx)"
    inside = "text\nmore ![a](data:image/png;base64,AAAA) end\nrest"
    rows = S.images(corpus(ok, broken, inside)).collect()
    assert [(r.doc_id, r.alt_text, r.mime, r.data) for r in rows] == [(1, "a", "image/png", "AAAABBBBCC==")]
    assert types(S.blocks(corpus(inside))) == [
        ("PARAGRAPH", "text"), ("PARAGRAPH", "more ![a](data:image/png;base64,AAAA) end rest"),
    ]


def test_hard_breaks_and_spacing(corpus):
    text = "one  two<br>\nthree ( x ) \\\nfour  \nfive"
    assert S.merge_paragraphs(corpus(text)).first().text == "one two\nthree (x)\nfour five"
    kept = S.merge_paragraphs(corpus(text), ParseOptions(keep_double_space=True)).first().text
    assert kept == "one two\nthree (x)\nfour\nfive"


def run_list(df):
    return [
        (r.text, "".join(k for k, on in zip("bi^~$", (r.bold, r.italic, r.superscript, r.subscript, r.is_latex)) if on), r.color_hex)
        for r in df.orderBy("run_idx").collect()
    ]


def test_runs(corpus):
    text = r"a **b** *c* _d_ x_y_z ^1^ H~2~O \*\*e\*\* $f_1$ g\~ <span style='color: #0a0B0c'>h **i**</span> <span style=\"x\">j</span>"
    text = text.replace('\\"', '"')
    assert run_list(I.runs_of(corpus(text), ["doc_id"])) == [
        ("a ", "", None), ("b", "b", None), (" ", "", None), ("c", "i", None), (" ", "", None), ("d", "i", None),
        (" x_y_z ", "", None), ("1", "^", None), (" H", "", None), ("2", "~", None), ("O ", "", None), ("e", "b", None),
        (" ", "", None), ("f_1", "$", None), (" g~ ", "", None), ("h ", "", "#0A0B0C"), ("i", "b", "#0A0B0C"),
        (' <span style="x">j</span>', "", None),
    ]
    assert run_list(I.plain_runs(corpus("$5 and $6"), ["doc_id"])) == [("$5 and $6", "", None)]


def test_empty_cells_shift_or_stay(corpus):
    text = "| a | b | c |\n|---|---|---|\n| 1 |  | 3 |"
    spans = S.segment_blocks(corpus(text))
    row = lambda o: [r.text for r in T.table_cells(spans, o).filter("row_idx = 1").orderBy("col_idx").collect()]
    assert row(ParseOptions()) == ["1", "3", ""]
    assert row(ParseOptions(keep_empty_cells=True)) == ["1", "", "3"]


def test_number_formats(corpus):
    rows = corpus("1234567", "(1234.50)억", "-9876", "12.5%", "1,234", "007", "abc", "2026-01-01", "")
    shown = [r.formatted for r in T.format_financial(rows, ["doc_id"]).orderBy("doc_id").collect()]
    assert shown == ["1,234,567", "(1,234.50)억", "-9,876", "12.5%", "1,234", "7", "abc", "2,026-01-01", ""]
    like = corpus("1,200", "(3.5)", "12 %", "5BP", "3억원", "n/a", "1.2.3", "+7주")
    flags = [r.is_numeric_like for r in T.numeric_like(like, ["doc_id"]).orderBy("doc_id").collect()]
    assert flags == [True, True, True, True, True, False, False, True]


def test_header_and_label_metadata(corpus):
    text = "# Foo Corp - Review\n\n## Sub\n\n**Date**: 2026\n\n**Date:** 2027\n\n# Again\n\nbody **x**\n\n**작성자:** Kim\n\n## H2\n\n**Sector:** late"
    c = corpus(text)
    head = {(r.role, r.key): r.value for r in MD.header_metadata(c).collect()}
    assert head == {("title", ""): "Foo Corp - Review", ("subtitle", ""): "Sub", ("extra", "Date"): "2027"}
    m = MD.infer_metadata(c).first()
    assert (m.title, m.company, m.analyst, m.sector) == ("Foo Corp - Review", "", "Kim", "SECTOR")
    assert types(S.typed_blocks(S.body_blocks(c)))[0] == ("HEADING_1", "Again")


def test_running_totals_equal_plain_windows(spark):
    # one key holds most rows and spans many chunks
    df = spark.range(3000).selectExpr("if(id % 10 < 8, 0, id % 3) AS k", "id AS i", "id % 7 AS v")
    out = running(
        df, ["k"], "i", sums={"s": F.col("v")}, maxima={"m": F.when(F.col("v") == 3, F.struct("i", "v"))}, chunk=64
    )
    rows = sorted((r.k, r.i, r.v, r.s, r.m.i if r.m else None) for r in out.collect())
    expected, sums, last = [], {}, {}
    for r in sorted(df.collect(), key=lambda r: r.i):
        sums[r.k] = sums.get(r.k, 0) + r.v
        if r.v == 3:
            last[r.k] = r.i
        expected.append((r.k, r.i, r.v, sums[r.k], last.get(r.k)))
    assert rows == sorted(expected)


@pytest.mark.parametrize("chunk", [3, 4096])
def test_sections_are_carried_over_chunks(spark, chunk):
    import random

    rnd = random.Random(chunk)
    rows = [(d, i, rnd.choice([None, None, None, 1, 2, 3, 4]), f"b{d}-{i}") for d in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, block_idx long, level int, text string").repartition(4)
    got = {(r.doc_id, r.block_idx): (r.heading, r.path) for r in S.assign_sections(df, chunk).collect()}
    for doc in (1, 2):
        path, heading = {}, None
        for d, i, level, text in rows:
            if d != doc:
                continue
            if level:
                path = {n: t for n, t in path.items() if n < level} | {level: text}
                heading = text
            assert got[d, i] == (heading, " > ".join(path[n] for n in sorted(path)))
