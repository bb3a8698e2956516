import pytest

from paperloom.functions import formatter as FM
from paperloom.operators import audit as AU
from paperloom.operators import cleaner as CL
from paperloom.operators import footnotes as N
from paperloom.operators import formatter as G
from paperloom.operators import math as MA
from paperloom.operators import render as R
from paperloom.operators import structure as S
from paperloom.options import CleanerOptions, ParseOptions, RenderOptions, SeparatorOptions


def mark(tag, *payload):
    return "\ue200" + tag + "".join("\ue202" + p for p in payload) + "\ue201"


def texts(df, name="text"):
    return [r[name] for r in df.orderBy("doc_id").collect()]


def test_cleaner_modes(corpus):
    text = "A" + mark("cite", "s1", "s2") + " B" + mark("cite", "s2") + mark("entity", '["c","Acme","d"]') + "\ue20a "
    footnotes = "A[^1][^2] B[^2]Acme\n\n## Citations\n[^1]: s1\n[^2]: s2\n"
    assert texts(CL.clean_corpus(corpus(text), CleanerOptions("on"))) == [footnotes]
    assert texts(CL.clean_corpus(corpus(text), CleanerOptions("on", "inline"))) == ["A (sources: s1, s2) B (sources: s2)Acme "]
    assert texts(CL.clean_corpus(corpus(text), CleanerOptions("on", "strip"))) == ["A BAcme "]
    assert texts(CL.clean_corpus(corpus(text), CleanerOptions("off"))) == [text]
    assert texts(CL.clean_corpus(corpus("x\ue20a"), CleanerOptions("auto"))) == ["x\ue20a"]
    assert texts(CL.clean_corpus(corpus("x\ue20a"), CleanerOptions("on"))) == ["x"]
    with pytest.raises(ValueError):
        CleanerOptions("maybe")


def test_cleaner_payloads(corpus):
    rows = corpus(
        mark("entity", "not  json"), mark("entity", '["one"]'), mark("image_group", '{"queries":["a","b"]}'),
        mark("image_group", "broken"), mark("widget", "x  y"), mark("note", "z" * 300),
    )
    out = texts(CL.clean_corpus(rows, CleanerOptions("on")))
    assert out[:5] == ["not json", '["one"]', "\n<!-- image_group: a, b -->\n", "\n<!-- image_group removed -->\n", "<!-- widget: x y -->"]
    assert out[5] == "<!-- note: " + "z" * 240 + "... -->"
    dropped = texts(CL.clean_corpus(rows, CleanerOptions("on", drop_unknown_markers=True)))
    assert dropped[4:] == ["", ""]


def test_colon_rules(corpus):
    text = "라벨:값 https://example.com API::v1 10:30 C:\\temp 1:1 a:b:c"
    assert texts(G.rewrite(corpus(text), FM.colon_spacing)) == ["라벨: 값 https://example.com API::v1 10:30 C:\\temp 1:1 a: b: c"]
    assert texts(G.rewrite(corpus("**분석 대상:**값"), FM.colon_spacing, shield=True)) == ["**분석 대상:**값"]


def test_protected_spans_come_back(corpus):
    text = "x $$a^2$$ y $b:c$ **굵:다.가** z"
    assert texts(G.rewrite(corpus(text), lambda t: t, shield=True)) == ["x \n\n$$a^2$$\n\n y $b:c$ **굵:다.가** z"]


def test_headings_in_collapsed_text(corpus):
    rows = corpus("2.1. 시장 분석more content", "3.1.1. 세부 분석more", "끝. 1. 서론", "값12. 제목", "1. " + "가" * 46 + "나")
    out = texts(G.rewrite(rows, FM.insert_headings))
    assert out[0] == "\n\n### 2.1. 시장 분석more content" and out[1] == "\n\n#### 3.1.1. 세부 분석more"
    assert out[2] == "끝. \n\n## 1. 서론" and out[3] == "값12. 제목" and "##" not in out[4]


def test_footnotes(corpus):
    text = "Sources\n1. a\n\n2\\. b\nother\n3. no\nReferences\n2. c\n[^4]: d"
    assert [(r.num, r.text) for r in N.footnote_defs(corpus(text)).orderBy("num").collect()] == [(1, "a"), (2, "c")]
    caret = N.footnote_defs(corpus(text), ParseOptions(caret_definitions=True))
    assert [r.num for r in caret.orderBy("num").collect()] == [1, 2, 4]
    marks = N.footnote_marks(corpus("x.1 y ^2^ z.3, v.4w"), ["doc_id"])
    assert [r.num for r in marks.orderBy("pos").collect()] == [1, 2, 3]


def test_all_notes_stay_without_references(spark):
    notes = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "doc_id long, num int, text string")
    refs = spark.createDataFrame([(1, 2), (1, 2), (1, 9)], "doc_id long, num int")
    kept = {(r.doc_id, r.num, r.is_native) for r in N.kept_notes(refs, notes).collect()}
    assert kept == {(1, 2, True), (2, 1, False)}
    assert [r.num for r in N.dangling_refs(refs, notes).collect()] == [9]


def test_render_options(corpus):
    c = corpus("# T\n\nw **b** $x$ and *i*\n\n![p](a\\b.png)")
    md = lambda **o: R.assemble_documents(c, RenderOptions(include_frontmatter=False, **o)).first().markdown
    assert md() == "w **b** x and *i*\n\n![p](a\\b.png)\n"
    assert md(strip_formatting=True, image_path_prefix="img/") == "w b x and i\n\n![p](img/a/b.png)\n"
    assert md(keep_math_delimiters=True).startswith("w **b** $x$ and")
    assert R.assemble_documents(c).first().markdown.startswith('---\ntitle: "T"\n---\n\nw **b**')


def test_normalize_markdown(corpus):
    out = texts(R.normalize_documents(corpus("a  \n| t |\nb\n```\n\n\n\n| x |\n```\n$$\nm\n$$\nc\n\n\n\nd")))
    assert out == ["a\n\n| t |\n\nb\n\n```\n\n\n\n| x |\n```\n\n$$\nm\n$$\n\nc\n\nd\n"]


def test_rendering_is_stable_after_one_pass(corpus):
    c = corpus("# A\n\n## B\n\ntext **b**\n\n| h | 2025 |\n|:-:|--:|\n| a | 1 |\n\n> [NOTE] q\n\n- i\n\n```\nc\n```\n\n## Sources\n1. n")
    once = R.roundtrip_corpus(c)
    twice = R.roundtrip_corpus(once)
    pairs = AU.pair_versions(once, twice)
    counts = AU.count_delta(pairs).collect()
    assert counts == []


def test_moved_separator_and_lost_code(corpus):
    a = corpus("# T\n\nx\n\n---\n\ny\n\n```\ncode\n```\n\nz")
    b = corpus("# T\n\nx\n\ny\n\n---\n\nz")
    rows = AU.block_diff(AU.pair_versions(a, b)).orderBy("change_no").collect()
    changes = [(r.change, r.source_index, r.target_index, (r.source or r.target).type) for r in rows]
    assert changes in (
        [("removed", 2, None, "SEPARATOR"), ("changed", 4, 3, "CODE_BLOCK")],
        [("added", None, 2, "PARAGRAPH"), ("removed", 3, None, "PARAGRAPH"), ("removed", 4, None, "CODE_BLOCK")],
    )
    assert AU.audit_status(AU.pair_versions(a, a)).first().status == "PASS"


def test_document_on_one_side_only(corpus, spark):
    a = corpus("# T\n\nx", "y")
    b = a.filter("doc_id = 1")
    rows = AU.block_diff(AU.pair_versions(a, b)).collect()
    assert [(r.doc_id, r.change) for r in rows] == [(2, "removed")]


def test_separator_modes(corpus):
    c = corpus("---\n\nx\n\n## ---")
    mode = lambda o: [r["mode"] for r in S.separators(c, o).orderBy("block_idx").collect()]
    assert mode(SeparatorOptions()) == ["rule", "page-break"]
    assert mode(SeparatorOptions("rule")) == ["rule", "rule"]


def test_math_text(spark):
    cases = [(r"\frac{\text{a}}{b}", "(a / b)"), (r"\frac{\frac{1}{2}}{3}", "((1 / 2) / 3)"), (r"\alpha \leq \beta", "α ≤ β"),
             (r"\leftx \left( y \right)", r"\leftx ( y )"), (r"5\%", "5%"), ("plain", "plain")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, text string")
    assert [r.display for r in MA.latex_texts(df, ["i"]).orderBy("i").collect()] == [x for _, x in cases]


def test_needs_formatting(corpus):
    c = corpus("x" * 101, "x" * 100, "a\n" + "x" * 500, "a\n\n\n\n\n" + "x" * 600)
    assert [r.needs_formatting for r in G.needs_formatting(c).orderBy("doc_id").collect()] == [True, False, True, False]


def test_cleaner_before_formatting(corpus):
    c = corpus("본문 시작" + mark("cite", "turn1search0") + " 끝")
    out = G.format_corpus(c, CleanerOptions("auto")).first().text
    assert "\ue200" not in out and "[^1]" in out


def test_equations_of_all_parts_of_a_document(corpus):
    texts = [
        "| a | b |\n|---|---|\n| $x$ | $y$ and $z$ |\n| 1 | 2 | $extra$ |",
        "## Growth of $x$\n\n> [NOTE] callout $y$\n> more $z$\n\n- item $u$\n\ntext $v$ and\n$w$",
        "| h |\n|---|\n| $$x$$ |\n| $5 |\n| $6 |\n\ntext $$y$$ text\n\n$$z$$\n\n$$\nw\n$$",
        "text\n\n## Sources\n1. old $a$\n2. note $b$ $$c$$\n1. new\n",
        "```\n$x$ | $y$\n```\n\n| $5 | $6 |\n|---|---|\n\nplain",
        "",
    ]
    got = {r.doc_id: (r.block_equations, r.inline_equations) for r in MA.equation_counts(corpus(*texts)).collect()}
    assert got == {1: (0, 4), 2: (0, 6), 3: (4, 0), 4: (1, 1), 5: (0, 0), 6: (0, 0)}
