import re

from paperloom.operators import inline as I
from paperloom.operators import structure as S
from paperloom.sources import writers as WR


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_stored_blocks_make_their_text_once(corpus, tmp_path):
    c = corpus("# T\n\n**K**: v\n\none $x$ two\n\n> [NOTE] q\n\n$$\ny\n$$\n", "| a |\n|---|\n| 1 |\n")
    stored = WR.stored_tables(c, str(tmp_path / "parsed"))["blocks"]
    assert sum(line.lstrip(" :+-").startswith("Generate") for line in _plan(stored).splitlines()) == 2
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(stored) == rows(S.typed_blocks(S.segment_blocks(c)))


def test_plain_texts_need_no_lambda_for_their_runs(corpus):
    runs = I.block_runs(S.segment_blocks(corpus("plain\n\n- **b** i\n\n| a | *c* |\n|---|---|\n| $x$ | |\n")))
    assert re.search(r"(?i)text#\d+ RLIKE|RLIKE\(text#\d+", _plan(runs))
    assert sorted(tuple(r)[1:6] for r in runs.collect() if r["row_idx"] is None) == [
        (0, None, None, 0, "plain"), (1, None, None, 0, "b"), (1, None, None, 1, " i"),
    ]
    assert {(r["row_idx"], r["col_idx"], r["text"], r["italic"], r["is_latex"]) for r in runs.collect() if r["row_idx"] is not None} == {
        (0, 0, "a", False, False), (0, 1, "c", True, False), (1, 0, "x", False, True),
    }


def test_a_keyword_that_shows_only_without_its_anchor_opens_a_region(corpus):
    found = S.segment_blocks(corpus('# T\n\nbody\n\nsour<a id="x"></a>ces\n\nhidden\n'))
    assert [r["code"] for r in found.orderBy("block_idx").collect()] == ["1", "P"]
