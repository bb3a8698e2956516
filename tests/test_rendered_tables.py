from paperloom.operators import render as R
from paperloom.operators import structure as S


def test_a_rendered_table_is_not_classified_and_plain_rows_stay(corpus):
    rendered = R.render_blocks(S.segment_blocks(corpus("| a | b |\n|--:|---|\n| 1 | x |\n| **2** | p\\_q | cut |\n| 3 |\n")))
    assert "RISK_MATRIX" not in rendered._jdf.queryExecution().optimizedPlan().toString()
    assert rendered.first()["markdown"] == "| a | b |\n| ---: | --- |\n| 1 | x |\n| **2** | p_q |\n| 3 |  |"
