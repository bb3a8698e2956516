"""Stored style chains: rounds follow the largest scope; settled styles are not joined again."""

import glob

from paperloom.operators import office as W

COLUMNS = "package long, style_id string, name string, base_style_id string, outline_lvl int"


def test_rounds_follow_the_largest_scope(spark, tmp_path):
    rows = [(p, f"s{i}", "heading 2" if p % 2 and i == 0 else None, f"s{(i - 1) % 3}" if i or p % 2 == 0 else None, None) for p in range(64) for i in range(3)]
    rows += [(99, "lost", None, "missing", None), (99, "own", None, "own", None)]
    got = W.style_levels_stored(spark.createDataFrame(rows, COLUMNS), str(tmp_path / "s"), ["package"]).collect()
    assert {(r.package, r.style_id, r.level) for r in got} == {(p, f"s{i}", 2 if p % 2 else None) for p in range(64) for i in range(3)} | {(99, "lost", None), (99, "own", None)}
    assert len(got) == len(rows)
    assert len(glob.glob(f"{tmp_path}/s/round=*")) <= 3  # 194 styles in all, 3 in a scope
