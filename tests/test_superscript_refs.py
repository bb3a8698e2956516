"""References are found without the runs of texts that hold none."""

from paperloom.operators import footnotes as N
from paperloom.operators import inline as I
from paperloom.operators import structure as S


def test_same_references_as_of_all_runs(corpus):
    spans = S.segment_blocks(corpus("a^1^ **b^2^** c\nd ^x^ \\^3\\^\n\n- e^4^\n\n| a | b^5^ |\n|---|---|\n| ^6^ | 2 |\n| $x^7^$ | ^8^ y ^9^ |\n", "no mark\n\n| q |\n|---|\n| r |\n", ""))
    expected = sorted(map(str, N.footnote_refs(I.block_runs(spans)).collect()))
    assert sorted(map(str, N.superscript_refs(spans).collect())) == expected and len(expected) >= 5
    plain = I.block_runs(spans, "^").filter("row_idx IS NOT NULL").select("text").collect()
    assert not [r for r in plain if r.text in ("a", "r", "2")]  # cells without a mark have no runs
