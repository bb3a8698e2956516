"""Column profiles on odd tables: ragged rows, empty and wide cells, blanks beyond ASCII."""

import pytest

from paperloom.operators import structure as S
from paperloom.operators import tables as T
from paperloom.options import ParseOptions

TABLE = "| Item | Revenue |\n|---|---:|\n| a　bb  ccc | (1234567) |\n| dddd | -9876 | cut | off |\n| only |\n|  | 12 345 |\n|   | 7 |"


@pytest.mark.parametrize(
    "options, expected",
    [
        (ParseOptions(), [(0, "text", 6, 4, 2.28), (1, "numeric", 11, 11, 1.55)]),
        (ParseOptions(keep_empty_cells=True), [(0, "text", 4, 4, 2.16), (1, "numeric", 7, 11, 1.35)]),
    ],
)
def test_profiles_of_an_odd_table(corpus, options, expected):
    rows = T.column_profile(S.segment_blocks(corpus(TABLE, "| |\n|---|", "no table")), options).orderBy("doc_id", "col_idx").collect()
    got = [(r.col_idx, r.kind, r.representative_length, r.longest_token, round(r.score, 6)) for r in rows if r.doc_id == 1]
    assert got == expected


def test_a_profile_takes_only_what_it_needs(corpus):
    plan = T.column_profile(S.segment_blocks(corpus(TABLE)))._jdf.queryExecution().analyzed().toString()
    assert "financial" in plan
    assert "dropped" not in plan and "alignments" not in plan
