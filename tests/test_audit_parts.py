import pytest

from paperloom.operators import audit as AU

TEXTS = [
    ("# T\n\n**Sector**: a\n\n## S\n\ntext *one*\n\n---\n\n- x\n- y\n", "# T\n\n**Sector**: b\n\n## S\n\ntext *one*\n\n- x\n- y\n"),
    ("same\n\nsame\n\nsame\n", "same\n\nsame\n"),
    ("one\n\ntwo\n\nthree _i_\n", "one\n\n2\n\nthree _i_\n"),
    ("equal\n", "equal\n"),
    ("spaces   inside\n", "spaces inside\n"),
    ("", "new\n"),
]


@pytest.fixture(scope="module")
def sides(spark):
    frame = lambda n: spark.createDataFrame([(i, t[n]) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    alone = spark.createDataFrame([(90, "gone **b**\n")], "doc_id long, text string")
    return frame(0).unionByName(alone), frame(1)


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("ask, parts", [(AU.metadata_diff, "metadata"), (AU.count_delta, "counts"), (AU.audit_status, "status")])
def test_parts_tell_the_same_as_whole_records(sides, ask, parts):
    assert _rows(ask(AU.pair_versions(*sides, parts))) == _rows(ask(AU.pair_versions(*sides)))


def test_blocks_of_both_sides_are_those_of_their_own_records(sides):
    got = {r["doc_id"]: r for r in AU.pair_versions(*sides).collect()}
    for n, side in enumerate(("a", "b")):
        for r in AU.records(sides[n]).collect():
            if got[r["doc_id"]]["a"] or got[r["doc_id"]]["b"]:
                assert got[r["doc_id"]][side]["blocks"] == r["r"]["blocks"]
    assert got[3]["a"] is None and got[90]["b"] is None


@pytest.mark.parametrize("tell", [AU.audit_json, AU.audit_report])
def test_a_report_parses_its_pairs_once(sides, tell):
    plan = tell(AU.pair_versions(*sides))._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in line.split("(")[0].split()[:2][-1:][0] for line in plan.splitlines() if line.split()) <= 1
    assert plan.count("ArrowEvalPython") == 1
