"""Sections of stored blocks read their input once, and chunks still carry values."""

from paperloom.operators import structure as S


def test_blocks_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(row):
        made.add(1)
        return row

    rows = [(d, i, i % 7 + 1 if i % 7 < 3 else None, f"b{i}") for d in (1, 2) for i in range(50)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4).map(counted), "doc_id long, block_idx long, level int, text string")
    got = {(r.doc_id, r.block_idx): (r.heading, r.path) for r in S.assign_sections(df, 4).collect()}
    assert made.value == len(rows)
    assert got[2, 13] == ("b9", "b7 > b8 > b9") and got[1, 1] == ("b1", "b0 > b1") and len(got) == len(rows)
