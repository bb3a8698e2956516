import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
# a cross-section; the driver checks all of them
NAMES = [
    "classify_lines", "blocks", "table_cells", "column_profile", "infer_metadata", "kept_notes", "clean_text",
    "format_corpus", "heading_level", "drop_boilerplate", "hierarchical_numbers", "theme_color", "decode_text",
]


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "part", "supplier", "events", "documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, base, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = base.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    expected = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == expected


def test_entry_and_registry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
