from paperloom.operators import audit as AU
from paperloom.operators import render as R


def test_changed_blocks_are_named_without_a_shuffle(corpus):
    texts = ("# A\n\n> [NOTE] said\n\nplain\n", "one\n\ntwo\n", "")
    found = AU.roundtrip_stable(R.roundtrip_corpus(corpus(*texts)))
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = {r["doc_id"]: (r["blocks"], r["status"], r["changed"]) for r in found.collect()}
    assert rows[2] == (2, "PASS", "") and 3 not in rows
    assert rows[1][1:] == ("PASS", "BLOCKQUOTE")


def test_each_text_is_parsed_once(corpus):
    found = AU.roundtrip_stable(corpus("# A\n\n**K**: v\n\ntext\n", "1. 3 > 2\n\n> [NOTE] x\n"))
    assert "array(before#" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = {r["doc_id"]: (r["blocks"], r["status"], r["changed"]) for r in found.collect()}
    assert rows == {1: (1, "PASS", "PARAGRAPH"), 2: (2, "PASS", "BLOCKQUOTE")}
