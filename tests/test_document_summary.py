from paperloom.operators import audit as AU


def test_a_summary_is_told_of_every_document(corpus):
    texts = ("# T\n\n**K**: v\n\n### S\n\nBody *one*.\n\n| a | b |\n|--|--|\n| 1 | 2 |\n\n![i](p.png)\n\n## Citations\n1. note\n", "")
    rows = {r["doc_id"]: tuple(r)[1:] for r in AU.document_summary(corpus(*texts)).collect()}
    assert rows[1] == ("T", "", "", 4, "S", 1, 1, 1)
    assert rows[2][3:] == (0, "", 0, 0, 0)
