"""Periodic runs against brute force over all stretches."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from paperloom.llm import periodic_runs as PR
from paperloom.llm.queries import QUERIES


def _smallest_period(w):
    border, k = [0] * len(w), 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = border[k - 1]
        k += w[i] == w[k]
        border[i] = k
    return len(w) - border[-1]


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - i
            if length >= max(24, 3 * q) and _smallest_period(words[i : i + length]) == q:
                out.append((i, length, q))
            i = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _periodic(rnd, letters, n):
    root = [rnd.choice(letters) for _ in range(rnd.randint(1, max(1, n // 3)))]
    return (root * n)[:n]


@pytest.mark.parametrize("letters", [1, 2, 3, 40])
def test_runs_against_brute_force(letters):
    rnd = random.Random(letters)
    letters = [f"w{k}" for k in range(letters)]
    texts = [[]]
    for _ in range(150):
        text = []
        for _ in range(rnd.randint(1, 5)):
            n = rnd.choice([1, 3, 24, 30, 77, 150, 310])
            text += rnd.choice([_periodic(rnd, letters, n), [rnd.choice(letters) for _ in range(n)]])
        texts.append(text)
    for short in (1, 8):  # all but the shortest periods by minimizers, or those beyond the direct scans
        got = PR.runs_of(texts, short)
        for words, own in zip(texts, got, strict=True):
            assert own == brute_runs(words), (short, words)


def test_words_of_special_orders():
    fibonacci, thue_morse, cube_free = ["a"], ["a"], []
    before = ["b"]
    while len(fibonacci) < 900:
        before, fibonacci = fibonacci, fibonacci + before
    while len(thue_morse) < 1024:
        thue_morse = thue_morse + ["b" if x == "a" else "a" for x in thue_morse]
    nested = (["a"] * 30 + ["b"]) * 12 + ["c"] + ((["a", "b"] * 13 + ["c"]) * 4 + ["d"]) * 5
    for words in (fibonacci, thue_morse, nested, cube_free, fibonacci * 4, thue_morse[:37] * 9):
        assert PR.runs_of([words]) == [brute_runs(words)]


def _edited(doc_id, text):
    words = text.encode().split()
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def _expected(doc_id, text):
    words = _edited(doc_id, text or "")
    runs = brute_runs(words)
    most = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    digest = lambda x: hashlib.sha256(x).hexdigest()
    return (
        doc_id, len(runs), *most, most[0] if most[0] is None else 1000 * most[1] // most[2],
        digest("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), digest(b" ".join(kept)),
    )


def _rows(tmp_path, spark, df):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r)[:8] for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()), key=str)


def test_query_against_brute_force(tmp_path, spark, documents):
    rnd = random.Random(5)
    rows = []
    for k in range(260):
        n = rnd.choice([0, 1, 2, 30, 100, 400])
        rows.append((k - 3, rnd.choice([" ", "\n", " \t "]).join(rnd.choice(["é", "b", "Ü ", "x"]) for _ in range(n))))
        if k % 3 == 0:
            rows.append((1000 + k, "\n".join(["a b c d e"] * rnd.randint(1, 9) + ["f"])))
    assert _rows(tmp_path, spark, documents(rows)) == sorted((_expected(i, t) for i, t in rows), key=str)


def test_whole_table_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").filter(F.length("text") < 6000).collect()
    got = {r.doc_id: tuple(r)[:8] for r in QUERIES["op13_periodic_runs"](spark, folder).collect()}
    for r in docs:
        assert got[r.doc_id] == _expected(r.doc_id, r.text)


def test_awkward_rows(tmp_path, spark, awkward):
    df = awkward.withColumn("runs", F.lit("mine")).withColumn("row", F.lit(1)).withColumn("collapsed", F.lit(2))
    found = PR.periodic_runs(df)
    got = found.select("row.*", F.col("n_words").alias("n"), F.col("runs").alias("own")).collect()
    assert len(got) == 8 and {(r.doc_id, r.n) for r in got} == {(1, 0), (2, 0), (3, 30000), (4, 3), (None, 3), (None, 0), (5, 0)}
    assert [[tuple(x) for x in r.own] for r in got if r.doc_id == 3] == [[(0, 30000, 1)]]
    assert PR.periodic_runs(df.limit(0)).count() == 0
    expected = sorted((_expected(r.doc_id, r.text) for r in awkward.collect() if r.doc_id != 3), key=str)
    assert [r for r in _rows(tmp_path, spark, awkward) if r[0] != 3] == expected


def test_long_texts_take_time_in_proportion():
    import time

    def took(n):
        rnd = random.Random(7)
        text = [rnd.choice("abcdefgh") for _ in range(n)] + _periodic(rnd, "abcdefghij", n) + ["a"] * n + (["a"] * 9 + ["b"]) * (n // 10)
        start = time.process_time()
        PR.runs_of([text])
        return time.process_time() - start

    assert took(80_000) < 12 * took(20_000) + 0.5
