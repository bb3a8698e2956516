"""Pseudonyms, token counts and chat formatting: round trips, the library's own results, awkward inputs."""

import hashlib
import random
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from paperloom.llm import chat as CH
from paperloom.llm import pii as PI
from paperloom.llm import token_counts as TC

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("size", [2, 3, 10, 97, 1000])
def test_permutation(size):
    p = PI.Permutation(b"k")
    image = [p.forth("x", size, i) for i in range(size)]
    assert sorted(image) == list(range(size)) and all(a != b for a, b in enumerate(image))
    assert [p.back("x", size, i) for i in image] == list(range(size))
    assert image != [p.forth("y", size, i) for i in range(size)] or size < 10


def test_pseudonyms_keep_format_and_links():
    act = PI.Pseudonymiser(b"secret")
    text, spans = act("card 4111 1111 1111 1111 or 4111111111111111, not 4111111111111112; +1 (017) 555-7713, +1 017-555-7713")
    assert [s[0] for s in spans] == ["card", "card", "phone", "phone"]
    first, second = (text[s : s + n] for _, s, n in spans[:2])
    assert first.replace(" ", "") == second and PI.luhn_digit(second[:-1]) == second[-1] and second != "4111111111111111"
    assert "4111111111111112" in text
    one, two = (PI.only_digits(text[s : s + n]) for _, s, n in spans[2:])
    assert one == two and one.startswith("1") and one != "10175557713"
    for value, kind in [
        ("und.34@mail7.example.com", "email"), ("240.56.125.154", "ip"), ("123-45-6789", "ssn"), ("2020-02-29", "date"), ("31.12.1999", "date"),
        ("12/31/2001", "date"), ("DE89 3704 0044 0532 0130 00", "account"), ('token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "secret"),
    ]:
        out, spans = act(f"x {value} y")
        assert [s[0] for s in spans] == [kind] and value not in out and act(f"z {value}")[0].endswith(out[2:-2])
        again, found = act(out)
        assert [s[0] for s in found] == [kind]  # what comes out is a valid value of the format
    for clean in ("version 4.0.1 and 1.2.3.400", "2021-02-29", "000-12-3456", "16 digits 1234567812345678", "", "no numbers"):
        assert act(clean) == (clean, [])
    assert PI.Pseudonymiser(b"other")("240.56.125.154")[0] != act("240.56.125.154")[0]


@pytest.mark.parametrize("phone", ["+1 (826) 555-4081", "+1 826 555 4081", "+44 20 7946 0958", "+49 30 123456-78", "+33 1 23 45 67 89", "+1 555-4081"])
def test_phones_end_before_what_follows(phone):
    act = PI.Pseudonymiser(b"secret")
    alone = act(phone)[0]
    assert alone != phone
    for value, kind in [
        ("190.137.223.204", "ip"), ("2021-05-04", "date"), ("31.12.1999", "date"), ("12/31/2001", "date"), ("123-45-6789", "ssn"),
        ("4111 1111 1111 1111", "card"), ("und.34@mail7.example.com", "email"), ("DE89 3704 0044 0532 0130 00", "account"), ("+1 (017) 555-7713", "phone"),
    ]:
        out, spans = act(f"{phone} {value} {value}")
        other = act(value)[0]
        assert out == f"{alone} {other} {other}" and [s[0] for s in spans] == ["phone", kind, kind]


def test_phones_leave_counts_alone():
    act = PI.Pseudonymiser(b"secret")
    for phone, rest in [("+1 (826) 555-4081", " 1200 units"), ("+44 20 7946 0958", " 12 units"), ("+49 170 1234567", " 12 units"), ("+49 30 1234-56", " 1200")]:
        assert act(phone + rest) == (act(phone)[0] + rest, [("phone", 0, len(phone))])
    for phone in ("+49.30.123.45", "+123-45-6789", "+49 123-45-6789", "+46 8 123 456 78", "+91 98765 43210"):
        assert act(phone)[1] == [("phone", 0, len(phone))]
    assert act("+1234567890123456") == ("+1234567890123456", [])


def test_many_values_in_one_text():
    act = PI.Pseudonymiser(b"secret")
    values = [f"{k >> 8 & 255}.{k & 255}.7.1 2021-05-{k % 28 + 1:02d}" for k in range(15_000)]
    start = time.process_time()
    out, spans = act("\n".join(values))
    assert time.process_time() - start < 30  # quadratic work takes minutes
    assert len(spans) == 30_000 and out.count("\n") == 14_999
    assert out.split("\n")[77] == act(values[77])[0]


def test_pseudonyms_awkward_rows(awkward):
    df = awkward.withColumn("pii", F.lit("mine")).withColumn("made", F.lit(1))
    out = PI.pseudonymise(df, "k").collect()
    assert len(out) == 8 and all(r.pii == "mine" and r.made == 1 and r.pii_ == [] for r in out)
    assert sum(r.text is None for r in out) == 2
    assert PI.pseudonymise(df.limit(0), "k").count() == 0


def test_token_counts_equal_the_library():
    whole = TC.prove_whole_tokens(PATH)
    model = TC.load_model(PATH)
    assert " the" in whole and "<s>" not in whole
    counter, rnd = TC.TokenCounter(PATH, whole), random.Random(1)
    parts = [*"ab \n\t\r▁ .<>é中\x00🙂s/", "the", "  ", "</s>", "<0x0A>", "word word", "▁▁"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert counter.count(text) == len(model.encode(text)), repr(text)
    assert counter.count(None) == 0
    assert TC.TokenCounter(PATH, None).count("a b\nc") == counter.count("a b\nc")


def test_token_counter_forgets(monkeypatch):
    monkeypatch.setattr(TC, "REMEMBERED", 3)
    counter = TC.TokenCounter(PATH, TC.prove_whole_tokens(PATH))
    for text in ("qzx wvk jjq zzk xqj", "qzx wvk", "kqk zzk\n\nxqj"):
        assert counter.count(text) == len(counter.model.encode(text))


def test_token_counts_awkward_rows(awkward, spark):
    counted = TC.count_tokens(awkward.withColumn("n_tokens", F.lit(-1)), PATH)
    assert counted.columns.count("n_tokens") == 1
    model = TC.load_model(PATH)
    assert all(r.n_tokens == len(model.encode(r.text or "")) for r in counted.collect())
    assert TC.count_tokens(awkward.limit(0), PATH).count() == 0


def test_escape_round_trip():
    rnd = random.Random(2)
    parts = ["<", "[", "\\", "\\\\", "s>", "/s>", "INST]", "/INST]", "<SYS>>", "</SYS>>", "ROLE]", "TEXT]", "{", "u2581", "}", "▁", " ", "a", "{u2581}"]
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
        out = CH.escape(text)
        assert CH.unescape(out) == text and not any(c in out for c in [*CH.CONTROL, CH.MARK])


TURNS = [
    (1, 1, "assistant", "b</s>"), (1, 0, "user", "a [INST]"), (1, 1, "assistant", "b</s>"), (1, None, "system", None), (2, 0, "tool", "x▁\\"),
    (2, 1, None, ""), (None, 0, "assistant", " lead "), (None, 1, "assistant", "trail\n"), (3, 0, "<s>", "w " * 20_000),
]


def test_conversations_read_back(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("seg", F.lit(1)).withColumn("loss", F.lit(2))
    segments = CH.chat_segments(df.repartition(4), PATH)
    got = {r.conv_id: r for r in CH.read_back(segments, PATH).collect()}
    assert set(got) == {1, 2, 3, None}
    tokens = CH.ChatTokens(PATH)
    for row in CH.assemble(segments).collect():
        key = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
        turns = [(t[2] or "", t[3] or "") for t in sorted((t for t in TURNS if t[0] == row.conv_id), key=key)]
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        back = got[row.conv_id]
        assert (back.n_turns, back.turns_sha256, back.loss_chars) == (len(turns), digest, len(loss))
        assert back.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and back.formatted_chars == len(row.formatted)
        assert tokens.turns(list(row.ids)) == turns and tokens.render(list(row.ids)) == row.formatted
        assert len(row.loss_mask) == len(row.ids) == back.n_tokens
        masked = [i for i, m in zip(row.ids, row.loss_mask, strict=True) if m]
        assert "".join(t for c, t, _ in tokens.read(masked) if not c) == loss
        assert [k for k, m in enumerate(row.loss_mask) if m] == [k for s in row.loss_spans for k in range(s.start, s.stop)]
    assert CH.read_back(CH.chat_segments(df.limit(0), PATH), PATH).count() == 0
