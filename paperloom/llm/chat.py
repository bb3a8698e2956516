"""Chat formatting by token-level assembly.

Every turn is encoded on its own, row by row: its text, with control strings escaped, between reserved ids that mark the
role. A running sum over the conversation's turns gives each segment its place in the token stream, and with it the
spans under the loss mask (the assistant's texts with the id that ends them). ``assemble`` splices the segments of a
conversation into one row; ``read_back`` walks over segments in order and recovers roles and texts from the ids alone.

Defined cases: turns are ordered by turn number (nulls first), then role, then text, so ties and repeated rows have a
fixed order; null texts and roles are empty; roles other than system, user and assistant are written into the stream;
a null conversation id is a conversation of its own; an empty table gives an empty result; further columns of the input
are not part of a segment. A hot conversation is never held whole unless it is assembled: segments and ``read_back``
keep a running sum and two digests.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .token_counts import load_model

# Fixed values of the template: opening and closing strings by role; any other role uses OTHER.
TURNS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE]", "[TEXT]", "[/TEXT]")
CONTROL = [s for pair in TURNS.values() for s in pair] + list(OTHER)

_CONTROL = r"([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|TEXT\]|/TEXT\])"
_ESCAPED = r"([<\[])\\(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|TEXT\]|/TEXT\])"
#: U+2581 stands for a space among the pieces and could not be told from one; it is written by this name.
MARK, _MARK_NAME = "▁", r"\{(\\*)u2581\}"


def escape(text: str) -> str:
    """Put one more backslash into everything that is, or looks like the escape of, a control string."""
    text = re.sub(_CONTROL, r"\1\2\\\3", text)
    return re.sub(_MARK_NAME, r"{\1\\u2581}", text).replace(MARK, "{u2581}")


def unescape(text: str) -> str:
    named = re.sub(_MARK_NAME, lambda m: "{" + m[1][1:] + "u2581}" if m[1] else MARK, text)
    return re.sub(_ESCAPED, r"\1\2\3", named)


class ChatTokens:
    """The vocabulary at ``path``: ``<s>`` and ``</s>`` have ids there, the other control strings get ids above it."""

    def __init__(self, path: str):
        self.model = load_model(path)
        own = {s: self.model.piece_to_id(s) for s in ("<s>", "</s>")}
        above = [s for s in CONTROL if s not in own]
        self.ids = own | {s: self.model.get_piece_size() + k for k, s in enumerate(above)}
        self.strings = {i: s for s, i in self.ids.items()}

    def segment(self, role: str | None, text: str | None) -> tuple[list[int], str]:
        """Ids and rendered text of one turn."""
        role, text = role or "", escape(text or "")
        if role in TURNS:
            start, end = TURNS[role]
            return [self.ids[start], *self.model.encode(text), self.ids[end]], start + text + end
        role = escape(role)
        start, between, end = OTHER
        ids = [self.ids[start], *self.model.encode(role), self.ids[between], *self.model.encode(text), self.ids[end]]
        return ids, start + role + between + text + end

    def read(self, ids: list[int]) -> list[tuple[str, str, list[int]]]:
        """``(control string or "", text, ids)`` of the stretches of a stream; the text of a stretch is unescaped."""
        out, run = [], []
        for i in [*ids, None]:
            if i is not None and i not in self.strings:
                run.append(i)
                continue
            if run:
                out.append(("", unescape(self.model.decode(run)), run))
                run = []
            if i is not None:
                out.append((self.strings[i], "", [i]))
        return out

    def render(self, ids: list[int]) -> str:
        """The formatted text that a stream stands for."""
        return "".join(control or escape(text) for control, text, _ in self.read(ids))

    def turns(self, ids: list[int]) -> list[tuple[str, str]]:
        """Roles and texts of a stream of whole turns."""
        found, parts, role = [], [], None
        starts = {start: r for r, (start, _) in TURNS.items()} | {OTHER[0]: None}
        ends = {end for _, end in TURNS.values()} | {OTHER[2]}
        for control, text, _ in self.read(ids):
            if not control:
                parts.append(text)
            elif control in starts:
                role, parts = starts[control], []
            elif control == OTHER[1]:
                role, parts = "".join(parts), []
            elif control in ends:
                found.append((role, "".join(parts)))
        return found


def chat_segments(
    turns: DataFrame, path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per turn: ``conv_id, seg, turn, ids, formatted, loss, start, stop``; start and stop count tokens."""

    @F.pandas_udf("ids array<int>, formatted string")
    def encoded(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tokens = ChatTokens(path)
        for roles, texts in batches:
            rows = [tokens.segment(r, t) for r, t in zip(roles, texts, strict=True)]
            yield pd.DataFrame(rows, columns=["ids", "formatted"])

    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    made = rows.withColumn("made", encoded("role", "text")).select("conv_id", "turn", "role", "text", "made.ids", "made.formatted")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.size("ids").cast("long")).over(before)
    return made.select(
        "conv_id", F.row_number().over(order).alias("seg"), "turn", "ids", "formatted",
        (F.col("role") == "assistant").alias("loss"), (stop - F.size("ids")).alias("start"), stop.alias("stop"),
    )


def loss_span(segments: DataFrame) -> Column:
    """The tokens of a segment under the loss mask: all but the id that opens the assistant's turn."""
    return F.when(F.col("loss"), F.struct((F.col("start") + 1).alias("start"), F.col("stop").alias("stop")))


def assemble(segments: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, ids, loss_mask, loss_spans, formatted`` (a conversation must fit in a row)."""
    parts = F.array_sort(F.collect_list(F.struct("seg", "ids", "formatted", loss_span(segments).alias("span"))))
    spans = F.filter(F.col("parts.span"), lambda s: s.isNotNull())
    masked = lambda p: F.concat(
        F.array_repeat(F.lit(False), F.when(p["span"].isNull(), F.size(p["ids"])).otherwise(1)),
        F.array_repeat(F.lit(True), F.when(p["span"].isNull(), 0).otherwise((p["span"]["stop"] - p["span"]["start"]).cast("int"))),
    )
    return segments.groupBy("conv_id").agg(parts.alias("parts")).select(
        "conv_id", F.flatten("parts.ids").alias("ids"), F.flatten(F.transform("parts", masked)).alias("loss_mask"),
        spans.alias("loss_spans"), F.array_join("parts.formatted", "").alias("formatted"),
    )


READ_SCHEMA = "conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


def read_back(segments: DataFrame, path: str) -> DataFrame:
    """Digests of the conversations, recovered from the ids, their places and the loss spans of their segments."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, key, state, done = ChatTokens(path), None, None, []

        def close():
            n, turns, chars, loss, formatted, size = state
            done.append((key[0], n, turns.hexdigest(), chars, loss.hexdigest(), formatted, size))

        for batch in batches:
            for conv, ids, start, span_from, span_to in zip(
                batch["conv_id"].astype(object), batch["ids"], batch["start"], batch["span_from"], batch["span_to"], strict=True
            ):
                conv = None if pd.isna(conv) else conv
                if key is None or key[0] != conv:
                    if key is not None:
                        close()
                    key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                ids = [int(i) for i in ids]
                assert start == state[5], "segments out of order"
                for role, text in tokens.turns(ids):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if span_from >= 0:
                    for control, text, _ in tokens.read(ids[int(span_from - start) : int(span_to - start)]):
                        if not control:
                            state[2] += len(text)
                            state[3].update(text.encode())
                state[4] += len(tokens.render(ids))
                state[5] += len(ids)
            if done:
                yield pd.DataFrame(done, columns=columns)
                done.clear()
        if key is not None:
            close()
            yield pd.DataFrame(done, columns=columns)

    schema = READ_SCHEMA.format(kind=segments.schema["conv_id"].dataType.simpleString())
    columns = [c.split()[0] for c in schema.split(", ")]
    # the same keys and order as the running sum's, so that no second exchange or sort is needed
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    span = loss_span(segments)
    rows = ordered.select(
        "conv_id", "ids", "start", F.coalesce(span["start"], F.lit(-1)).alias("span_from"), F.coalesce(span["stop"], F.lit(-1)).alias("span_to")
    )
    return rows.mapInPandas(read, schema)
