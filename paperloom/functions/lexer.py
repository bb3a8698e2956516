"""Cut a Markdown text into blocks inside one row.

Every line gets a one-character class; the classes of a document form a short
string that one regular expression cuts into blocks, so a document is parsed by
a narrow transformation (no shuffle, no per-row Python).

Classes: ``R S U V`` open a reference region (as text, pipe line, quote line,
fence), ``E`` blank, ``-``/``=`` separators, ``F`` fence, ``L``/``M`` math,
``I``/``J`` embedded image (whole / wrapped over lines), ``T`` pipe line,
``1-4`` headings, ``W`` bold numbered heading, ``Q`` quote, ``B``/``x`` bullet
(``x``: only the untrimmed line is one), ``N``/``y`` numbered item (same), ``h``
numbered title, ``G`` image, ``P`` paragraph text, ``p`` paragraph text that
also ends the paragraph before it, ``b``/``c`` paragraph text that could be the
middle / end of a wrapped embedded image.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import group, let, strip, strip_anchors, strip_bound

WRAPPED_IMAGE = f"J[bE]{{0,{K.DATA_IMAGE_WRAP - 2}}}c"
BLOCKS = (
    r"[RSUV][^1-4W=]*"      # reference region, up to the next heading
    r"|F[^FV]*[FV]?"        # fenced code, up to the next fence or the end
    r"|M[^M]*M?"            # display math
    rf"|{WRAPPED_IMAGE}"    # embedded image wrapped over lines
    r"|T[TS]*"
    r"|Q[QU]*"
    r"|[PpbcJ][PFbcxy]*"    # paragraph; a fence line does not end it
    r"|."
)
DROPPED = "ERSUV"
PARAGRAPH_CODES = "PpbcJ"

TYPES = {
    "1": "HEADING_1", "2": "HEADING_2", "3": "HEADING_3", "4": "HEADING_4",
    "W": "NUMBERED_HEADING", "h": "NUMBERED_HEADING",
    "B": "BULLET_LIST", "x": "BULLET_LIST",
    "N": "NUMBERED_LIST", "y": "NUMBERED_LIST",
    "T": "TABLE", "Q": "BLOCKQUOTE",
    "G": "IMAGE", "I": "IMAGE",
    "-": "SEPARATOR", "=": "SEPARATOR",
    "F": "CODE_BLOCK", "D": "DIAGRAM",
    "L": "LATEX_BLOCK", "M": "LATEX_BLOCK",
    "P": "PARAGRAPH",
}


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def is_numbered_title(s: Column) -> Column:
    """``N. Title`` that reads as a section heading, not as a list item."""
    return let(
        strip(group(s, K.NUMBERED_TITLE, 2)),
        lambda t: (t != "")
        & (group(s, K.NUMBERED_TITLE, 1).try_cast("int") <= 20)
        & (F.length(t) <= 40)
        & ~t.rlike(K.SENTENCE_TAIL),
    )


def _class_of(raw: Column, s: Column, has_data_image: Column, may_open: Column, strict: bool) -> Column:
    keyword = may_open & has_keyword(s)
    if strict:
        keyword = keyword & s.rlike(r"(?U)^(?:#{1,4}\s|\*\*\d)")
    base64_text = strip(raw)
    prose = (
        F.when(~has_data_image, F.lit("P"))
        .when(s.rlike(K.DATA_IMAGE_HINT), F.lit("p"))
        .when(base64_text.rlike(r"(?U)^[A-Za-z0-9+/=\s]*$"), F.lit("b"))
        .when(base64_text.rlike(r"(?U)^[A-Za-z0-9+/=\s]*\)$"), F.lit("c"))
        .otherwise(F.lit("P"))
    )
    data = F.regexp_replace(group(strip(raw), K.DATA_IMAGE, 3), F.lit("[\n\r ]"), F.lit(""))
    image = F.when(
        has_data_image & s.rlike(K.DATA_IMAGE_HINT),
        F.when(F.length(data) >= 4, F.lit("I")).when(strip(raw).rlike(K.DATA_IMAGE_OPEN), F.lit("J")),
    )
    bullet_raw, bullet = raw.rlike(K.BULLET), s.rlike(K.BULLET)
    number_raw, number = raw.rlike(K.NUMBERED), s.rlike(K.NUMBERED)
    marked = F.coalesce(
        F.when(s == "---", F.lit("-")).when(s == "## ---", F.lit("=")),
        F.when(s.startswith("`") & s.rlike(K.FENCE), F.lit("F")),
        F.when(s.startswith("$"), F.when(s.rlike(K.MATH_LINE), F.lit("L")).when(s.rlike(K.MATH_FENCE), F.lit("M"))),
        image,
        F.when(s.startswith("|"), F.lit("T")),
        F.when(
            s.startswith("#"),
            F.when(s.rlike(r"(?Ud)^#\s+.+$"), F.lit("1"))
            .when(s.rlike(r"(?Ud)^##\s+.+$"), F.lit("2"))
            .when(s.rlike(r"(?Ud)^###\s+.+$"), F.lit("3"))
            .when(s.rlike(r"(?Ud)^####\s+.+$"), F.lit("4")),
        ),
        F.when(s.startswith("**") & s.rlike(K.BOLD_NUMBER), F.lit("W")),
        F.when(s.startswith(">") & s.rlike(K.QUOTE), F.lit("Q")),
        F.when(bullet_raw, F.when(bullet, F.lit("B")).otherwise(F.lit("x"))),
        F.when(
            number_raw,
            F.when(~number, F.lit("y")).when(is_numbered_title(s), F.lit("h")).otherwise(F.lit("N")),
        ),
        F.when(s.startswith("!") & s.rlike(K.IMAGE), F.lit("G")),
        F.when(bullet | number, F.lit("p")),
        prose,
    )
    region = (
        F.when(F.ltrim(raw, F.lit(K.WHITESPACE)).startswith("|"), F.lit("S"))
        .when(strip(raw).rlike(K.QUOTE), F.lit("U"))
        .when(strip(raw).rlike(K.FENCE), F.lit("V"))
        .otherwise(F.lit("R"))
    )
    return (
        F.when(s == "", F.lit("E"))
        .when(keyword, region)
        .when(s.rlike(r"(?U)^[-#`$!|*>\d]"), marked)
        .otherwise(prose)
    )


def has_keyword(s: Column) -> Column:
    """Does a text hold a reference keyword?  Plain searches beat one regex here."""
    return let(
        F.lower(s),
        lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in K.REFERENCE_KEYWORDS]),
    )


def lines_before_keyword(text: Column) -> Column:
    """Number of lines before the first reference keyword; null without one."""

    def before(low: Column) -> Column:
        first = F.array_min(F.array(*[F.when(F.contains(low, F.lit(w)), F.instr(low, w)) for w in K.REFERENCE_KEYWORDS]))
        return let(F.left(low, first), lambda head: F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))))

    return let(F.lower(text), before)


def line_classes(text: Column, lines: Column, skipped: Column, strict: bool = False) -> Column:
    """Array of one-character classes, one per line; ``lines`` are those of ``text`` after its first ``skipped``.

    What a document cannot contain is found once and not looked for per line, nor are reference keywords before the first
    one of the text. Only where an anchor is taken out of a line can a keyword appear that the text does not hold.
    """
    flags = F.struct(
        F.contains(text, F.lit(";base64,")).alias("image"),
        F.contains(F.lower(text), F.lit("<a")).alias("anchor"),
        (F.coalesce(lines_before_keyword(text), F.lit(2147483647)) - skipped).alias("quiet"),
    )

    def line(x: Column, i: Column, f: Column) -> Column:
        anchored = f["anchor"] & F.contains(x, F.lit("<")) & F.contains(F.lower(x), F.lit("<a"))
        return F.struct(
            x.alias("raw"),
            F.when(anchored, strip(strip_anchors(strip(x)))).otherwise(strip_bound(x)).alias("s"),
            ((i >= f["quiet"]) | anchored).alias("may_open"),
        )

    return let(
        flags,
        lambda f: F.transform(
            F.transform(lines, lambda x, i: line(x, i, f)),
            lambda p: _class_of(p["raw"], p["s"], f["image"], p["may_open"], strict),
        ),
    )


def frontmatter_close(lines: Column) -> Column:
    """1-based position (after line 0) of the closing ``---``; 0 = no block."""
    rest = F.transform(F.slice(lines, F.lit(2), F.size(lines)), strip_bound)
    return F.when(
        strip(F.get(lines, F.lit(0))) == "---", F.array_position(rest, "---").cast("int")
    ).otherwise(F.lit(0))


def frontmatter_body_ok(body: Column) -> Column:
    """Does the block between the rules look like ``key: value`` metadata?"""
    def check(s: Column) -> Column:
        value = strip(F.regexp_replace(s, F.lit("^[^:]*:"), F.lit("")))
        pair = s.rlike(K.FRONTMATTER_PAIR)
        return F.struct(
            pair.alias("pair"),
            (
                s.rlike(r"(?U)^#{1,6}\s+")
                | F.contains(s, F.lit("**"))
                | (pair & (F.length(value) > 120))
                | (~pair & (F.length(s) > 120) & ~F.contains(s, F.lit(":")))
            ).alias("prose"),
        )

    return let(
        F.transform(body, strip),
        lambda t: let(
            F.transform(t, check),
            lambda c: F.exists(c, lambda v: v["pair"])
            & ~F.exists(c, lambda v: v["prose"])
            & ~F.contains(
                F.concat(F.lit("\n"), F.array_join(t, "\n"), F.lit("\n")), F.lit("\n\n\n")
            ),
        ),
    )


def frontmatter_length(lines: Column) -> Column:
    """Number of leading lines that form a valid metadata block (0 = none)."""
    return let(
        frontmatter_close(lines),
        lambda p: F.when(
            (p > 0) & frontmatter_body_ok(F.slice(lines, F.lit(2), F.greatest(p - 1, F.lit(0)))),
            p + 1,
        ).otherwise(F.lit(0)),
    )


def block_spans(text: Column, strict: bool = False) -> Column:
    """Blocks of a document: ``array<struct<code, start_line, n_lines, lines>>``.

    ``start_line`` counts from the first line of the text, metadata block included.
    """
    def with_lines(lines: Column) -> Column:
        return let(
            frontmatter_length(lines),
            lambda fm: let(
                F.slice(lines, fm + 1, F.greatest(F.size(lines) - fm, F.lit(0))),
                lambda body: let(
                    F.array_join(line_classes(text, body, fm, strict), ""),
                    lambda cls: _cut(cls, body, fm),
                ),
            ),
        )

    return let(split_lines(text), with_lines)


def _cut(cls: Column, body: Column, offset: Column) -> Column:
    # '~' in front of every block; its positions give all start lines in one pass
    marked = F.split(F.regexp_replace(cls, F.lit(BLOCKS), F.lit("~$0")), "")
    marks = F.filter(
        F.transform(marked, lambda ch, i: F.when(ch == "~", i)), lambda i: i.isNotNull()
    )
    starts = F.transform(marks, lambda p, i: p - i)
    tokens = F.regexp_extract_all(cls, F.lit(BLOCKS), F.lit(0))
    pairs = F.filter(
        F.zip_with(starts, tokens, lambda s, t: F.struct(s.alias("start"), t.alias("token"))),
        lambda z: ~F.contains(F.lit(DROPPED), F.left(z["token"], F.lit(1))),
    )

    def build(z: Column) -> Column:
        start, token = z["start"], z["token"]
        first = F.left(token, F.lit(1))
        wrapped = (first == "J") & token.rlike(f"^{WRAPPED_IMAGE}$")
        code = (
            F.when(F.contains(F.lit(PARAGRAPH_CODES), first) & ~wrapped, F.lit("P"))
            .when(wrapped, F.lit("I"))
            .otherwise(first)
        )
        lines = F.slice(body, start + 1, F.length(token))
        return F.struct(
            F.when(
                (code == "F") & F.startswith(strip(F.get(lines, F.lit(0))), F.lit("```diagram:"))
                & diagram_body_ok(lines),
                F.lit("D"),
            ).otherwise(code).alias("code"),
            (start + offset).cast("int").alias("start_line"),
            F.length(token).cast("int").alias("n_lines"),
            lines.alias("lines"),
        )

    return F.filter(
        F.transform(pairs, build),
        lambda b: (b["code"] != "M") | (strip(F.array_join(fenced_body(b["lines"], K.MATH_FENCE), "\n")) != ""),
    )


def fenced_body(lines: Column, fence: str) -> Column:
    """Lines between an opening fence and its closing fence (or the end)."""
    closed = (F.size(lines) > 1) & strip(F.element_at(lines, -1)).rlike(fence)
    return F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1 - closed.cast("int"), F.lit(0)))


def diagram_body_ok(lines: Column) -> Column:
    """Flat test that a diagram body is a mapping (its YAML is not read further)."""
    body = F.filter(
        fenced_body(lines, K.FENCE),
        lambda x: (strip(x) != "") & ~x.rlike(r"^\s*#") & ~x.rlike(r"^(?:\s|-\s)"),
    )
    return (F.size(body) > 0) & F.forall(body, lambda x: x.rlike(r"(?Ud)^[^\s:][^:]*:(?:\s|$)"))
