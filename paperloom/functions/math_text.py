"""Readable Unicode text of a LaTeX expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import any_of, let, strip, sub

TEXT_COMMAND = r"\\(?:text|mathrm|operatorname)\{([^{}]*)\}"
FRACTION = r"(?U)\\frac\s*\{([^{}]+)\}\s*\{([^{}]+)\}"


def _unwrap(c: Column) -> Column:
    return sub(sub(c, TEXT_COMMAND, "$1"), FRACTION, "($1 / $2)")


def latex_to_text(c: Column) -> Column:
    """Unwrap commands and fractions to a fixed point, then replace signs."""
    # every useful pass removes one '{', so their number bounds the passes
    steps = F.sequence(F.lit(1), F.length(c) - F.length(F.replace(c, F.lit("{"), F.lit(""))) + 1)

    def step(state: Column, _: Column) -> Column:
        # after a pass that changes nothing, nothing is tried any more
        once = let(_unwrap(state["text"]), lambda t: F.struct(t.alias("text"), (t == state["text"]).alias("done")))
        return F.when(state["done"], state).otherwise(once)

    plain = F.when(
        F.contains(c, F.lit("{")),
        let(strip(c), lambda t: F.aggregate(steps, F.struct(t.alias("text"), F.lit(False).alias("done")), step)["text"]),
    ).otherwise(strip(c))
    # commands end before a letter, so their order does not matter
    plain = reduce(
        lambda acc, kv: sub(acc, any_of([kv[0]]) + "(?![A-Za-z])", kv[1]), K.MATH_SIGNS.items(), plain
    )
    return strip(sub(F.translate(plain, "{}", ""), r"(?U)[\s\x1c-\x1f]+", " "))
