"""Metric assignments, formatting and the values a training log reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslab.functions.text import strip

# Category names as published (fixed values).
CATEGORY_LABELS = {
    "api": "API model",
    "api_skill": "API model + skill",
    "local_finetuned": "Local fine-tune",
    "local_base": "Local base",
}

# Patterns of a training log, in order of preference (fixed values).
NUMBER = "([0-9]+(?:\\.[0-9]+)?)"
LOSS_PATTERNS = (f"(?i)\\btest loss\\b[:=]?\\s*{NUMBER}", f"(?i)\\bloss\\b[:=]?\\s*{NUMBER}")
PERPLEXITY_PATTERNS = (f"(?i)\\bperplexity\\b[:=]?\\s*{NUMBER}", f"(?i)\\bppl\\b[:=]?\\s*{NUMBER}")
VALIDATION_LOSS = f"(?i)Iter\\s+(\\d+):\\s+Val loss\\s+{NUMBER}"


def category_label(c: Column) -> Column:
    label = c
    for key, text in CATEGORY_LABELS.items():
        label = F.when(c == key, F.lit(text)).otherwise(label)
    return label


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def half_even(value: Column, places: int) -> Column:
    """``value`` as text with ``places`` decimals, its exact binary value rounded half to even.

    A double below 2**53 / 10**places is split exactly: whole part, then the fraction times 10**places as a product.
    Where the product lies on a half, its rounding error (found with Dekker's split of the factors) says on which side
    the exact value is. Larger values hold no such fraction or go through a decimal; those beyond the decimal are shown
    as doubles.
    """
    scale, one = 10**places, F.lit(10**places).cast("bigint")

    def error(fraction: Column, product: Column) -> Column:
        wide = fraction * F.lit(134217729.0)
        high = wide - (wide - fraction)
        return (high * F.lit(float(scale)) - product) + (fraction - high) * F.lit(float(scale))

    def digits(fraction: Column, product: Column) -> Column:
        # A product that rounded up to a whole number belongs just below it, where the half is far away.
        base = F.floor(product)
        side = _bound(error(fraction, product), lambda e: (e > 0) | ((e == 0) & (base % 2 == 1)))
        rest = product - base
        return base + F.when(rest > 0.5, 1).when(rest < 0.5, 0).when(side, 1).otherwise(0)

    def text(total: Column) -> Column:
        return F.concat(F.call_function("div", total, one).cast("string"), F.lit("."), F.lpad((total % one).cast("string"), places, "0"))

    def shown(size: Column) -> Column:
        total = _bound(size - F.floor(size), lambda f: _bound(f * F.lit(float(scale)), lambda p: F.floor(size) * one + digits(f, p)))
        return _bound(total, text)

    sign = F.when((value < 0) | (value.cast("string") == "-0.0"), F.lit("-")).otherwise(F.lit(""))
    large = F.coalesce(value.try_cast(f"decimal(38,{places})").cast("string"), value.cast("string"))
    return F.when(F.abs(value) < F.lit(2.0**53 / scale), F.concat(sign, _bound(F.abs(value), shown))).otherwise(large)


def metric_text(value: Column) -> Column:
    """Whole numbers without a point, anything else with six decimals."""
    return F.when(value == F.floor(value), F.coalesce(value.try_cast("decimal(38,0)").cast("string"), value.cast("string"))).otherwise(half_even(value, 6))


def report_text(value: Column) -> Column:
    """Three decimals, or ``n/a`` where there is no value."""
    return F.coalesce(half_even(value, 3), F.lit("n/a"))


# A decimal number as accepted: digits with single underscores between them, a point, an exponent; or a special value.
_DIGITS = "[0-9](?:_?[0-9])*"
NUMBER_FORM = f"(?i)^[+-]?(?:(?:{_DIGITS}[.]?(?:{_DIGITS})?|[.]{_DIGITS})(?:e[+-]?{_DIGITS})?|inf|infinity|nan)$"


def number(text: Column) -> Column:
    """The double that a text spells, white space around it allowed; null for any other text."""
    bare = strip(text)
    return F.when(bare.rlike(NUMBER_FORM), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double"))


def parse_assignment(c: Column) -> Column:
    """``struct(name, value, problem)`` of one ``name=value`` text; ``problem`` is null when it is well formed."""
    pieces = F.split(c, "=", 2)
    name = strip(F.get(pieces, F.lit(0)))
    raw = F.get(pieces, F.lit(1))
    value = number(raw)
    problem = (
        F.when(~F.contains(c, F.lit("=")), F.lit("missing ="))
        .when(name == "", F.lit("blank name"))
        .when(value.isNull(), F.lit("not a number"))
    )
    return F.struct(
        F.when(problem.isNull(), name).alias("name"), F.when(problem.isNull(), value).alias("value"), problem.alias("problem")
    )


def _first_number(c: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")).cast("double") for p in patterns])


def test_loss(c: Column) -> Column:
    return _first_number(c, LOSS_PATTERNS)


def test_perplexity(c: Column) -> Column:
    return _first_number(c, PERPLEXITY_PATTERNS)


def last_validation_loss(c: Column) -> Column:
    """``struct(step, loss)`` of the last validation line in a piece of log; null when there is none."""
    step = F.try_element_at(F.regexp_extract_all(c, F.lit(VALIDATION_LOSS), F.lit(1)), F.lit(-1))
    loss = F.try_element_at(F.regexp_extract_all(c, F.lit(VALIDATION_LOSS), F.lit(2)), F.lit(-1))
    return F.when(step.isNotNull(), F.struct(step.cast("bigint").alias("step"), loss.cast("double").alias("loss")))
