"""Response parsing: free text -> choice label -> integer code (all JVM-side).

Every function maps ``Column -> Column`` and stays inside whole-stage codegen.
``strict=True`` reproduces the evaluated harness's hard failures (it raised on an
unexpected label) with ``raise_error``; the default is lenient: unexpected
labels become the invalid code and are counted by the metrics.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalframe.constants import (
    A_B_CODES,
    CHOICE_PATTERN,
    INVALID_CODE,
    INVALID_LABEL,
    NO_GOLD,
    PY_WHITESPACE,
    PY_WHITESPACE_CLASS,
    YES_NO_CODES,
)

# Leading whitespace (as Python's str.strip sees it) followed by the answer
# pattern.  The class cannot match any first character of the pattern, so the
# greedy prefix is exactly a left strip and the match never backtracks.
_ANCHORED_CHOICE = "^" + PY_WHITESPACE_CLASS + "*" + CHOICE_PATTERN


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_text(text: Column | str) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends (G1).

    ``btrim`` with a character set is a linear scan from each end; ``F.trim``
    alone would only remove U+0020.
    """
    return F.btrim(_col(text), F.lit(PY_WHITESPACE))


def extract_choice(text: Column | str) -> Column:
    """Anchored prefix match of a choice label on the stripped text.

    Returns the label (``-1``, ``0``-``5``, ``A``, ``B``, ``yes``, ``no``) or
    ``-100``.  A prefix match: ``12`` -> ``1``, ``no idea`` -> ``no``.
    """
    label = F.regexp_extract(_col(text), _ANCHORED_CHOICE, 1)
    return F.coalesce(F.nullif(label, F.lit("")), F.lit(INVALID_LABEL))


def _code_from_map(parsed: Column, codes: dict[str, int], strict: bool, what: str) -> Column:
    expr = None
    for label, code in codes.items():
        expr = (F.when(parsed == label, F.lit(code)) if expr is None
                else expr.when(parsed == label, F.lit(code)))
    expr = expr.when(parsed == INVALID_LABEL, F.lit(INVALID_CODE))
    if strict:
        return expr.otherwise(F.raise_error(F.concat(F.lit(f"unexpected {what} label: "), parsed)).cast("int"))
    return expr.otherwise(F.lit(INVALID_CODE))


def code_a_b(parsed: Column | str, strict: bool = False) -> Column:
    """``A`` -> 0, ``B`` -> 1, ``-100`` -> -100; other labels invalid."""
    return _code_from_map(_col(parsed), A_B_CODES, strict, "A/B")


def code_yes_no(parsed: Column | str, strict: bool = False) -> Column:
    """``no`` -> 0, ``yes`` -> 1, ``-100`` -> -100; other labels invalid."""
    return _code_from_map(_col(parsed), YES_NO_CODES, strict, "yes/no")


def code_selection(parsed: Column | str) -> Column:
    """Letter and word labels -> -100, numeric labels -> int (G5, G6 lenient)."""
    return F.coalesce(_col(parsed).try_cast("int"), F.lit(INVALID_CODE))


def code_int(parsed: Column | str, strict: bool = False) -> Column:
    """``int(label)`` (G6): strict uses the ANSI cast, which raises on a letter."""
    if strict:
        return _col(parsed).cast("int")
    return code_selection(parsed)


def gold_or_none(correct_ids: Column | str) -> Column:
    """First correct id, ``-1`` for an empty list."""
    return F.coalesce(F.get(_col(correct_ids), 0), F.lit(NO_GOLD)).cast("int")


def gold_first(correct_ids: Column | str, strict: bool = True) -> Column:
    """First correct id; an empty list raises (G8) unless ``strict=False``."""
    first = F.get(_col(correct_ids), 0)
    if strict:
        return F.coalesce(first, F.raise_error(F.lit("empty correct_ids")).cast("int"))
    return F.coalesce(first, F.lit(NO_GOLD))


def gold_label(label: Column | str) -> Column:
    """Integer gold column."""
    return _col(label).cast("int")


def is_invalid(code: Column | str) -> Column:
    return _col(code) == F.lit(INVALID_CODE)
