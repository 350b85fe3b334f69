"""Formula text: normalisers, fingerprints, complexity and references to other formulas."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.casts import SPACE, squeeze_space, strip_space
from ledgerlens.operators.barrier import once

# Placeholders of the structural form, and the digest length.
REF_MARK = "BM_REF"
STRING_MARK = "STR"
NAME_MARK = "COL"
NUMBER_MARK = "NUM"
DIGEST_CHARS = 12

# Name of the function by which one formula refers to another; platforms differ, so pass your own.
DEFAULT_REF_TOKEN = "FORMULA_REF"


def changed_if(
    text: Column, test: Callable[[Column], Column], change: Callable[[Column], Column]
) -> Column:
    """The changed text where the test holds, else the text itself; the text is made once."""
    one = F.transform(F.array(text), lambda x: F.when(test(x), change(x)).otherwise(x))
    return F.get(one, F.lit(0))


def masked(text: Column, needs: str, pattern: str, mark: str) -> Column:
    """Matches of the pattern replaced; texts without the part that every match needs are not searched."""
    return changed_if(
        text, lambda x: F.contains(x, F.lit(needs)), lambda x: F.regexp_replace(x, pattern, mark))


def stripped(text: Column) -> Column:
    """White space at the ends removed; only a text with some at an end is searched."""
    ends = lambda x: F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1)))
    return changed_if(text, lambda x: F.rlike(ends(x), F.lit(rf"(?U)[{SPACE}]")), strip_space)


def normalised(text: Column) -> Column:
    """Comments and backticks removed, lower case, white space squeezed."""
    bare = masked(masked(text, "/*", r"(?s)/\*.*?\*/", ""), "--", r"--[^\n]*", "")
    return squeeze_space(F.replace(F.lower(bare), F.lit("`"), F.lit("")))


def structural(out: Column, ref_token: str = DEFAULT_REF_TOKEN) -> Column:
    """A normalised text with references, strings, quoted names and numbers masked.

    Marks are not blank and take the place of something, so the white space stays squeezed.
    """
    token = ref_token.lower()
    out = masked(out, f"{token}(", rf"(?U){re.escape(token)}\(\d+\)", REF_MARK)
    out = masked(out, "'", r"'[^']*'", STRING_MARK)
    out = masked(out, '"', r'"[^"]*"', NAME_MARK)
    # The look-ahead lets the matcher skip everything that is no digit cheaply.
    return F.regexp_replace(out, r"(?U)(?=\d)\b\d+(\.\d+)?\b", NUMBER_MARK)


def digest(text: Column) -> Column:
    return F.left(F.md5(F.encode(text, "UTF-8")), F.lit(DIGEST_CHARS))


def with_fingerprints(
    df: DataFrame, expression: str, ref_token: str = DEFAULT_REF_TOKEN
) -> DataFrame:
    """Add the exact, normalised and structural fingerprints; empty text has none.

    Each form is made once, in its own step, and the next one builds on it.
    """
    text, normal = F.col("__text"), F.col("__normal")
    only = lambda c: F.when(text == "", "").otherwise(digest(c))
    df = once(df, __text=stripped(F.coalesce(expression, F.lit(""))))
    df = once(df, __normal=normalised(text))
    return once(
        df, duplicate_hash=only(text), normalized_hash=only(normal),
        structure_hash=only(structural(normal, ref_token))).drop("__text", "__normal")


def complexity(expression: Column, ref_token: str = DEFAULT_REF_TOKEN) -> Column:
    """Up to 5 points for length, one per reference, one per CASE WHEN."""
    text = F.coalesce(expression, F.lit(""))
    size = F.least(F.floor(F.length(text) / 100), F.lit(5))
    refs = F.regexp_count(text, F.lit(rf"{re.escape(ref_token)}\(\d+\)"))
    cases = F.regexp_count(text, F.lit(r"(?i)CASE\s+WHEN"))
    return (size + refs + cases).cast("int")


def referenced_ids(expression: Column, ref_token: str = DEFAULT_REF_TOKEN) -> Column:
    """Array of formula ids mentioned in the text, in order, repeats kept."""
    found = F.regexp_extract_all(expression, F.lit(rf"{re.escape(ref_token)}\((\d+)\)"), F.lit(1))
    return F.transform(found, lambda x: x.cast("bigint"))


def bare_card_id(card_id: Column) -> Column:
    """`dr:123:456` to `123`; any other id unchanged."""
    return F.when(card_id.startswith("dr:"), F.split(card_id, ":")[1]).otherwise(card_id)


def json_list(text: Column) -> Column:
    """JSON list of ids; anything unreadable is an empty list."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.from_json(text, "array<string>"), none)


def first_names(ids: Column, n: int = 5) -> Column:
    return F.array_join(F.slice(ids, 1, n), ", ")
