"""Number plates: normal form, registration formats, position-aware correction and similarity."""

from __future__ import annotations

import difflib
import itertools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: State and territory codes of Indian registrations.
STATES = (
    "AN", "AP", "AR", "AS", "BR", "CG", "CH", "DD", "DL", "DN", "GA", "GJ", "HP", "HR", "JH", "JK", "KA", "KL", "LA",
    "LD", "MH", "ML", "MN", "MP", "MZ", "NL", "OD", "PB", "PY", "RJ", "SK", "TN", "TR", "TS", "UK", "UP", "WB",
)
#: The two formats, and what readers mix up, by the kind that a position wants.
STANDARD = r"^[A-Z]{2}[0-9]{1,2}[A-Z]{1,3}[0-9]{4}$"
BHARAT = r"^[0-9]{2}BH[0-9]{4}[A-Z]{1,2}$"
TO_DIGIT = {"B": "8", "G": "6", "I": "1", "L": "1", "O": "0", "S": "5", "Z": "2"}
TO_LETTER = {"0": "O", "1": "IL", "2": "Z", "5": "S", "6": "G", "8": "B"}
MOST_CORRECTIONS = 2
#: The formats by position. L: a letter, D: a digit, anything else: itself.
SHAPES = ("LLDLDDDD", "LLDLLDDDD", "LLDLLLDDDD", "LLDDLDDDD", "LLDDLLDDDD", "LLDDLLLDDDD", "DDBHDDDDLL", "DDBHDDDDL")


def normalized(text: Column) -> Column:
    """Upper case without anything but A-Z and 0-9; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.upper(text), "[^A-Z0-9]+", ""), F.lit(""))


def display(text: Column) -> Column:
    return F.nullif(F.upper(F.trim(text)), F.lit(""))


def format_of(plate: Column) -> Column:
    """The format that a normal form has as it stands: standard_private, bharat_series or null."""
    standard = plate.rlike(STANDARD) & F.substring(plate, 1, 2).isin(*STATES)
    return F.when(standard, "standard_private").when(plate.rlike(BHARAT), "bharat_series")


def _format(plate: str) -> str | None:
    if re.fullmatch(STANDARD[1:-1], plate, re.ASCII):
        return "standard_private" if plate[:2] in STATES else None
    return "bharat_series" if re.fullmatch(BHARAT[1:-1], plate, re.ASCII) else None


def corrections(plate: str) -> dict[str, int]:
    """Valid plates that one or two confusable characters away, each with its smallest number of changes."""
    found: dict[str, int] = {}
    for shape in SHAPES:
        if len(shape) != len(plate):
            continue
        choices, fits = [], True
        for char, kind in zip(plate, shape):
            other = TO_LETTER.get(char, "") if kind == "L" and char.isdigit() else TO_DIGIT.get(char, "") if kind == "D" and char.isalpha() else ""
            fits &= kind in "LD" or char == kind
            choices.append(char + other)
        if not fits or sum(len(c) > 1 for c in choices) > MOST_CORRECTIONS:
            continue
        for made in map("".join, itertools.product(*choices)):
            changed = sum(a != b for a, b in zip(made, plate))
            if changed and _format(made):
                found[made] = min(changed, found.get(made, changed))
    return found


@F.pandas_udf(T.StructType([T.StructField("canonical", T.StringType()), T.StructField("corrections", T.IntegerType())]))
def _corrected(plates: pd.Series) -> pd.DataFrame:
    rows = []
    for p in plates:
        found = corrections(p) if p else {}
        rows.append(next(iter(found.items())) if len(found) == 1 else (None, None))
    return pd.DataFrame(rows, columns=["canonical", "corrections"]).astype({"corrections": "Int32"})


def validated(text: Column) -> Column:
    """struct(normalized, canonical, valid, format, corrected, reason). A correction counts if just one plate can be meant.

    The Python correction only sees plates that no format matches; null and empty texts are invalid.
    """
    plain = normalized(text)
    direct = format_of(plain)
    fixed = F.when(direct.isNull() & plain.isNotNull(), _corrected(F.when(direct.isNull(), plain)))
    canonical = F.when(direct.isNotNull(), plain).otherwise(fixed["canonical"])
    kind = F.coalesce(direct, format_of(fixed["canonical"]))
    reason = (
        F.when(plain.isNull(), "empty_normalized_text")
        .when(kind == "standard_private", "validated_standard_state_registration")
        .when(kind == "bharat_series", "validated_bharat_series_registration")
        .otherwise("unsupported_indian_registration_structure")
    )
    return F.struct(
        plain.alias("normalized"), canonical.alias("canonical"), canonical.isNotNull().alias("valid"), kind.alias("format"),
        (direct.isNull() & canonical.isNotNull()).alias("corrected"), reason.alias("reason"),
    )


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts; 0 where one is missing."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)])


def unconfused(plate: Column) -> Column:
    """Digits that look like letters as those letters."""
    return F.translate(plate, "0158", "OISB")


@F.pandas_udf(T.DoubleType())
def weighted_edit_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 - weighted edit distance / longer length; a mix-up of look-alikes costs 0.35, any other edit 1."""
    alike = {frozenset((x, y)) for x, ys in TO_LETTER.items() for y in ys}

    def one(x, y):
        if not x or not y:
            return 0.0
        row = [float(j) for j in range(len(y) + 1)]
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], float(i)
            for j, d in enumerate(y, 1):
                cost = 0.0 if c == d else 0.35 if frozenset((c, d)) in alike else 1.0
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + cost)
        return 1 - row[-1] / max(len(x), len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b)])
