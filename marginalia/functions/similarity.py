"""UD-1: Ratcliff/Obershelp similarity. Used only after blocking; equal strings never reach Python."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from marginalia.functions.text import collapse


@pandas_udf(DoubleType())
def matcher_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matcher ratio of two already normalised strings; 0 when either is empty, null stays null."""
    return pd.Series([
        None if a is None or b is None else SequenceMatcher(None, a, b).ratio() if a and b else 0.0
        for a, b in zip(left, right)
    ], dtype="float64")


AUTOJUNK = 200  # fixed value: from this length of the second string on the matcher leaves out frequent characters


def similarity(left: Column, right: Column) -> Column:
    """Similarity of lower-cased, collapsed strings in [0, 1].

    Where one string holds the other, all of the shorter one is matched; where they share no character, nothing is.
    Both ratios are known without the matcher, so such pairs stay in the JVM.
    """
    a = collapse(F.lower(F.coalesce(left, F.lit(""))))
    b = collapse(F.lower(F.coalesce(right, F.lit(""))))
    x, y = F.char_length(a), F.char_length(b)
    some = (a != "") & (b != "")
    inside = some & (y < AUTOJUNK) & (F.contains(a, b) | F.contains(b, a))
    apart = some & (F.call_function("translate", a, b, F.lit("")) == a)
    hard = some & (a != b) & ~inside & ~apart
    # The function sees NULL for rows that need no work.
    ratio = matcher_ratio(F.when(hard, a), F.when(hard, b))
    return F.when(hard, ratio).when(some & (a == b), F.lit(1.0)).when(inside, 2.0 * F.least(x, y) / (x + y)).otherwise(F.lit(0.0))
