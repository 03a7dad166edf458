"""Significance of a rank correlation."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: longest lists for which the exact distribution is used
EXACT_UP_TO = 33


@lru_cache(maxsize=None)
def _share_up_to(n: int, inversions: int) -> float:
    """Share of the permutations of n items with at most that many inversions."""
    row = [1.0] + [0.0] * inversions
    for size in range(2, n + 1):
        # inserting the size-th item adds 0 .. size-1 inversions, each as likely
        running, new = 0.0, []
        for i in range(inversions + 1):
            running += row[i]
            if i >= size:
                running -= row[i - size]
            new.append(running / size)
        row = new
    return sum(row)


def kendall_p(n: int, discordant: int) -> float | None:
    """Two-sided p-value for n ranks without ties."""
    if n < 2:
        return None
    pairs = n * (n - 1) // 2
    fewer = min(discordant, pairs - discordant)
    if n <= EXACT_UP_TO or fewer <= 1:
        return 1.0 if 2 * fewer == pairs else min(1.0, 2 * _share_up_to(n, fewer))
    spread = math.sqrt(n * (n - 1) * (2 * n + 5) / 18)
    return math.erfc(abs(pairs - 2 * discordant) / spread / math.sqrt(2))


@F.pandas_udf(T.DoubleType())
def _kendall_p(n: pd.Series, discordant: pd.Series) -> pd.Series:
    pairs = pd.DataFrame({"n": n, "d": discordant})
    once = pairs.drop_duplicates()  # lists are short, so a batch has few different pairs
    once = once.assign(p=[kendall_p(int(a), int(b)) for a, b in zip(once.n, once.d)])
    return pairs.merge(once, on=["n", "d"], how="left").p.astype("float64")


def kendall_p_value(n: Column, discordant: Column) -> Column:
    return F.when(n >= 2, _kendall_p(n, discordant))
