"""Trigram similarity of names, as Arrow functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

_WORD = re.compile(r"[^\W_]+")


def trigrams(text: str) -> list[str]:
    """Trigrams of each lower-cased word, padded by two spaces before and one after, in order."""
    return [p[i : i + 3] for w in _WORD.findall(text.lower()) for p in [f"  {w} "] for i in range(len(p) - 2)]


def similarity(a: str, b: str) -> float:
    x, y = set(trigrams(a)), set(trigrams(b))
    return len(x & y) / len(x | y) if x | y else 0.0


def word_similarity(a: str, text: str) -> float:
    """Greatest Jaccard similarity of the trigrams of a with those of any stretch of text."""
    own, other = set(trigrams(a)), trigrams(text)
    best = 0.0
    for i in range(len(other)):
        if other[i] not in own:  # a best stretch begins and ends with a shared trigram
            continue
        seen: set[str] = set()
        for t in other[i:]:
            seen.add(t)
            common = len(own & seen)
            best = max(best, common / (len(own) + len(seen) - common))
            if len(seen) > len(own) / max(best, 1e-9) + 1:
                break
    return best


@F.pandas_udf(DoubleType())
def word_similarity_udf(a: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([word_similarity(x or "", t or "") for x, t in zip(a, text)])


@F.pandas_udf(ArrayType(StringType()))
def trigrams_udf(text: pd.Series) -> pd.Series:
    """The different trigrams of a text."""
    return pd.Series([sorted(set(trigrams(t or ""))) for t in text])
