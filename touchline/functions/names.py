"""Column names: snake case without repeats, and joins that tell both sides' columns apart."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def clean_names(names: list[str]) -> list[str]:
    """snake_case names: words split at capitals, other characters as `_`, % as percent, a leading
    digit after x; repeats are numbered _2, _3, ..."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        s = name.replace("'", "").replace("%", "_percent_").replace("#", "_number_")
        s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s)
        s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", s)
        s = re.sub(r"[^A-Za-z0-9]+", "_", s).strip("_").lower() or "x"
        s = f"x{s}" if s[0].isdigit() else s
        seen[s] = n = seen.get(s, 0) + 1
        out.append(s if n == 1 else f"{s}_{n}")
    return out


def with_clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def suffix_join(left: DataFrame, right: DataFrame, on: list[str], suffixes: tuple[str, str], how: str = "left") -> DataFrame:
    """Join on equal columns; columns that both sides have besides get the suffix of their side."""
    both = (set(left.columns) & set(right.columns)) - set(on)
    one = left.withColumnsRenamed({c: c + suffixes[0] for c in both})
    other = right.withColumnsRenamed({c: c + suffixes[1] for c in both})
    return one.join(other, on, how)
