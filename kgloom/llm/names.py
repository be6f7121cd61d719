"""Reading of names and packed alias lists."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import folded


def unpack_aliases(packed: str | None) -> list[str]:
    """A list packed as a JSON array, with pipes or with commas; blanks are left out, order and repeats stay."""
    if not packed or not packed.strip():
        return []
    s = packed.strip()
    if s[0] == "[":
        try:
            values = json.loads(s)
            if isinstance(values, list):
                return [str(v) for v in values if v is not None and str(v).strip()]
        except ValueError:
            pass
    return [v.strip() for v in s.split("|" if "|" in s else ",") if v.strip()]


def folded_aliases(name: str | None, packed: str | None) -> list[str]:
    """The distinct folded aliases, blanks and the own name left out, sorted."""
    own = folded(name) if name else None
    return sorted({f for f in map(folded, unpack_aliases(packed)) if f and f != own})


@F.pandas_udf(T.ArrayType(T.StringType()))
def alias_keys(name: pd.Series, packed: pd.Series) -> pd.Series:
    return pd.Series([folded_aliases(n if isinstance(n, str) else None, p if isinstance(p, str) else None) for n, p in zip(name, packed)],
        index=name.index)
