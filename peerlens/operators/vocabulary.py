"""Token columns normalised by stemming."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerlens.functions.stem import stem
from peerlens.operators.grouped import as_list
from peerlens.runtime import short_batches, spread


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_lists(lists: pd.Series) -> pd.Series:
    """Each token's stem; the distinct tokens of a batch are stemmed once."""
    known: dict[str, str] = {}

    def one(words) -> list[str]:
        out = []
        for w in () if words is None else words:
            if w is not None and w not in known:
                known[w] = stem(w)
            out.append(known.get(w))
        return [s for s in out if s is not None and len(s) > 1]

    return lists.map(one)


def stem_tokens(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Stem array columns and drop tokens of one character, inside the row: no token is shuffled. NULL gives an empty list."""
    return short_batches(spread(df)).withColumns({c: stem_lists(c) for c in as_list(columns)})
