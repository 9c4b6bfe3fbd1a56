"""Normalization of whole tables, in the JVM: a gate, whole-text repairs, then spans and prose piece by piece."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import columns as cf
from quillspark.functions import fixed as fx
from quillspark.functions import mathspans
from quillspark.functions.columns import NOT_ASCII

#: What any rewrite needs: one of these, the ones that are found fastest first. A text without all of them is returned as it is.
_TRIGGERS = [
    r"[$\\<(|\x00-\x04]", fx.SIGNALS["adjacent"], r"(?U)[-+*/=^<>]\s*[0-9A-Za-z]", r"[0-9A-Za-z]:[0-9A-Za-z]|[\^_]\{", "sin|cos|tan",
    f"{NOT_ASCII}[☐▢⋯{fx.DOT_ABOVE}{fx.ANY_SYMBOL}]",
]


def may_change(text: Column) -> Column:
    signs = [*(text.rlike(p) for p in _TRIGGERS), *(text.contains(a) for a, _ in fx.TYPOS)]
    return F.coalesce(reduce(lambda a, b: a | b, signs), F.lit(False))


def normalized(text: Column) -> Column:
    """A text with all its mathematics in canonical spans; null stays null."""
    return F.when(may_change(text), mathspans.wrapped(cf.repaired(text))).otherwise(text)


def normalize(docs: DataFrame, text_col: str = "text", out_col: str = "norm_text") -> DataFrame:
    """docs with out_col. Rows are rewritten where they are: nothing is shuffled, and nothing leaves the JVM."""
    return docs.withColumn(out_col, normalized(F.col(text_col)))
