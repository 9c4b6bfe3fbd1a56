"""Formula spans as rows and arrays, and texts put together again from ordered parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import fixed as fx
from quillspark.functions.columns import strip


def span_array(text: Column, grammar: str = fx.SPEECH_SPAN) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s){grammar}"), 0)


def spans(docs: DataFrame, id_col: str, text_col: str, grammar: str = fx.SPEECH_SPAN) -> DataFrame:
    """One row per span: id, pos (from 0), span."""
    return docs.select(id_col, F.posexplode(span_array(F.col(text_col), grammar)).alias("pos", "span"))


def distinct_spans(text: Column, grammar: str = fx.SPAN) -> Column:
    """Stripped spans, each once, in order of first appearance."""
    return F.array_distinct(F.transform(span_array(text, grammar), strip))


def has_hangul(text: Column) -> Column:
    return text.rlike("[가-힣ᄀ-ᇿ]")


def parts(text: Column, grammar: str = fx.SPAN) -> Column:
    """Spans and the prose between them in order, as (kind, body); bodies put together are the text. Texts must be free of U+0001."""
    cut = F.filter(F.split(F.regexp_replace(text, f"(?s)({grammar})", "\u0001$1\u0001"), "\u0001"), lambda p: p != "")
    return F.transform(cut, lambda p: F.struct(F.when(p.rlike(f"(?s)^(?:{grammar})$"), F.lit("latex")).otherwise(F.lit("prose")).alias("kind"), p.alias("body")))


def stitch(rows: DataFrame, by: str, order: str, text: Column) -> DataFrame:
    """by, stitched: the texts in order, runs of spaces as one, trimmed of spaces."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda x: x["t"]), "")
    return rows.groupBy(by).agg(F.trim(F.regexp_replace(joined, " +", " ")).alias("stitched"))
