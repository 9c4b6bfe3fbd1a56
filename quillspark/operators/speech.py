"""Speech of normalized texts: distinct formulas are spoken once, and joined back into their texts.

Fallbacks of a formula: its segments, the whole, salvaged words, a placeholder. Everything but the speaking
service is column expressions and joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import columns as cf
from quillspark.functions import fixed as fx
from quillspark.functions import speechspans
from quillspark.functions.providers import RuleSpeech, Speech
from quillspark.tables import saved, shared_dir

def speak(latex: DataFrame, combos: list[tuple[str, str]], ssml: bool = False, service: Callable[[], Speech] = RuleSpeech) -> DataFrame:
    """latex x (domain, style) -> latex, domain, style, speech, error. The service is made once for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = service()
        for pdf in batches:
            rows = []
            for x, domain, style in zip(pdf["latex"], pdf["domain"], pdf["style"], strict=True):
                try:
                    rows.append((x, domain, style, own.speak(x, domain, style, ssml), None))
                except Exception as e:
                    rows.append((x, domain, style, None, str(e)))
            yield pd.DataFrame(rows, columns=["latex", "domain", "style", "speech", "error"])

    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("domain"), F.lit(s).alias("style")) for d, s in combos))).alias("c")
    done = latex.select("latex", pairs).select("latex", "c.*").mapInPandas(run, "latex string, domain string, style string, speech string, error string")
    return done.withColumn("speech", cf.fix_misreads(F.col("speech")))


def flagged(speech: DataFrame) -> DataFrame:
    """Formulas that failed or came out empty in some combination, with these combinations."""
    bad = F.col("error").isNotNull() | (F.trim(F.coalesce("speech", F.lit(""))) == "")
    return speech.filter(bad).groupBy("latex").agg(F.array_sort(F.collect_set(F.concat_ws("/", "domain", "style"))).alias("combos"))


def render(docs: DataFrame, id_col: str, text_col: str, ssml: bool = False, voice: str = fx.VOICES[0], alt_voice: str = fx.VOICES[1], service: Callable[[], Speech] = RuleSpeech, combo: tuple[str, str] = ("clearspeak", "default")) -> DataFrame:
    """id, content, spans, ok, salvaged, unsupported, xml_error. Null texts are empty.

    Texts are cut into parts once, and the parts are a table that all that follows reads. Only the service needs Python.
    """
    at = shared_dir(docs.sparkSession)
    parts = docs.select(id_col, F.posexplode_outer(speechspans.parts(cf.strip(F.coalesce(F.col(text_col), F.lit(""))))).alias("idx", "p")).select(id_col, "idx", F.col("p.kind").alias("kind"), F.col("p.body").alias("body"))
    parts = saved(parts, f"{at}/parts")
    formulas = parts.filter("kind = 'latex'").select(F.col("body").alias("latex")).distinct()
    cut = formulas.withColumn("segs", speechspans.segments(F.col("latex"), ssml))
    wanted = cut.select("latex").union(cut.select(F.explode("segs").alias("s")).filter("s.kind <> 'text'").select("s.body")).distinct()
    said = speak(wanted, [combo], ssml, service).select(F.col("latex").alias("of"), "speech")

    def clean(c: Column) -> Column:
        return cf.ssml_inner(c) if ssml else cf.strip(c)

    def heard(c: Column) -> Column:
        return F.coalesce(cf.strip(c), F.lit("")) != ""

    esc = cf.escape_xml if ssml else (lambda c: c)
    one = cut.select("latex", F.posexplode("segs").alias("k", "s")).join(said, F.col("s.body") == F.col("of"), "left")
    piece = F.when(F.col("s.kind") == "text", F.concat(F.lit(" "), esc(F.col("s.body")), F.lit(" "))).when(heard(F.col("speech")), F.when(F.col("s.kind") == "root", F.concat(F.lit(f" {fx.ROOT_WORD} \x01"), clean(F.col("speech")), F.lit("\x02 "))).otherwise(F.concat(F.lit(" "), clean(F.col("speech")), F.lit(" "))))
    one = one.groupBy("latex").agg(F.array_sort(F.collect_list(F.struct("k", piece.alias("t")))).alias("ps"), F.bool_or(F.col("s.kind") != "latex").alias("special"))
    by_parts = F.when(F.col("special") & ~F.exists("ps", lambda x: x["t"].isNull()), F.array_join(F.transform("ps", lambda x: x["t"]), ""))
    whole = one.join(said, F.col("latex") == F.col("of"), "left")
    rest = cf.salvage(F.col("latex"))
    spoken = F.coalesce(by_parts, F.when(heard(F.col("speech")), F.concat(F.lit(" "), clean(F.col("speech")), F.lit(" "))))
    table = whole.select(
        "latex", F.when(spoken.isNotNull(), "ok").when(rest != "", "salvaged").otherwise("unsupported").alias("status"),
        F.coalesce(spoken, F.when(rest != "", F.concat(F.lit(" "), esc(rest), F.lit(" "))), F.concat(F.lit(f" [{fx.UNSUPPORTED}: "), esc(F.col("latex")), F.lit("] "))).alias("words"),
    )
    # only formulas are looked up: prose is never a join's key
    prose = parts.filter("kind is null or kind <> 'latex'").withColumns({c: F.lit(None).cast("string") for c in table.columns})
    rows = parts.filter("kind = 'latex'").join(table, F.col("body") == F.col("latex"), "left").unionByName(prose)
    math = F.col("kind") == "latex"
    out = rows.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct("idx", F.when(math, F.col("words")).otherwise(esc(F.coalesce("body", F.lit("")))).alias("t")))).alias("ts"),
        F.count_if(math).alias("spans"), *(F.count_if(math & (F.col("status") == s)).alias(s) for s in ("ok", "salvaged", "unsupported")),
    )
    content = F.trim(F.regexp_replace(F.array_join(F.transform("ts", lambda x: x["t"]), ""), " +", " "))
    if ssml:
        a, b, c = fx.ENVELOPE
        for mark, who in (("\x01", alt_voice), ("\x02", voice)):
            content = F.replace(content, F.lit(mark), F.lit(f'</voice><voice name="{who}">'))
        content = F.regexp_replace(F.concat(F.lit(a + voice + b), content, F.lit(c)), r'<voice name="[^"]*">\s*</voice>', "")
    out = out.select(id_col, content.alias("content"), "spans", "ok", "salvaged", "unsupported")
    return out.withColumn("xml_error", speechspans.markup_error(F.col("content")) if ssml else F.lit(None).cast("string"))


def counters() -> dict[str, Column]:
    """What a run counts: aggregates of rendered texts, for totals() or while they are written (`sinks.counted`)."""
    return {c: F.coalesce(F.sum(c), F.lit(0)) for c in ("spans", "ok", "salvaged", "unsupported")} | {"bad_xml": F.count_if(F.col("xml_error").isNotNull())}


def totals(rendered: DataFrame) -> DataFrame:
    """Counters over all documents; failures decide the exit code of a strict run."""
    sums = rendered.agg(*(c.alias(n) for n, c in counters().items()))
    failures = F.col("salvaged") + F.col("unsupported") + F.col("bad_xml")
    return sums.withColumn("failures", failures).withColumn("exit_code", F.when(failures > 0, 2).otherwise(0))


def mathml(formulas: DataFrame, provider: Callable[[], object], latex_col: str = "latex") -> DataFrame:
    """latex, mathml, error: each distinct formula once; what a converter raises, or marks as an error in its answer, is an error. Null formulas are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        converter = provider()
        for pdf in batches:
            out = []
            for latex in pdf["latex"]:
                try:
                    found = converter.convert(latex)
                    out.append((latex, None, "marked as an error") if "<merror" in found else (latex, found, None))
                except Exception as x:
                    out.append((latex, None, str(x) or type(x).__name__))
            yield pd.DataFrame(out, columns=["latex", "mathml", "error"])

    return formulas.select(F.col(latex_col).alias("latex")).filter("latex is not null").distinct().mapInPandas(run, "latex string, mathml string, error string")
