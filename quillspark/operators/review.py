"""Relational steps of a review: resuming, joining sources, judging findings, suggesting cases, scoring, reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import columns as cf
from quillspark.functions.calls import AT_ONCE, DEADLINE, asked, in_order
from quillspark.functions.providers import Chat
from quillspark.operators import ordered

CASE = "struct<id:string,input:string,must:array<string>,mustnot:array<string>>"
FINDING = f"struct<category:string,severity:string,speech_quote:string,source_quote:string,correct_reading:string,explanation:string,suggested_case:{CASE}>"


def unreviewed(inputs: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Inputs without a result, or all when forced."""
    return inputs if force else inputs.join(done.select(key).distinct(), key, "left_anti")


def reusable(pages: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Cached pages whose input was finished."""
    return pages.join(done.select(key).distinct(), key, "left_semi")


def with_source(speech: DataFrame, sources: DataFrame, key: str, text_col: str, out_col: str = "source_text") -> DataFrame:
    """Each speech row with its source's text, empty where there is none."""
    return speech.join(sources.select(key, F.col(text_col).alias(out_col)), key, "left").withColumn(out_col, F.coalesce(out_col, F.lit("")))


def valid_findings(items: Column, speech: Column) -> Column:
    """Findings with an explanation whose quotes the speech contains; odd severities are warnings, incomplete cases null."""

    def text(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    def some(c: Column) -> Column:
        return F.coalesce(F.size(c), F.lit(0)) > 0

    kept = F.filter(items, lambda f: (text(f["explanation"]) != "") & speech.contains(text(f["speech_quote"])))
    return F.transform(kept, lambda f: F.struct(
        F.coalesce(f["category"], F.lit("other")).alias("category"), F.when(f["severity"].isin("error", "warn"), f["severity"]).otherwise("warn").alias("severity"),
        *(text(f[c]).alias(c) for c in ("speech_quote", "source_quote", "correct_reading", "explanation")),
        F.when((text(f["suggested_case"]["id"]) != "") & (text(f["suggested_case"]["input"]) != "") & (some(f["suggested_case"]["must"]) | some(f["suggested_case"]["mustnot"])), f["suggested_case"]).alias("suggested_case"),
    ))


REPLY = f"findings array<{FINDING}>"


def eligible(speech: Column) -> Column:
    """Whether there is anything to judge: speech that is not blank."""
    return F.coalesce(speech.rlike(r"(?U)[^\s\x1C-\x1F]"), F.lit(False))


JUDGE = 'Compare the source with the speech made of it. Report what a listener would miss or misunderstand, with exact quotes. Answer with JSON: {"findings": [{"category": "", "severity": "error or warn", "speech_quote": "", "source_quote": "", "correct_reading": "", "explanation": "", "suggested_case": null}]}'


def judge(pages: DataFrame, speech_col: str, source_col: str, chat: Callable[[], Chat], at_once: int = AT_ONCE, deadline: float = DEADLINE, **retry: object) -> DataFrame:
    """Eligible pages with findings and judge_error, from a judge that is asked about each: some at once in a task, each within the deadline.

    Source and speech are clipped as `columns.clip` does; a page without a source is judged by its speech. What fails, is late or has
    another shape is judge_error, and the page has no findings.
    """
    shown = pages.filter(eligible(F.col(speech_col))).withColumn("_asked", F.concat(
        F.lit("SOURCE:\n"), F.when(F.coalesce(F.col(source_col), F.lit("")) == "", "(none)").otherwise(cf.clip(F.col(source_col), "source")), F.lit("\n\nSPEECH:\n"), cf.clip(F.col(speech_col), "speech"),
    ))

    @F.pandas_udf("reply string, error string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        service = chat()
        for texts in batches:
            done = in_order((lambda t=t: json.dumps(asked(service, JUDGE, t, **retry)) for t in texts), at_once, deadline)
            yield pd.DataFrame(list(done), columns=["reply", "error"])

    told = judged(shown.withColumn("_told", ask("_asked")).withColumn("_reply", F.col("_told.reply")), speech_col, "_reply")
    return told.withColumn("judge_error", F.coalesce("_told.error", "judge_error")).drop("_asked", "_told", "_reply")


def judged(pages: DataFrame, speech_col: str, reply_col: str) -> DataFrame:
    """Eligible pages with findings, the valid ones of a judge's JSON reply, and judge_error, which says that the reply isn't of the shape asked for.

    Pages without speech are left out, as the judge never sees them. Such a reply has no findings.
    """
    reply = F.from_json(F.col(reply_col), REPLY, {"mode": "PERMISSIVE"})
    shaped = F.coalesce(F.regexp_like(F.col(reply_col), F.lit(r"(?s)^\s*\{.*\}\s*$")), F.lit(False)) & reply["findings"].isNotNull()
    asked = pages.filter(eligible(F.col(speech_col)))
    none = F.array().cast(f"array<{FINDING}>")
    return asked.withColumns({"findings": valid_findings(F.when(shaped, reply["findings"]).otherwise(none), F.col(speech_col)), "judge_error": F.when(~shaped, "the reply is no JSON object with findings")})


def case_score(before: Column, after: Column, expected: Column, known: Column) -> Column:
    """How a dot case came out: status, and true and false positives and false negatives, which known cases don't count in.

    What counts as applied are the dotted numbers of the patched text that the text hadn't.
    """
    got = F.array_except(cf.dotted_numbers(after), cf.dotted_numbers(before))
    counts = set_score(expected, got)
    good = (counts["fp"] == 0) & (counts["fn"] == 0)
    status = F.when(known.isNotNull(), "known").when(good, "ok").otherwise("failed")
    return F.struct(status.alias("status"), *(F.when(known.isNull(), counts[c]).otherwise(0).alias(c) for c in ("tp", "fp", "fn")))


def fresh_suggestions(proposed: DataFrame, known: list[DataFrame], order: str, input_col: str = "input") -> DataFrame:
    """The first proposal of each input that none of the known tables has."""
    seen = known[0].select(input_col)
    for k in known[1:]:
        seen = seen.union(k.select(input_col))
    # a minimum is combined before the shuffle, so a proposal that many make is one row of each task
    first = proposed.groupBy(F.col(input_col).alias("_input")).agg(F.min(F.struct(F.col(order).alias("_order"), F.struct(*proposed.columns).alias("_row"))).alias("_first"))
    return first.select("_first._row.*").join(seen.distinct(), input_col, "left_anti").select(*proposed.columns)


def set_score(truth: Column, got: Column) -> Column:
    """True and false positives and false negatives of two arrays taken as sets."""
    return F.struct(F.size(F.array_intersect(truth, got)).alias("tp"), F.size(F.array_except(got, truth)).alias("fp"), F.size(F.array_except(truth, got)).alias("fn"))


def micro_totals(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums of tp, fp, fn with precision and recall, null where they have no denominator."""
    sums = scores.groupBy(*(by or [])).agg(*(F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")))
    return sums.withColumn("precision", F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).withColumn("recall", F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)))


def stage_scores(scores: DataFrame, page: str, by: list[str], stages: tuple[str, str] = ("before", "after")) -> DataFrame:
    """Scores of two stages side by side, for each page, each group and in total, from one pass over rows (page, by, stage, tp, fp, fn).

    tp, fp, fn, precision and recall of both stages (null without a denominator), `level` (page, group or total), and whether the
    second stage failed: it has a false positive or negative. Keys that a level sums over are null there.
    """
    first, last = stages
    sums = [F.coalesce(F.sum(F.when(F.col("stage") == s, F.col(c))), F.lit(0)).cast("long").alias(f"{s}_{c}") for s in stages for c in ("tp", "fp", "fn")]
    level = F.when(F.grouping(page) == 0, "page").when(F.grouping(by[0]) == 0, "group").otherwise("total")
    out = scores.groupingSets([[*by, page], by, []], *by, page).agg(*sums, level.alias("level"))
    for s in stages:
        tp = F.col(f"{s}_tp")
        out = out.withColumns({f"{s}_precision": tp / F.nullif(tp + F.col(f"{s}_fp"), F.lit(0)), f"{s}_recall": tp / F.nullif(tp + F.col(f"{s}_fn"), F.lit(0))})
    return out.withColumn("failed", F.col(f"{last}_fp") + F.col(f"{last}_fn") > 0)


def _page_body(page: str) -> Column:
    """A page's part of a report: its lines, or that it is clean."""

    def quoted(label: str, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"\n    - {label}: '"), c, F.lit("'"))).otherwise(F.lit(""))

    error = F.when(F.coalesce("judge_error", F.lit("")) != "", F.array(F.concat(F.lit("- JUDGE ERROR: "), F.col("judge_error")))).otherwise(F.array().cast("array<string>"))
    lints = F.transform("lint", lambda x: F.concat(F.lit("- lint ["), x["severity"], F.lit("] "), x["detector"], F.lit(": "), x["evidence"]))
    judged = F.transform("judge", lambda f: F.concat(F.lit("- judge ["), f["severity"], F.lit("] "), f["category"], F.lit(": "), f["explanation"], quoted("speech", f["speech_quote"]), quoted("source", f["source_quote"]), quoted("should say", f["correct_reading"])))
    lines = F.concat(error, lints, judged)
    return F.concat(F.lit("## "), F.col(page), F.lit("\n"), F.array_join(F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit("- clean"))), "\n"), F.lit("\n"))


def report(pages: DataFrame, by: str, page: str) -> DataFrame:
    """A Markdown report for each input, in one row. pages: by, page, lint (array of detector, severity, evidence), judge (array of findings), judge_error."""
    return pages.select(by, page, _page_body(page).alias("body")).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, "body"))), lambda x: x["body"]), "\n").alias("report"))


def carry_down(rows: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """Blank cells take the value above them, in each group, or (by empty) over one order of all rows."""
    if by:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({c: F.last(F.nullif(F.col(c), F.lit("")), ignorenulls=True).over(w) for c in columns})
    blank = rows.withColumnsRenamed({c: f"{c}_cell" for c in columns})
    return ordered.carried(blank, [], [order], {c: F.nullif(F.col(f"{c}_cell"), F.lit("")) for c in columns}).select(*rows.columns)


def report_pieces(pages: DataFrame, by: str, page: str) -> DataFrame:
    """The report of `report` in a piece for each page: by, page, piece, offset. An input with any number of pages is in no single row."""
    body = pages.select(by, page, _page_body(page).alias("body"))
    first = ordered.carried(body, [by], [page], {"_before": F.lit(True)}, before=True)
    cut = first.select(by, page, F.concat(F.when(F.col("_before").isNull(), "").otherwise("\n"), "body").alias("piece"), F.col("_pos").alias("_row"))
    return ordered.summed(cut, [by], [page, "_row"], {"offset": F.length("piece")}).select(by, page, "piece", "offset")
