"""The stages of the reading pipeline, as one lazy plan and as a run that can be taken up again: recognise, restore, normalize, speak, lint, judge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import columns as cf
from quillspark.functions.providers import Chat, NoChat, Ocr, RuleSpeech, Speech, TextOcr
from quillspark.operators import dots, lint, normalize, review, speech
from quillspark.plans import runs
from quillspark.sources import files, sinks
from quillspark.tables import saved, shared_dir


def read_aloud(pages: DataFrame, id_col: str, text_col: str, ssml: bool = False, restore_dots: bool = True, **services: object) -> DataFrame:
    """id, content and counters of each page's speech. services: chat for the dots, service for the formulas."""
    known = {k: v for k, v in services.items() if k == "chat"}
    text = dots.restore(pages, id_col, text_col, **known).select(id_col, F.col("patched").alias("text")) if restore_dots else pages.select(id_col, F.col(text_col).alias("text"))
    spoken = {k: v for k, v in services.items() if k == "service"}
    return speech.render(normalize.normalize(text), id_col, "norm_text", ssml, **spoken)


def linted(rendered: DataFrame, id_col: str) -> DataFrame:
    """rendered plus lint (findings of each page) and errors (how many of them are errors)."""
    found = rendered.withColumn("lint", lint.findings(F.col("content")))
    return found.withColumn("errors", F.size(F.filter("lint", lambda x: x["severity"] == "error")))


def golden(cases: DataFrame, **services: object) -> DataFrame:
    """Golden cases (id, input, must, mustnot, known) -> id, status."""
    from quillspark.functions.columns import case_status

    said = read_aloud(cases, "id", "input", restore_dots=False, **services).select("id", F.col("content").alias("said"))
    return cases.join(said, "id").select("id", case_status(F.col("said"), F.col("must"), F.col("mustnot"), F.col("known")).alias("status"))


def review_steps(ocr: Callable[[], Ocr] = TextOcr, chat: Callable[[], Chat] = NoChat, judge: Callable[[], Chat] | None = None, service: Callable[[], Speech] = RuleSpeech, **limits: object) -> list[tuple[str, runs.Step]]:
    """Steps of a review for `runs.work_off`, key `input`: pages, restored (what the judge sees), spoken, reviewed. Without a judge pages are linted alone."""

    def pages(rows: DataFrame) -> DataFrame:
        return files.recognise(rows.select("name", "content"), ocr).select(F.col("stem").alias("input"), F.concat_ws("_", "stem", "page_idx").alias("page"), "page_idx", "text")

    def restored(rows: DataFrame) -> DataFrame:
        done = dots.restore(rows, "page", "text", chat).select("page", "patched", "notes", F.col("error").alias("restore_error"))
        return rows.join(done, "page")

    def spoken(rows: DataFrame) -> DataFrame:
        said = speech.render(normalize.normalize(rows, "patched"), "page", "norm_text", service=service)
        return rows.select("input", "page", "page_idx", F.col("patched").alias("source")).join(said, "page")

    def reviewed(rows: DataFrame) -> DataFrame:
        found = rows.withColumn("lint", lint.findings(F.col("content")))
        none = F.array().cast(f"array<{review.FINDING}>")
        silent = ~review.eligible(F.col("content"))
        idle = found.filter(silent) if judge else found
        idle = idle.withColumns({"judge": none, "judge_error": F.when(silent, "there is no speech")})
        if not judge:
            return idle
        asked = review.judge(found.filter(~silent), "content", "source", judge, **limits)
        return idle.unionByName(asked.withColumnRenamed("findings", "judge"))

    return [("pages", pages), ("restored", restored), ("spoken", spoken), ("reviewed", reviewed)]


def review_inbox(spark: SparkSession, found: DataFrame, folder: str, force: str | None = None, batch: int | None = None, **services: object) -> dict[str, object]:
    """Reviews the files (name, content) that the run's folder has no review of, and writes reports and suggested cases; inputs, errors, warnings, judge_errors, exit_code of this run.

    Two files with one stem are one input, as their pages' names are. What broke off is taken up where a stage's manifest ends; force names the
    step from which on all is done again (pages: recognition too). A run without new files reads manifests alone.
    """
    # names are dealt and read once, apart from what the files hold
    names = saved(found.select("name").distinct().withColumn("input", cf.safe_stem(files.stem_of(F.col("name")))), f"{shared_dir(spark)}/names")
    before = runs.Stage(spark, folder, "reviewed", "input").batches()
    stages = runs.work_off(spark, folder, found.join(names, "name"), "input", review_steps(**services), force, batch, names)
    told = stages["reviewed"]
    fresh = [k for k in told.batches() if k not in before]
    if not fresh:
        return {"inputs": 0, "errors": 0, "warnings": 0, "judge_errors": 0, "exit_code": 0}
    rows = told.rows().filter(F.col("batch").isin(fresh))
    findings = F.concat(F.transform("lint", lambda x: x["severity"]), F.transform("judge", lambda x: x["severity"]))
    of = lambda kind: F.coalesce(F.sum(F.size(F.filter(findings, lambda s: s == kind))), F.lit(0))
    counts = sinks.counted(rows.drop("batch"), f"{folder}/reviews/batch={fresh[-1]}", {"errors": of("error"), "warnings": of("warn"), "judge_errors": F.count("judge_error"), "pages": F.count("*")})
    rows = spark.read.schema(rows.drop("batch").schema).parquet(f"{folder}/reviews/batch={fresh[-1]}")  # what follows reads what was written
    cut = review.report_pieces(rows, "input", "page")
    sinks.table(cut, f"{folder}/reports/batch={fresh[-1]}")
    proposed = rows.select("input", "page", F.explode("judge").alias("f")).filter("f.suggested_case is not null")
    cases = proposed.select(F.col("f.suggested_case.input").alias("case_input"), F.col("f.suggested_case").alias("case"), F.col("f.explanation").alias("why"), F.concat_ws("/", "input", "page").alias("from"))
    sinks.append_once(cases, f"{folder}/suggested", "case_input", fresh[-1])
    return {"inputs": rows.select("input").distinct().count(), "errors": counts["errors"], "warnings": counts["warnings"], "judge_errors": counts["judge_errors"], "exit_code": int(counts["errors"] > 0)}
