"""Folders of documents, images and truth files as DataFrames. Listing and reading are Spark's, so any file system will do."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import columns as cf
from quillspark.functions.providers import Ocr, Renderer, SplitRenderer, TextOcr

BINARY = "path string, modificationTime timestamp, length long, content binary"


def name_of(path: Column) -> Column:
    return F.url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))


def stem_of(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def images(spark: SparkSession, folder: str, pdf: bool = False) -> DataFrame:
    """path, name, content of images (and PDFs) of a folder. Rows are in no order; `listed` gives one."""
    found = spark.read.format("binaryFile").load(folder).select("path", name_of(F.col("path")).alias("name"), "content")
    keep = cf.is_image(F.col("name"))
    return found.filter(keep | F.lower("name").endswith(".pdf") if pdf else keep)


def listed(found: DataFrame) -> DataFrame:
    """Files of a folder in the order of their names."""
    return found.orderBy("name")


def texts(spark: SparkSession, folder: str, ending: str, but: tuple[str, ...] = ()) -> DataFrame:
    """name, text of whole files whose names have the ending and none of the others."""
    found = spark.read.text(folder, wholetext=True).select(name_of(F.col("_metadata.file_path")).alias("name"), F.col("value").alias("text"))
    out = found.filter(F.col("name").endswith(ending))
    for x in but:
        out = out.filter(~F.col("name").endswith(x))
    return out


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder, ".md", (".norm.md",))


def normalized(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder, ".norm.md")


def cached_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Recognised pages that are neither normalized nor restored ones."""
    return texts(spark, folder, ".md", (".norm.md", ".dots.md"))


def stitched(spark: SparkSession, folder: str, ssml: bool = False) -> DataFrame:
    return texts(spark, folder, ".stitched.ssml" if ssml else ".stitched.txt")


def line(spark: SparkSession, text: str) -> DataFrame:
    """A text from elsewhere, such as standard input, as a table of one row."""
    return spark.range(1).select(F.lit("input").alias("name"), F.lit(text).alias("text"))


CASES = "id string, input string, must array<string>, mustnot array<string>, known string, why string, expect array<struct<number:string,period:string>>"
BROKEN = "_broken"


def _files(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    return spark.read.text(path, wholetext=whole).select(name_of(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("text"))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases of files that hold a JSON array of them each; a file that can't be read gives none, and is in `broken`."""
    return _files(spark, path, True).select(F.explode(F.from_json("text", f"array<struct<{CASES}>>")).alias("c")).select("c.*")


def broken(spark: SparkSession, path: str) -> DataFrame:
    """file, text of files of cases that can't be read."""
    return _files(spark, path, True).filter(F.from_json("text", f"array<struct<{CASES}>>").isNull())


def case_lines(spark: SparkSession, path: str, schema: str = CASES) -> tuple[DataFrame, DataFrame]:
    """Cases as a line each: (those that can be read, file and line of the others). No line but empty ones is lost."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    rows = _files(spark, path, False).filter(cf.strip(F.col("text")) != "").withColumn("c", F.from_json("text", f"{schema}, {BROKEN} string", options))
    readable = F.col("c").isNotNull() & F.col(f"c.{BROKEN}").isNull()
    return rows.filter(readable).select("c.*").drop(BROKEN), rows.filter(~readable).select("file", F.col("text").alias("line"))


def expectations(spark: SparkSession, folder: str) -> DataFrame:
    """name, expected from `<name>.expect` files; neither yes nor no is unknown."""
    return texts(spark, folder, ".expect").select(F.regexp_replace("name", r"\.expect$", "").alias("name"), cf.expectation(F.col("text")).alias("expected"))


def dot_truth(text: Column) -> Column:
    """(number, period) pairs of a truth file; an empty array where it says that there are none."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), cf.strip), lambda x: (x != "") & ~x.startswith("#") & (x != "none"))
    return F.array_distinct(F.transform(lines, lambda x: F.struct(cf.strip(F.split_part(x, F.lit(":"), F.lit(1))).alias("number"), cf.strip(F.regexp_extract(x, ":(.*)$", 1)).alias("period"))))


def dot_truths(spark: SparkSession, folder: str) -> DataFrame:
    """name, truth from `<name>.expect_dots` files. Pages without a file have no row, which isn't an empty truth."""
    return texts(spark, folder, ".expect_dots").select(F.regexp_replace("name", r"\.expect_dots$", "").alias("name"), dot_truth(F.col("text")).alias("truth"))


def settings(lines: DataFrame, line_col: str = "value", order: list[str] | None = None, environment: DataFrame | None = None) -> DataFrame:
    """key, value of KEY=VALUE lines; comments and other lines are left out, quotes around values too.

    With an order of the lines (of files, then in a file) the first of a key counts. environment (key, value) goes before all lines.
    """
    text = cf.strip(F.col(line_col))
    rows = lines.withColumn("_l", text).filter(~F.col("_l").startswith("#") & F.col("_l").contains("="))
    key, value = cf.strip(F.split_part("_l", F.lit("="), F.lit(1))), F.regexp_replace(cf.strip(F.regexp_extract("_l", "(?s)=(.*)$", 1)), "^[\"']+|[\"']+$", "")
    if not order:
        found = rows.select(key.alias("key"), value.alias("value"))
    else:
        found = rows.groupBy(key.alias("key")).agg(F.min_by(value, F.struct(*order)).alias("value"))
    if environment is None:
        return found
    own = environment.select("key", "value")
    return found.join(own, "key", "left_anti").unionByName(own)


def style_table(lines: DataFrame, order: str = "n", line_col: str = "value") -> DataFrame:
    """domain, style of the Korean speech rows of a column-aligned table whose blank cells repeat the cell above."""
    from quillspark.operators.review import carry_down

    cells = F.transform(F.split(line_col, r"\|"), cf.strip)
    rows = lines.filter(F.contains(line_col, F.lit("|")) & ~F.startswith(line_col, F.lit("="))).select(order, cells.alias("c")).filter("size(c) >= 4 and c[0] <> 'locale'")
    rows = rows.select(order, *(F.col("c")[k].alias(x) for k, x in enumerate(("locale", "modality", "domain", "styles"))))
    full = carry_down(rows, [], order, ["locale", "modality", "domain"]).filter("locale = 'ko' and modality = 'speech' and domain is not null")
    return full.select("domain", F.explode(F.split("styles", ",")).alias("s")).select("domain", cf.strip(F.col("s")).alias("style")).filter("style <> ''").distinct()


def page_images(files: DataFrame, dpi: int = 200, renderer: Callable[[], Renderer] = SplitRenderer) -> DataFrame:
    """PDF rows (name, content) -> name, page_no (from 1), content; names carry the page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = renderer()
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                stem = name.rsplit(".", 1)[0].replace(" ", "_")
                pages = own.render(content, dpi)
                yield pd.DataFrame({"name": [f"{stem}_p{k:02d}.png" for k in range(1, len(pages) + 1)], "page_no": range(1, len(pages) + 1), "content": pages})

    return files.select("name", "content").mapInPandas(run, "name string, page_no int, content binary")


def recognise(files: DataFrame, ocr: Callable[[], Ocr] = TextOcr) -> DataFrame:
    """Image rows (name, content) -> name, stem, page_idx (from 0), text. The model is loaded once for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = ocr()
        for pdf in batches:
            rows = [(name, k, t) for name, content in zip(pdf["name"], pdf["content"], strict=True) for k, t in enumerate(own.pages(name, content))]
            yield pd.DataFrame(rows, columns=["name", "page_idx", "text"])

    return files.select("name", "content").mapInPandas(run, "name string, page_idx int, text string").withColumn("stem", cf.safe_stem(stem_of(F.col("name"))))


def joined_pages(pages: DataFrame) -> DataFrame:
    """stem, text: a document's pages in order, blank lines between."""
    return pages.groupBy("stem").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def prefer_restored(pages: DataFrame, restored: DataFrame, key: str) -> DataFrame:
    """Pages with the restored text where there is one."""
    return pages.join(restored.select(key, F.col("text").alias("_r")), key, "left").withColumn("text", F.coalesce("_r", "text")).drop("_r")


