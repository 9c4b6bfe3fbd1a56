"""WARC archives written as plain Spark text files, and read back with boundary-chain verification.

A record is one row of text that begins with the magic line; the writer's line separator is the
empty-line pair that ends a record, so what lands on the shared file system is a WARC/1.1 file.

Reading splits the files at the magic. Every magic is a candidate, also one inside a payload:
  * tasks parse a candidate's header and emit its offset and that of its successor;
  * within a split, chains are contracted: each candidate learns where its chain leaves the split;
  * pointer jumping from each file's start marks the splits' entries that the true chain reaches,
    doubling the jumps in every round, so a file of n splits takes about log2(n) rounds;
  * within the splits, chains from marked entries give the records. All other candidates are payload.
Segments of a record that were cut at a magic inside its payload are put together again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import remove, saved, shared_dir, shuffles_freed
from quillspark.operators.ordered import come_in, with_come_in

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Segments that aren't records, at most, to be broadcast; more are joined.
BROADCAST_ROWS = 200_000


def deduplicated(pages: DataFrame, id_col: str, body_col: str, least_bytes: int) -> DataFrame:
    """pages plus payload_digest, payload_bytes and refers_to: the smallest id of an equal payload, null for that one."""
    known = pages.withColumn("payload_digest", F.sha2(body_col, 256)).withColumn("payload_bytes", F.octet_length(body_col).cast("long"))
    first = known.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min(id_col).alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return known.join(first, "payload_digest", "left").withColumn("refers_to", F.when(F.col("first_id") < F.col(id_col), F.col("first_id"))).drop("first_id")


def _name(c: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 100) -> None:
    """Writes one record per row to text files below path.

    A null body is an empty payload. Equal payloads of at least least_bytes bytes are stored once, with
    the smallest id; the others become revisit records that keep the HTTP header alone. Rows repeating
    that id are all stored. A null id has the name "none". Line breaks in a URL are percent-encoded.
    """
    slim = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(body_col), F.lit("")).alias("body"))
    rows = deduplicated(slim, "id", "body", least_bytes)
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("body")))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nWARC-Record-ID: "), _name(F.col("id")),
        F.lit("\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _name(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    with shuffles_freed(pages.sparkSession):
        rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END).text(path)


def _contract(pdf: pd.DataFrame) -> pd.DataFrame:
    """One split: where each candidate's chain leaves the split. Ascending offsets, so one pass from the end does."""
    pdf = pdf.sort_values("off")
    leave: dict[int, int | None] = {}
    for off, succ in zip(reversed(pdf["off"].tolist()), reversed(pdf["succ"].tolist()), strict=True):
        succ = None if pd.isna(succ) else int(succ)
        leave[off] = leave.get(succ, succ)
    return pd.DataFrame({"file": pdf["file"], "off": pdf["off"], "leave": pd.array([leave[o] for o in pdf["off"]], "Int64")})


def _expand(pdf: pd.DataFrame) -> pd.DataFrame:
    """One split: its candidates on chains that begin at marked ones."""
    pdf = pdf.sort_values("off")
    true: set[int] = set()
    keep = []
    for off, succ, marked in zip(pdf["off"].tolist(), pdf["succ"].tolist(), pdf["marked"].tolist(), strict=True):
        on = bool(marked) or off in true
        if on and not pd.isna(succ):
            true.add(int(succ))
        keep.append(on)
    return pdf.loc[keep, ["file", "off", "succ"]].astype({"succ": "Int64"})


def chain(candidates: DataFrame, at: str) -> DataFrame:
    """Candidates (file, split, off, succ) -> those (file, off, succ) that a file's chain from offset 0 reaches."""
    jumps = saved(candidates.groupBy("file", "split").applyInPandas(_contract, "file string, off long, leave long"), f"{at}/jumps0")
    # only entries of splits matter between splits: file starts, and where a chain comes in
    entries = jumps.filter("off = 0").select("file", "off").union(jumps.select("file", F.col("leave").alias("off")).filter("off is not null")).distinct()
    jumps = saved(jumps.join(entries, ["file", "off"]), f"{at}/jumps1")
    marked, n, k = jumps.filter("off = 0").select("file", "off"), 0, 1
    while True:
        marked = saved(marked.union(marked.join(jumps, ["file", "off"]).select("file", F.col("leave").alias("off")).filter("off is not null")).distinct(), f"{at}/marked{k}")
        before, n = n, marked.count()
        if n == before:
            break
        k += 1
        onward = jumps.select("file", F.col("off").alias("leave"), F.col("leave").alias("then"))
        jumps = saved(jumps.join(onward, ["file", "leave"], "left").select("file", "off", F.col("then").alias("leave")), f"{at}/jumps{k}")
    flagged = candidates.join(marked.withColumn("marked", F.lit(True)), ["file", "off"], "left")
    return flagged.groupBy("file", "split").applyInPandas(_expand, "file string, off long, succ long")


def _header(block: Column, name: str) -> Column:
    return F.regexp_extract(block, rf"(?i)(?:^|\r\n){name}: *([^\r\n]*)", 1)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: file, record_type, record_id, target_uri, payload_digest, refers_to, http_head, payload.

    Records are those that the chain of boundaries from a file's start reaches; a chain ends where no
    magic stands at the expected offset, so what follows damage in a file is not returned.
    The archive is read once, into a table of segments, so the result doesn't depend on settings or executors at
    a later time. No task holds a file: offsets and records are carried over its splits. Payloads of any length are one
    value of a row, as records are. Other files in the folder that aren't text end up as no record. An empty folder of files gives no rows.
    """
    at = shared_dir(spark)
    lines = spark.read.option("lineSep", MAGIC).text(path)
    segments = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_part"), F.monotonically_increasing_id().alias("_pos"))
    # written once: however files are cut later, a segment keeps its number
    segments.write.option("compression", "zstd").parquet(f"{at}/segments")
    segments = spark.read.schema(segments.schema).parquet(f"{at}/segments")
    head = F.substring_index("value", END, 1)
    slim = segments.select(
        "file", "_part", "_pos", F.octet_length("value").cast("long").alias("bytes"),
        F.when(F.contains("value", F.lit(END)), F.octet_length(head) + len(END) + F.expr("try_cast(" + r"regexp_extract(substring_index(value, '\r\n\r\n', 1), '(?i)(?:^|\r\n)Content-Length: *([0-9]+)', 1)" + " as bigint)") + len(END)).alias("needs"),
    )
    # offsets: sums within a split, on what the splits before it have
    slim = saved(slim.withColumn("size", F.col("bytes") + len(MAGIC)), f"{at}/slim")
    before = come_in(slim, ["file"], {"size": F.sum("size")}, {"size": (0, lambda x, p: x + p)})
    within = Window.partitionBy("file", "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum("size").over(within)
    placed = with_come_in(slim.withColumn("end", ends), ["file"], before)
    # a file's first segment stands before its first magic
    placed = placed.withColumn("off", F.col("end") + F.col("_in.size") - F.col("bytes") - 2 * len(MAGIC)).withColumn("succ", F.col("off") + len(MAGIC) + F.col("needs"))
    placed = saved(placed.select("file", "_part", "_pos", "off", "succ"), f"{at}/candidates")
    true = saved(chain(placed.filter("off >= 0").select("file", F.col("_part").alias("split"), "off", "succ"), at), f"{at}/chain")
    # each segment belongs to the record begun last, in its split or in one before
    marked = saved(placed.join(true.select("file", "off", F.col("off").alias("begun")), ["file", "off"], "left"), f"{at}/marked")
    begun = come_in(marked, ["file"], {"begun": F.max("begun")}, {"begun": (None, lambda x, p: F.coalesce(p, x))})
    marked = with_come_in(marked.withColumn("own", F.max("begun").over(within)), ["file"], begun).withColumn("record", F.coalesce("own", "_in.begun"))
    parts = marked.select("file", F.col("_pos").alias("row"), "off", "record")
    several = parts.filter("record is not null").groupBy("file", "record").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    # only what isn't a record by itself needs to be told: cut records, and what no chain reaches
    cut_up = parts.join(several, ["file", "record"]).select("row", "off", "record")
    odd = saved(parts.filter("record is null").select("row", "off", "record").union(cut_up).withColumn("odd", F.lit(True)), f"{at}/odd")
    odd = F.broadcast(odd) if odd.count() <= BROADCAST_ROWS else odd
    segments = segments.select("value", "file", F.col("_pos").alias("row"))
    for name in ("slim", "candidates", "chain", "marked"):
        remove(spark, f"{at}/{name}")
    # a file's first segment stands before its first magic, and is empty or no record
    found = segments.filter(F.contains("value", F.lit(END))).join(odd, "row", "left_anti").select("file", "value")
    cut = segments.join(odd.filter("record is not null"), "row").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("v")).select("file", F.array_join("v.value", MAGIC).alias("value"))
    block = F.substr("value", F.length(head) + len(END) + 1, F.length("value") - F.length(head) - 2 * len(END))
    http = F.substring_index("block", END, 1)
    return (
        found.union(cut)
        .select("file", head.alias("head"), block.alias("block"))
        .select(
            "file", _header(F.col("head"), "WARC-Type").alias("record_type"), _header(F.col("head"), "WARC-Record-ID").alias("record_id"),
            _header(F.col("head"), "WARC-Target-URI").alias("target_uri"), _header(F.col("head"), "WARC-Payload-Digest").alias("payload_digest"),
            F.nullif(_header(F.col("head"), "WARC-Refers-To"), F.lit("")).alias("refers_to"), http.alias("http_head"),
            F.substr("block", F.length(http) + len(END) + 1).alias("payload"),
        )
    )


def page_of(name: Column) -> Column:
    """The id in a record's name; null for "none"."""
    return F.regexp_extract(name, "<urn:x-page:([^>]*)>", 1).try_cast("bigint")
