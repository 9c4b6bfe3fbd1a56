"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import columns as cf
from quillspark.functions import fixed as fx
from quillspark.functions import speechspans
from quillspark.operators import dots, lint, normalize, ordered, review, spans, speech
from quillspark.operators.phrases import containing
from quillspark.plans import runs
from quillspark.sources import files, sinks
from quillspark.tables import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents")


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


# --- lint ---------------------------------------------------------------------------------------

_FIRST = "length(regexp_extract(text, '(?s)^(.*?)(?:' || p || ')', 1))"
_DETECTORS = "(VALUES " + ", ".join(f"({q(n)}, {q(s)}, {q(p)})" for n, s, p in fx.DETECTORS) + ") d(detector, severity, p)"


@query(f"SELECT lang, detector, severity, count(*) FILTER (regexp_matches(text, p)) AS findings FROM documents, {_DETECTORS} GROUP BY ALL")
def lint_summary(spark, sf_dir):
    return lint.summary(docs(spark, sf_dir), "lang")


@query(f"""
WITH f AS (SELECT doc_id, text, detector, severity, regexp_extract(text, p) AS hit, {_FIRST} AS start FROM documents, {_DETECTORS} WHERE regexp_matches(text, p))
SELECT doc_id, detector, severity,
       '...' || replace(substr(text, greatest(start - 25, 0) + 1, start + length(hit) + 25 - greatest(start - 25, 0)), chr(10), ' ') || '...' AS evidence
FROM f""")
def lint_findings(spark, sf_dir):
    return lint.lint(docs(spark, sf_dir), brackets=[])


@query(f"""
WITH t AS (SELECT page_id, html AS text FROM pages),
f AS (SELECT page_id, text, detector, severity, regexp_extract(text, p) AS hit, {_FIRST} AS start FROM t, {_DETECTORS} WHERE regexp_matches(text, p))
SELECT page_id, detector, severity,
       '...' || replace(substr(text, greatest(start - 25, 0) + 1, start + length(hit) + 25 - greatest(start - 25, 0)), chr(10), ' ') || '...' AS evidence
FROM f""")
def lint_pages(spark, sf_dir):
    return lint.lint(t(spark, sf_dir, "pages"), "page_id", "html", brackets=[])


@query(f"""
SELECT doc_id, p[1] || ' x' || a || ' vs ' || p[2] || ' x' || b AS evidence FROM (
  SELECT doc_id, p, (length(text) - length(replace(text, p[1], ''))) // length(p[1]) AS a, (length(text) - length(replace(text, p[2], ''))) // length(p[2]) AS b
  FROM documents, (VALUES (['the ', 'of ']), (['.', ',']), (['de ', 'la '])) v(p)) WHERE a <> b""")
def bracket_balance(spark, sf_dir):
    found = lint.lint(docs(spark, sf_dir), detectors=[], brackets=[("the ", "of "), (".", ","), ("de ", "la ")])
    return found.select("doc_id", "evidence")


@query("SELECT lang, count(*) FILTER (n > 0) AS flagged, count(*) AS documents, sum(n)::BIGINT AS errors, sum(n) = 0 AS clean FROM (SELECT lang, " + " + ".join(f"regexp_matches(text, {q(p)})::INT" for _, _, p in fx.DETECTORS) + " AS n FROM documents) GROUP BY lang")
def lint_totals(spark, sf_dir):
    counted = docs(spark, sf_dir).select("lang", F.size(F.filter(lint.findings(F.col("text"), brackets=[]), lambda x: x["severity"] == "error")).alias("n"))
    return counted.groupBy("lang").agg(F.count_if(F.col("n") > 0).alias("flagged"), F.count("*").alias("documents"), F.sum("n").cast("long").alias("errors"), (F.sum("n") == 0).alias("clean"))


# --- spans -----------------------------------------------------------------------------------------


@query(f"""
WITH s AS (SELECT doc_id, regexp_extract_all(text, {q("(?s)" + fx.SPEECH_SPAN)}) AS a FROM documents)
SELECT doc_id, (unnest(generate_series(1, len(a))) - 1)::INT AS pos, unnest(a) AS span FROM s""")
def extract_spans(spark, sf_dir):
    return spans.spans(docs(spark, sf_dir), "doc_id", "text")


@query(f"""
WITH s AS (SELECT page_id, regexp_extract_all(html, {q("(?s)" + fx.SPEECH_SPAN)}) AS a FROM pages)
SELECT page_id, (unnest(generate_series(1, len(a))) - 1)::INT AS pos, unnest(a) AS span FROM s""")
def extract_page_spans(spark, sf_dir):
    return spans.spans(t(spark, sf_dir, "pages"), "page_id", "html")


@query(f"""
WITH s AS (SELECT doc_id, text, regexp_extract_all(text, {q("(?s)" + fx.SPAN)}) AS a FROM documents),
e AS (SELECT doc_id, generate_subscripts(a, 1) AS k, trim(unnest(a)) AS span FROM s),
f AS (SELECT doc_id, span, min(k) AS k FROM e GROUP BY ALL)
SELECT s.doc_id, coalesce((SELECT string_agg(span, '|' ORDER BY k) FROM f WHERE f.doc_id = s.doc_id), '') AS spans, regexp_matches(s.text, '[가-힣ᄀ-ᇿ]') AS hangul FROM s""")
def distinct_spans(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(spans.distinct_spans(F.col("text")), "|").alias("spans"), spans.has_hangul(F.col("text")).alias("hangul"))


@query(f"""
SELECT doc_id, len(regexp_extract_all(text, {q("(?s)" + fx.SPAN)})) AS n_latex, md5(text) AS rejoined FROM documents""")
def parts_roundtrip(spark, sf_dir):
    parts = spans.parts(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(F.filter(parts, lambda p: p["kind"] == "latex")).alias("n_latex"), F.md5(F.array_join(F.transform(parts, lambda p: p["body"]), "")).alias("rejoined"))


@query("""
SELECT conv_id, trim(regexp_replace(string_agg(role || ': ' || text, '  ' ORDER BY turn), ' +', ' ', 'g')) AS stitched FROM conversations GROUP BY conv_id""")
def stitch_turns(spark, sf_dir):
    sep = F.when(F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) > 1, "  ").otherwise("")
    rows = t(spark, sf_dir, "conversations").withColumn("said", F.concat(sep, "role", F.lit(": "), "text"))
    return spans.stitch(rows, "conv_id", "turn", F.col("said"))


_SAID = "CASE WHEN turn > min(turn) OVER (PARTITION BY conv_id) THEN '  ' ELSE '' END || role || ': ' || text"


def _said(spark, sf_dir):
    """Turns as they are stitched; the first of a conversation has no gap before it."""
    rows = t(spark, sf_dir, "conversations")
    first = rows.groupBy("conv_id").agg(F.min("turn").alias("first"))
    return rows.join(first, "conv_id").withColumn("said", F.concat(F.when(F.col("turn") > F.col("first"), "  ").otherwise(""), "role", F.lit(": "), "text"))


@query(f"""
WITH r AS (SELECT conv_id, turn, {_SAID} AS said FROM conversations),
c AS (SELECT conv_id, turn, trim(regexp_replace(string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY turn), ' +', ' ', 'g')) AS so_far FROM r),
o AS (SELECT conv_id, turn, so_far, coalesce(length(lag(so_far) OVER (PARTITION BY conv_id ORDER BY turn)), 0) AS "offset" FROM c)
SELECT conv_id, turn, "offset", md5(substr(so_far, "offset" + 1)) AS piece FROM o""")
def stitch_pieces(spark, sf_dir):
    """The stitched text in pieces with offsets, so that no conversation has to fit a row."""
    cut = ordered.pieces(_said(spark, sf_dir), ["conv_id"], ["turn"], F.col("said"))
    return cut.select("conv_id", "turn", "offset", F.md5("piece").alias("piece"))


@query(f"""
WITH r AS (SELECT conv_id, turn, {_SAID} AS said FROM conversations), s AS (SELECT conv_id, trim(regexp_replace(string_agg(said, '' ORDER BY turn), ' +', ' ', 'g')) AS stitched FROM r GROUP BY conv_id)
SELECT conv_id, length(stitched) AS n_chars, md5(stitched) AS md5 FROM s""")
def stitch_digests(spark, sf_dir):
    return ordered.digests(ordered.pieces(_said(spark, sf_dir), ["conv_id"], ["turn"], F.col("said")), "conv_id", ["turn"])


# --- signals and repairs ------------------------------------------------------------------------------

_SIG = {f"sig_{n}": f"regexp_matches(text, {q(p)})" for n, p in fx.SIGNALS.items()} | {"sig_paren": "contains(text, '(') AND regexp_matches(text, '[0-9A-Za-z]')", "english": f"regexp_matches(text, {q(fx.ENGLISH_WORD)})"}


@query("SELECT doc_id, " + ", ".join(f"{sql} AS {n}" for n, sql in _SIG.items()) + ", NOT english AND (" + " OR ".join(n for n in _SIG if n != "english") + ") AS is_math FROM documents")
def math_signals(spark, sf_dir):
    flags = docs(spark, sf_dir).select("doc_id", *(c.alias(n) for n, c in cf.math_signals(F.col("text")).items()))
    signs = [c for c in flags.columns if c.startswith("sig_")]
    # from the flags, so no pattern is searched twice
    return flags.withColumn("is_math", ~F.col("english") & F.expr(" or ".join(signs)))


@query(f"SELECT page_id, md5(regexp_replace(html, {q(fx.HTML_BLOCK)}, ' ', 'gis')) AS stripped FROM pages")
def html_strip(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", F.md5(cf.strip_markup(F.col("html"))).alias("stripped"))


@query("""
SELECT n_nationkey, 'x' || chr(10) || chr(10) || n_name || ' ' || n_regionkey || chr(10) || chr(10) || n_nationkey || chr(10) || chr(10) || 'y ' AS text FROM nation""")
def table_text(spark, sf_dir):
    made = F.concat(
        F.lit('x<TABLE border="1">\n<tr><td> <b>'), "n_name", F.lit("</b> </td><td></td><th>"), F.col("n_regionkey").cast("string"), F.lit("</th></tr><tr></tr><tr><td>"), F.col("n_nationkey").cast("string"),
        F.lit("</td></tr></table>y<table><tr><td> </td></tr></table>"),
    )
    return t(spark, sf_dir, "nation").select("n_nationkey", cf.table_lines(made).alias("text"))


@query("""
SELECT p_partkey, 'a 절댓값 □ 사각형 ABC 몫 ' || k || ' 나머지 2 … $' || k || '\\frac{1}{2}$ \\sqrt{\\text{분산}} \\frac{\\text{가}}{\\text{나}} □' || k || ' \\begin{cases}' || k || '\\end{cases}  ' || p_name || ' ' AS text
FROM (SELECT p_partkey, p_name, (p_partkey % 97)::VARCHAR AS k FROM part)""")
def repair_text(spark, sf_dir):
    k = (F.col("p_partkey") % 97).cast("string")
    made = F.concat(
        F.lit("a 절맛값 ☐ ▢ ABC "), k, F.lit(" ⋯ 2 ⋯ "), k, F.lit(r"$\frac{1}{2}$ \sqrt {분산} \frac{가}{나} \boxed{"), k, F.lit(r"} $ \begin{cases}"), k, F.lit(r"\end{cases} $ <div class='x'>"), "p_name", F.lit("</DIV>"),
    )
    return t(spark, sf_dir, "part").select("p_partkey", cf.repaired(made).alias("text"))


@query("SELECT doc_id, true AS same FROM documents WHERE NOT regexp_matches(text, '[$\\\\<(|☐▢⋯^_×÷·±≤≥√π°-]|[0-9]|sin|cos|tan|[=+*/>]')")
def normalize_plain(spark, sf_dir):
    plain = docs(spark, sf_dir).filter(~F.col("text").rlike(r"[$\\<(|☐▢⋯^_×÷·±≤≥√π°-]|[0-9]|sin|cos|tan|[=+*/>]"))
    return normalize.normalize(plain).select("doc_id", F.col("norm_text").eqNullSafe(F.col("text")).alias("same"))


@query()
def normalize_text(spark, sf_dir):
    return normalize.normalize(docs(spark, sf_dir)).select("doc_id", F.md5("norm_text").alias("norm_md5"), (F.col("norm_text") != F.col("text")).alias("changed"), F.size(spans.span_array(F.col("norm_text"))).alias("n_spans"))


@query("""
WITH c AS (SELECT doc_id, text, list_reduce(list_transform(string_split(regexp_replace(text, '[^()]', '', 'g'), ''), lambda x: CASE x WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END), lambda a, b: CASE WHEN a < 0 THEN -1000000 ELSE a + b END, 0) AS d FROM documents)
SELECT doc_id, d = 0 AS balanced FROM c""")
def paren_balanced(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", cf.parens_balanced(F.col("text")).alias("balanced"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 8 WHEN 2 THEN 8 ELSE 0 END AS cut FROM orders")
def split_unmatched(spark, sf_dir):
    made = F.element_at(F.array(F.lit("f(x)"), F.lit("f(x)+g)h(p, q"), F.lit("p<=k<q+r(p, (q)"), F.lit("(x+(y)")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    # the first closes; in the others a parenthesis never does: after 8, 8 and no characters
    return t(spark, sf_dir, "orders").select("o_orderkey", cf.unclosed_cut(made).cast("int").alias("cut"))


# --- files and names -------------------------------------------------------------------------------------


@query(f"SELECT page_id, regexp_matches(lower(url || CASE page_id % 3 WHEN 0 THEN '.JPEG' WHEN 1 THEN '.pdf' ELSE '.tif' END), {q(fx.IMAGE_SUFFIXES)}) AS is_image FROM pages")
def image_filter(spark, sf_dir):
    k = F.col("page_id") % 3
    return t(spark, sf_dir, "pages").select("page_id", cf.is_image(F.concat("url", F.when(k == 0, ".JPEG").when(k == 1, ".pdf").otherwise(".tif"))).alias("is_image"))


@query(r"SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^\w\-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'input') AS stem FROM pages")
def safe_stem(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", cf.safe_stem(F.col("url")).alias("stem"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') AS origin FROM pages")
def endpoint_origin(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", cf.origin(F.col("url")).alias("origin"))


@query(f"SELECT doc_id, md5(CASE WHEN length(text) > {fx.CLIP_AT} THEN substr(text, 1, {fx.CLIP_AT}) || chr(10) || '...[source truncated at {fx.CLIP_AT} chars]' ELSE text END) AS clipped, length(text) > {fx.CLIP_AT} AS cut FROM documents")
def clip_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(cf.clip(F.col("text"), "source")).alias("clipped"), (F.length("text") > fx.CLIP_AT).alias("cut"))


@query("SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM pages")
def escape_xml(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", F.md5(cf.escape_xml(F.col("html"))).alias("escaped"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN NULL ELSE true END AS expected FROM events")
def expect_sidecar(spark, sf_dir):
    token = F.element_at(F.array(F.lit(" Math\n"), F.lit("none"), F.lit("perhaps"), F.lit("1")), (F.col("event_id") % 4 + 1).cast("int"))
    return t(spark, sf_dir, "events").select("event_id", cf.expectation(token).alias("expected"))


@query("SELECT n_nationkey, '0.' || (n_nationkey + 10) AS number, ((n_nationkey + 10) % 10)::VARCHAR AS period FROM nation WHERE n_nationkey % 2 = 0")
def expect_dots(spark, sf_dir):
    n = (F.col("n_nationkey") + 10).cast("string")
    pair = F.concat(F.lit(" 0."), n, F.lit(" : "), F.right(n, F.lit(1)))
    side = F.concat(F.lit("# truth\n\n"), F.when(F.col("n_nationkey") % 2 == 0, pair).otherwise("none"), F.lit("\n"))
    return t(spark, sf_dir, "nation").select("n_nationkey", F.explode(files.dot_truth(side)).alias("p")).select("n_nationkey", "p.*")


@query("SELECT DISTINCT 'KEY_' || n_nationkey AS key, n_name AS value FROM nation")
def env_settings(spark, sf_dir):
    lines = t(spark, sf_dir, "nation").select(F.explode(F.array(F.lit("# note=1"), F.concat(F.lit(" KEY_"), F.col("n_nationkey").cast("string"), F.lit(" = '"), "n_name", F.lit("' ")), F.lit("plain"))).alias("value"))
    return files.settings(lines)


_STYLES = """
WITH l AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 50 = 1 THEN CASE WHEN p_partkey // 50 % 2 = 0 THEN 'ko' ELSE 'en' END END AS locale,
                  CASE p_partkey % 10 WHEN 1 THEN 'speech' WHEN 6 THEN 'braille' END AS modality, CASE WHEN p_partkey % 5 = 2 THEN p_brand END AS domain, p_name AS c FROM part),
f AS (SELECT c, last_value(locale IGNORE NULLS) OVER w AS locale, last_value(modality IGNORE NULLS) OVER w AS modality, last_value(domain IGNORE NULLS) OVER w AS domain FROM l WINDOW w AS (ORDER BY n)),
s AS (SELECT DISTINCT domain, unnest(string_split(c, ' ')) AS style FROM f WHERE locale = 'ko' AND modality = 'speech' AND domain IS NOT NULL)"""


@query(_STYLES + " SELECT domain, style FROM s")
def style_table(spark, sf_dir):
    """Lines of a table whose cells are blank where the value above goes on; one order of all rows."""
    n = F.col("p_partkey")
    locale = F.when(n % 50 == 1, F.when(F.floor(n / 50) % 2 == 0, " ko").otherwise(" en")).otherwise("   ")
    modality = F.when(n % 10 == 1, "speech").when(n % 10 == 6, "braille").otherwise("")
    line = F.concat(locale, F.lit(" | "), modality, F.lit(" | "), F.when(n % 5 == 2, F.col("p_brand")).otherwise(""), F.lit(" | "), F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit(","))
    lines = t(spark, sf_dir, "part").select(n.alias("n"), line.alias("value"))
    head = t(spark, sf_dir, "part").filter("p_partkey % 100 = 3").select(F.lit(0).alias("n"), F.explode(F.array(F.lit("====="), F.lit("locale | modality | domain | style"))).alias("value"))
    return files.style_table(lines.union(head))


# --- verdicts and scores --------------------------------------------------------------------------------------

_FOUND = f"NOT regexp_matches(text, {q('[#$%&*!|]{2}|!!')})"


def _judged(spark, sf_dir):
    found = ~F.col("text").rlike("[#$%&*!|]{2}|!!")
    return docs(spark, sf_dir).join(t(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("expected")), "doc_id", "left").withColumn("found", found)


_JUDGED = f"(SELECT d.*, quality = 1 AS expected, {_FOUND} AS found FROM documents d LEFT JOIN labels USING (doc_id))"
_VERDICT = "CASE WHEN expected IS NULL THEN 'unverified' WHEN expected AND NOT found THEN 'MISS' WHEN NOT expected AND found THEN 'spurious?' ELSE 'ok' END"


@query(f"SELECT doc_id, {_VERDICT} AS verdict FROM {_JUDGED}")
def verdict(spark, sf_dir):
    return _judged(spark, sf_dir).select("doc_id", cf.verdict(F.col("found"), F.col("expected")).alias("verdict"))


@query(f"SELECT lang, {_VERDICT} AS verdict, count(*) AS n FROM {_JUDGED} GROUP BY ALL")
def verdict_counts(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy("lang", cf.verdict(F.col("found"), F.col("expected")).alias("verdict")).agg(F.count("*").alias("n"))


@query(f"""
SELECT lang, tp, fp, fn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM (
  SELECT lang, count(*) FILTER (found AND expected) AS tp, count(*) FILTER (found AND NOT expected) AS fp, count(*) FILTER (NOT found AND expected) AS fn
  FROM {_JUDGED} WHERE expected IS NOT NULL GROUP BY lang)""")
def precision_recall(spark, sf_dir):
    known = _judged(spark, sf_dir).filter("expected is not null")
    score = known.select("lang", *(c.cast("int").alias(n) for n, c in (("tp", F.expr("found and expected")), ("fp", F.expr("found and not expected")), ("fn", F.expr("not found and expected")))))
    return review.micro_totals(score, ["lang"])


@query("""
WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(substr(text, 1, length(text) // 2)), '[a-z]{4,}')) AS a, list_distinct(regexp_extract_all(lower(substr(text, length(text) // 2 + 1)), '[a-z]{4,}')) AS b FROM documents)
SELECT doc_id, len(list_intersect(a, b))::INT AS tp, (len(b) - len(list_intersect(a, b)))::INT AS fp, (len(a) - len(list_intersect(a, b)))::INT AS fn FROM w""")
def set_score(spark, sf_dir):
    def words(c):
        return F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), 0)

    half = F.floor(F.length("text") / 2).cast("int")
    head, tail = F.substr("text", F.lit(1), half), F.substr("text", half + 1)
    return docs(spark, sf_dir).select("doc_id", review.set_score(words(head), words(tail)).alias("s")).select("doc_id", "s.*")


_STATUS = """CASE WHEN good AND known IS NULL THEN 'PASS' WHEN good THEN 'FIXED' WHEN known IS NOT NULL THEN 'KNOWN' ELSE 'FAIL' END"""


@query(f"""
SELECT {_STATUS} AS status, count(*) AS n FROM (
  SELECT (contains(text, ' of ') AND contains(text, 'th') OR lang <> 'en') AND NOT contains(text, '!!') AND NOT contains(text, '###') AS good, CASE WHEN doc_id % 3 = 0 THEN 'open' END AS known FROM documents)
GROUP BY ALL""")
def golden_status(spark, sf_dir):
    must = F.when(F.col("lang") == "en", F.array(F.lit(" of "), F.lit("th")))
    status = cf.case_status(F.col("text"), must, F.array(F.lit("!!"), F.lit("###")), F.when(F.col("doc_id") % 3 == 0, "open"))
    return docs(spark, sf_dir).groupBy(status.alias("status")).agg(F.count("*").alias("n"))


# --- resuming and joining -----------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def skip_reviewed(spark, sf_dir):
    return review.unreviewed(docs(spark, sf_dir).select("doc_id"), t(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def reuse_cached(spark, sf_dir):
    return review.reusable(docs(spark, sf_dir).select("doc_id"), t(spark, sf_dir, "labels").filter("quality = 1"), "doc_id")


@query("SELECT doc_id, coalesce('q' || quality, '') AS source_text FROM documents LEFT JOIN labels USING (doc_id)")
def source_join(spark, sf_dir):
    sources = t(spark, sf_dir, "labels").withColumn("q", F.concat(F.lit("q"), F.col("quality").cast("string")))
    return review.with_source(docs(spark, sf_dir).select("doc_id"), sources, "doc_id", "q")


@query("""
SELECT text AS input, min(doc_id) AS doc_id FROM documents WHERE text NOT IN (SELECT text FROM benchmark) AND text NOT IN (SELECT text FROM conversations) GROUP BY text""")
def suggest_dedup(spark, sf_dir):
    whole = F.col("text").alias("input")
    known = [t(spark, sf_dir, "benchmark").select(whole), t(spark, sf_dir, "conversations").select(whole)]
    return review.fresh_suggestions(docs(spark, sf_dir).select(whole, "doc_id"), known, "doc_id").select("input", "doc_id")


@query("""
SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, split_part(b.text, chr(10), 1)) AND length(split_part(b.text, chr(10), 1)) >= 60""")
def contains_benchmark(spark, sf_dir):
    phrases = t(spark, sf_dir, "benchmark").select("item_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("phrase")).filter("length(phrase) >= 60")
    return containing(docs(spark, sf_dir), "doc_id", "text", phrases, "item_id", "phrase")


@query("SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) AND b.text <> ''")
def contains_whole_benchmark(spark, sf_dir):
    """All items by their whole text, where contains_benchmark takes first lines of 60 characters and more."""
    return containing(docs(spark, sf_dir), "doc_id", "text", t(spark, sf_dir, "benchmark"), "item_id", "text")


@query("""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{9,}')) AS word FROM benchmark)
SELECT word, count(*) AS documents FROM w JOIN documents ON contains(text, word) GROUP BY word""")
def contains_words(spark, sf_dir):
    """Phrases of one word, which texts may have within longer words too."""
    words = t(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{9,}"), F.lit(0))).alias("word")).distinct()
    found = containing(docs(spark, sf_dir), "doc_id", "text", words.withColumn("phrase", F.col("word")), "word", "phrase")
    return found.groupBy("word").agg(F.count("*").alias("documents"))


@query("SELECT event_id, last_value(kind IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS kind FROM (SELECT *, CASE WHEN value > 50 THEN event_type END AS kind FROM events)")
def carry_down(spark, sf_dir):
    gaps = t(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("value") > 50, F.col("event_type")).otherwise("").alias("kind"))
    return review.carry_down(gaps, ["user_id"], "event_id", ["kind"]).select("event_id", "kind")


@query("SELECT conv_id, turn, lag(right(text, 1)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations")
def prev_part(spark, sf_dir):
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag(F.right("text", F.lit(1))).over(W.partitionBy("conv_id").orderBy("turn")).alias("before"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source HAVING count(*) > 1 UNION SELECT lang, 'all', count(*) FROM documents GROUP BY lang")
def group_counts(spark, sf_dir):
    by = docs(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("n"))
    return by.filter("n > 1").union(by.groupBy("lang").agg(F.sum("n").alias("n")).select("lang", F.lit("all"), "n")).distinct()


# --- numbers said aloud ------------------------------------------------------------------------------------------------

_KO = f"translate({{}}, '0123456789', '{fx.DIGITS}')"


@query(f"SELECT o_orderkey, {_KO.format('o_orderkey::VARCHAR')} AS said FROM orders")
def digits_to_korean(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", cf.read_digits(F.col("o_orderkey").cast("string")).alias("said"))


_PARTICLE = "CASE WHEN unicode(right({0}, 1)) BETWEEN 44032 AND 55203 AND (unicode(right({0}, 1)) - 44032) % 28 <> 0 THEN '이' ELSE '가' END"


@query(f"SELECT s_suppkey, w || {_PARTICLE.format('w')} AS said FROM (SELECT s_suppkey, {_KO.format('s_suppkey::VARCHAR')} AS w FROM supplier)")
def particle(spark, sf_dir):
    w = cf.read_digits(F.col("s_suppkey").cast("string"))
    return t(spark, sf_dir, "supplier").select("s_suppkey", F.concat(w, cf.subject_particle(w)).alias("said"))


_HEAD = "'영 점' || CASE WHEN before <> '' THEN ' ' || " + _KO.format("before") + " ELSE '' END"
_BLOCK = _KO.format("block")


@query(f"""
WITH c AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_size::VARCHAR END AS before, (p_partkey % 997)::VARCHAR AS block FROM part)
SELECT id, 'A-name-first' AS reading, '순환소수 ' || {_HEAD} || ', 순환마디 ' || {_BLOCK} AS said FROM c
UNION ALL SELECT id, 'B-boundary', {_HEAD} || ' 다음 ' || {_BLOCK} || {_PARTICLE.format(_BLOCK)} || ' 반복' FROM c
UNION ALL SELECT id, 'C-repeat-twice', {_HEAD} || ' ' || {_BLOCK} || ' ' || {_BLOCK} || ' 반복' FROM c""")
def readings_matrix(spark, sf_dir):
    cases = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("0").alias("whole"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("p_size").cast("string")).alias("before"), (F.col("p_partkey") % 997).cast("string").alias("block"))
    said = F.array(*(F.struct(F.lit(n).alias("reading"), f(F.col("whole"), F.col("before"), F.col("block")).alias("said")) for n, f in cf.READINGS.items()))
    return cases.select("id", F.explode(said).alias("r")).select("id", "r.*")


@query(f"""
SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN NULL ELSE '영 점' || CASE p_partkey % 3 WHEN 1 THEN ' ' || {_KO.format('p_size::VARCHAR')} ELSE '' END || ' ' || b || ' ' || b || ' 반복' END AS said
FROM (SELECT *, {_KO.format("(p_partkey % 90 + 10)::VARCHAR")} AS b FROM part)""")
def repeating_reading(spark, sf_dir):
    two, size, k = (F.col("p_partkey") % 90 + 10).cast("string"), F.col("p_size").cast("string"), F.col("p_partkey") % 3
    dotted = F.concat(F.lit(r"\dot{"), F.left(two, F.lit(1)), F.lit(r"}\dot{"), F.right(two, F.lit(1)), F.lit("}"))
    fraction = F.when(k == 0, dotted).when(k == 1, F.concat(size, F.lit(r"\overline{"), two, F.lit("}"))).otherwise(F.concat(dotted, F.lit("7")))
    return t(spark, sf_dir, "part").select("p_partkey", cf.read_repeating(F.lit("0"), fraction).alias("said"))


@query(f"SELECT doc_id, regexp_matches(text, {q(fx.DECIMAL)}) AND regexp_matches(text, {q(fx.REPETITION)}) AS needs FROM documents")
def needs_check(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", cf.needs_check(F.col("text")).alias("needs"))


@query("""
WITH n AS (SELECT l_orderkey, l_linenumber, '0.' || (l_partkey % 900 + 100) AS number, right((l_partkey % 900 + 100)::VARCHAR, (1 + l_linenumber % 3)::INT) AS period FROM lineitem)
SELECT l_orderkey, l_linenumber, left(number, length(number) - length(period)) || left(period, 1) || chr(775) || CASE length(period) WHEN 1 THEN '' WHEN 2 THEN right(period, 1) || chr(775) ELSE period[2] || right(period, 1) || chr(775) END AS dotted FROM n""")
def dotify(spark, sf_dir):
    n = (F.col("l_partkey") % 900 + 100).cast("string")
    period = F.right(n, (1 + F.col("l_linenumber") % 3).cast("int"))
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cf.dotify(F.concat(F.lit("0."), n), period).alias("dotted"))


@query("""
SELECT p_partkey, '1.' || p_size || (p_partkey % 90 + 10) AS number, (p_partkey % 90 + 10)::VARCHAR AS period FROM part
UNION ALL SELECT p_partkey, '2.' || p_size, right(p_size::VARCHAR, 1) FROM part""")
def dotted_numbers(spark, sf_dir):
    two, size = (F.col("p_partkey") % 90 + 10).cast("string"), F.col("p_size").cast("string")
    text = F.concat(F.lit("값 "), cf.dotify(F.concat(F.lit("1."), size, two), two), F.lit(" 3.14 "), F.lit("2."), F.left(size, F.length(size) - 1), F.lit(r"\dot{"), F.right(size, F.lit(1)), F.lit("} 끝"))
    return t(spark, sf_dir, "part").select("p_partkey", F.explode(cf.dotted_numbers(text)).alias("d")).select("p_partkey", "d.*")


@query("SELECT p_partkey, (p_partkey % 2 = 0)::INT AS applied, CASE WHEN p_partkey % 2 = 0 THEN '0.' || left(b, 1) || chr(775) || right(b, 1) || chr(775) || ' = 0.' || b || b || b || '...' ELSE '0.' || b || ' = 1/3' END AS patched FROM (SELECT p_partkey, CASE WHEN p_partkey % 90 + 10 IN (11,22,33,44,55,66,77,88,99) THEN '12' ELSE (p_partkey % 90 + 10)::VARCHAR END AS b FROM part)")
def restore_dots(spark, sf_dir):
    from quillspark.functions.providers import ExpansionChat

    raw = F.col("p_partkey") % 90 + 10
    two = F.when(raw % 11 == 0, "12").otherwise(raw.cast("string"))
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("0."), two, F.lit(" = 0."), two, two, two, F.lit("..."))).otherwise(F.concat(F.lit("0."), two, F.lit(" = 1/3")))
    done = dots.restore(t(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey", "text", ExpansionChat)
    return done.select("p_partkey", F.size("notes").alias("applied"), "patched")


@query("SELECT n_nationkey, 2 AS kept, 'warn' AS severity, n_regionkey > 1 AS has_case FROM nation")
def validate_findings(spark, sf_dir):
    n = F.col("n_name")

    def finding(quote, explanation, severity, must):
        case = F.struct(F.lit("c").alias("id"), n.alias("input"), must.alias("must"), F.lit(None).cast("array<string>").alias("mustnot"))
        fields = {"category": F.lit(None).cast("string"), "severity": severity, "speech_quote": quote, "source_quote": F.lit(""), "correct_reading": F.lit(""), "explanation": explanation, "suggested_case": case}
        return F.struct(*(v.alias(k) for k, v in fields.items()))

    must = F.when(F.col("n_regionkey") > 1, F.array(n))
    items = F.array(finding(n, F.lit("odd"), F.lit("fatal"), must), finding(F.lit("never said"), F.lit("made up"), F.lit("error"), must), finding(n, F.lit(""), F.lit("error"), must), finding(F.lit(""), F.lit("no quote"), F.lit("error"), must))
    found = review.valid_findings(items, F.concat(F.lit("say "), n))
    return t(spark, sf_dir, "nation").select("n_nationkey", F.size(found).alias("kept"), found[0]["severity"].alias("severity"), found[0]["suggested_case"].isNotNull().alias("has_case"))


# --- speech ------------------------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\\{}$~&^_]', ' ', 'g'), '\s+', ' ', 'g')) AS words FROM documents")
def salvage(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", cf.salvage(F.col("text")).alias("words"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL ELSE 'x' END AS bad FROM part")
def xml_wellformed(spark, sf_dir):
    k, n = (F.col("p_partkey") % 4 + 1).cast("int"), F.col("p_name")
    xml = F.element_at(F.array(F.concat(F.lit("<a b='1'>"), cf.escape_xml(n), F.lit("<c/></a>")), F.concat(F.lit("<a>"), n, F.lit("</b>")), F.concat(F.lit("<a>"), n), F.concat(n, F.lit(" & x"))), k)
    return t(spark, sf_dir, "part").select("p_partkey", F.when(speechspans.markup_error(xml).isNotNull(), "x").alias("bad"))


def _formulas(spark, sf_dir):
    k, s = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    made = F.when(k == 0, F.concat(F.lit("값은 $x+"), s, F.lit("$ 이다"))).when(k == 1, F.concat(F.lit(r"식 $\unknown "), s, F.lit("$ 끝"))).otherwise(F.concat(F.lit(r"수 $0.\dot{"), F.left(s, F.lit(1)), F.lit("}$ 를")))
    return t(spark, sf_dir, "part").select("p_partkey", made.alias("text"))


@query(f"""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '값은 x 더하기 ' || p_size || ' 이다' WHEN 1 THEN '식 ' || p_size || ' 끝' ELSE '수 영 점 ' || {_KO.format("left(p_size::VARCHAR, 1)")} || ' ' || {_KO.format("left(p_size::VARCHAR, 1)")} || ' 반복 를' END AS content,
       1 AS spans, (p_partkey % 3 <> 1)::INT AS ok, (p_partkey % 3 = 1)::INT AS salvaged, 0 AS unsupported FROM part""")
def render_ladder(spark, sf_dir):
    return speech.render(_formulas(spark, sf_dir), "p_partkey", "text").select("p_partkey", "content", *(F.col(c).cast("int").alias(c) for c in ("spans", "ok", "salvaged", "unsupported")))


@query("SELECT count(*) AS spans, count(*) FILTER (p_partkey % 3 <> 1) AS ok, count(*) FILTER (p_partkey % 3 = 1) AS salvaged, 0::BIGINT AS unsupported, 0::BIGINT AS bad_xml, count(*) FILTER (p_partkey % 3 = 1) AS failures, 2 AS exit_code FROM part")
def speech_totals(spark, sf_dir):
    return speech.totals(speech.render(_formulas(spark, sf_dir), "p_partkey", "text", ssml=True))


@query(r"SELECT DISTINCT '\unknown ' || p_size AS latex, 'clearspeak/default,mathspeak/default' AS combos FROM part")
def flagged_formulas(spark, sf_dir):
    made = t(spark, sf_dir, "part").select(F.explode(F.array(F.concat(F.lit(r"\unknown "), F.col("p_size").cast("string")), F.concat(F.lit("x+"), F.col("p_size").cast("string")))).alias("latex")).distinct()
    said = speech.speak(made, [("clearspeak", "default"), ("mathspeak", "default")])
    return speech.flagged(said).select("latex", F.array_join("combos", ",").alias("combos"))


@query("SELECT r_regionkey::VARCHAR AS name, r_regionkey || '-full-plain.wav' AS file, true AS ok, 44 + 480 * length(r_name) AS bytes FROM region")
def voice_files(spark, sf_dir):
    done = sinks.audio(t(spark, sf_dir, "region"), "r_regionkey", "r_name")
    return done.select("name", "file", "ok", F.length("audio").alias("bytes"))


@query("""
SELECT r_name AS input, string_agg('## ' || n_name || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN '- lint [error] empty-cell: ...x 빈 칸 y...' ELSE '- clean' END || chr(10), chr(10) ORDER BY n_name) AS report
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def review_report(spark, sf_dir):
    pages = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.when(F.col("n_nationkey") % 2 == 0, "x 빈 칸 y").otherwise("fine")
    rows = pages.select(F.col("r_name").alias("input"), F.col("n_name").alias("page"), lint.findings(text).alias("lint"), F.array().cast(f"array<{review.FINDING}>").alias("judge"), F.lit(None).cast("string").alias("judge_error"))
    return review.report(rows, "input", "page")


_PAGE_LINES = "concat_ws(chr(10), " + ", ".join(f"CASE WHEN regexp_matches(text, {q(p)}) THEN '- lint [{s}] {n}: ' END" for n, s, p in fx.DETECTORS) + ")"


@query(f"""
WITH p AS (SELECT source AS input, doc_id AS page, '## ' || doc_id || chr(10) || coalesce(nullif({_PAGE_LINES}, ''), '- clean') || chr(10) AS body FROM documents),
o AS (SELECT *, row_number() OVER w AS n, coalesce(sum(length(body)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chars FROM p WINDOW w AS (PARTITION BY input ORDER BY page))
SELECT input, page, CASE WHEN n > 1 THEN chr(10) ELSE '' END || body AS piece, (chars + greatest(n - 2, 0))::BIGINT AS "offset" FROM o""")
def report_pieces(spark, sf_dir):
    """A report of all documents of a source, however many, as pieces with offsets; lint lines without what stands around a find."""
    found = F.transform(lint.findings(F.col("text"), brackets=[]), lambda x: F.struct(x["detector"].alias("detector"), x["severity"].alias("severity"), F.lit("").alias("evidence")))
    rows = docs(spark, sf_dir).select(F.col("source").alias("input"), F.col("doc_id").alias("page"), found.alias("lint"), F.array().cast(f"array<{review.FINDING}>").alias("judge"), F.lit(None).cast("string").alias("judge_error"))
    return review.report_pieces(rows, "input", "page")


@query(f"""
SELECT n_nationkey, v AS variant, v = 'b' AS ssml, CASE v WHEN 'a' THEN n_name || ' & more' ELSE {q(fx.ENVELOPE[0] + fx.VOICES[0] + fx.ENVELOPE[1])} || n_name || '<break time="400ms"/> &amp; more' || {q(fx.ENVELOPE[2])} END AS content
FROM nation, (VALUES ('a'), ('b')) x(v)""")
def voice_variants(spark, sf_dir):
    made = cf.voice_variants(F.concat("n_name", F.lit("{br} & more")))
    return t(spark, sf_dir, "nation").select("n_nationkey", F.explode(made).alias("v")).select("n_nationkey", "v.*")


_BRANDS = ["Brand#11", "Brand#3", "Brand#99"]


@query(_STYLES + ", " + "g AS (SELECT domain, count(*) AS styles FROM s GROUP BY domain) SELECT domain, styles, domain IN ('Brand#11', 'Brand#3', 'Brand#99') AS wanted FROM g")
def capabilities(spark, sf_dir):
    """What a set of domains can do: how many styles each has, and whether it is one of those asked for."""
    found = QUERIES["style_table"](spark, sf_dir).groupBy("domain").agg(F.collect_set("style").alias("s"))
    return found.select("domain", F.size("s").cast("long").alias("styles"), F.array_contains(F.array(*(F.lit(x) for x in _BRANDS)), F.col("domain")).alias("wanted"))


@query(f"""
WITH a AS (SELECT unnest(regexp_extract_all(text, {q("(?s)" + fx.SPEECH_SPAN)})) AS s FROM documents UNION ALL SELECT unnest(regexp_extract_all(html, {q("(?s)" + fx.SPEECH_SPAN)})) FROM pages)
SELECT DISTINCT trim(replace(s, '$', '')) AS latex FROM a WHERE trim(replace(s, '$', '')) <> ''""")
def wanted_formulas(spark, sf_dir):
    both = docs(spark, sf_dir).select("text").union(t(spark, sf_dir, "pages").select("html"))
    found = both.select(F.explode(spans.span_array(F.col("text"))).alias("s")).select(cf.strip(F.replace("s", F.lit("$"), F.lit(""))).alias("latex"))
    return found.filter("latex <> ''").distinct()


@query("SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'PASS' ELSE 'KNOWN' END AS status, 'tts-' || o_orderkey || '-' || r || '.wav' AS file FROM orders, (VALUES ('A'), ('B'), ('C')) v(r)")
def experiment_matrix(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "PASS").otherwise("KNOWN")
    names = F.explode(F.array(*(F.concat(F.lit("tts-"), F.col("o_orderkey").cast("string"), F.lit(f"-{r[0]}.wav")) for r in cf.READINGS))).alias("file")
    return t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", status.alias("status"), names)


# --- judging, dot cases, set-ups, MathML ---------------------------------------------------------------------


@query("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 2 = 1 THEN 0 ELSE 1 END AS kept, doc_id % 5 = 0 AS failed,
       CASE WHEN doc_id % 5 <> 0 AND doc_id % 2 = 0 THEN CASE WHEN lang IN ('en', 'de') THEN 'error' ELSE 'warn' END END AS severity
FROM documents WHERE doc_id % 7 <> 0 AND regexp_matches(text, '[^\\s]')""")
def judge_replies(spark, sf_dir):
    quote = F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 12)).otherwise(F.concat(F.lit("§ "), F.substring("text", 1, 12), F.lit(" §")))
    finding = F.struct(F.lit("reading").alias("category"), F.when(F.col("lang").isin("en", "de"), "error").otherwise("grave").alias("severity"), quote.alias("speech_quote"), F.col("lang").alias("explanation"))
    reply = F.when(F.col("doc_id") % 5 == 0, F.lit('{"findings": [')).otherwise(F.to_json(F.struct(F.array(finding).alias("findings"))))
    pages = docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 7 == 0, "  ").otherwise(F.col("text")).alias("speech"), reply.alias("reply"))
    done = review.judged(pages, "speech", "reply")
    return done.select("doc_id", F.size("findings").alias("kept"), F.col("judge_error").isNotNull().alias("failed"), F.get("findings", F.lit(0))["severity"].alias("severity"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'known' WHEN p_partkey % 3 = 0 THEN 'failed' ELSE 'ok' END AS status,
       CASE WHEN p_partkey % 5 = 0 OR p_partkey % 3 = 0 THEN 0 ELSE 1 END AS tp, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 6 = 0 THEN 1 ELSE 0 END AS fp, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 3 = 0 THEN 1 ELSE 0 END AS fn
FROM part""")
def dot_cases(spark, sf_dir):
    two = (F.col("p_partkey") % 90 + 10).cast("string")
    number = F.concat(F.lit("0.1"), two)
    # every third case isn't patched, or with the wrong digits
    patched = F.when(F.col("p_partkey") % 6 == 0, cf.dotify(number, F.concat(F.lit("1"), two))).when(F.col("p_partkey") % 3 == 0, number).otherwise(cf.dotify(number, two))
    expected = F.array(F.struct(number.alias("number"), two.alias("period")))
    score = review.case_score(F.concat(F.lit("값 "), number), F.concat(F.lit("값 "), patched), expected, F.when(F.col("p_partkey") % 5 == 0, "open"))
    return t(spark, sf_dir, "part").select("p_partkey", score.alias("s")).select("p_partkey", "s.*")


@query("SELECT o_orderkey, o_orderstatus = 'F' AND o_orderkey % 3 <> 0 AS same FROM orders")
def setup_applied(spark, sf_dir):
    wanted = {"locale": F.lit("ko"), "style": F.col("o_orderpriority")}
    got = {"locale": F.when(F.col("o_orderkey") % 3 != 0, "ko"), "style": F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("default")}
    return t(spark, sf_dir, "orders").select("o_orderkey", cf.same_setup(wanted, got).alias("same"))


@query("""
WITH f AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9]+ ?[-+*/=^_{}<>] ?[A-Za-z0-9]+')) AS latex FROM documents)
SELECT latex, NOT regexp_matches(latex, '[{}^_]') AS converted, CASE WHEN regexp_matches(latex, '[{}^_]') THEN 0 ELSE len(regexp_extract_all(latex, '[0-9]+')) END::INT AS numbers,
       CASE WHEN regexp_matches(latex, '[{}^_]') THEN 0 ELSE len(regexp_extract_all(latex, '[A-Za-z]')) END::INT AS letters FROM f""")
def formula_mathml(spark, sf_dir):
    from quillspark.functions.providers import FlatMathML

    found = docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+ ?[-+*/=^_{}<>] ?[A-Za-z0-9]+"), F.lit(0))).alias("latex"))
    done = speech.mathml(found, FlatMathML)
    tags = {c: F.coalesce(F.regexp_count("mathml", F.lit(f"<{tag}>")), F.lit(0)).alias(c) for c, tag in (("numbers", "mn"), ("letters", "mi"))}
    return done.select("latex", F.col("error").isNull().alias("converted"), *tags.values())


# --- normalization, speech and files over made-up texts -----------------------------------------------------------

#: Texts with a digit @ and what normalization makes of them.
_NORMALIZED = [
    ("3 × @", r"$3 \times @$"), ("(x+@)", "$(x+@)$"), (r"\(x+@\)", "$x+@$"), (r"\[x+@\]", "$$x+@$$"), (r"$\sqrt 1@$", r"$\sqrt{1@}$"), ("|x-@|", "$|x-@|$"), ("5. (3x+@)=7", "5. $(3x+@)=7$"), ("초$1-@$ 문제", "초1-@ 문제"),
    ("9=3^{@}", "$9=3^@$"), ("$@cm$", r"$@\mathrm{cm}$"), ("3.1@", "3.1@"), (r"2$\frac{1}{@}$", r"$2\frac{1}{@}$"), ("0.2̇@̇", r"$0.\dot{2}\dot{@}$"), ("넓이가 @x²이다", "넓이가 $@x^2$이다"), ("7. 다음 @번 물음", "7. 다음 @번 물음"), ("x:y=@:4일 때", "$x:y=@:4$일 때"),
    (r"$\angle A=@^{\circ}$", r"$\angle A=@°$"), (r"우유가 2\frac{@}{4}L", r"우유가 $2\frac{@}{4}$L"), ("(@)(2)에서", "(@)(2)에서"), (r"$p<q(p, @$는 소수)", r"$p<q$(p, @는 소수)"), (r"$$\begin{cases}\\ &-2.@\\ &\end{cases}$$", "$$-2.@$$"), (r"$x=\begin{cases} @ & (x는 짝수)\end{cases}$", r"$x=\begin{cases} @ & (x\text{는 짝수})\end{cases}$"),
]


@query("SELECT p_partkey, replace(list_extract([" + ", ".join(q(want) for _, want in _NORMALIZED) + f"], (p_partkey % {len(_NORMALIZED)} + 1)::INT), '@', (p_partkey % 8 + 2)::VARCHAR) AS norm_text FROM part")
def normalize_cases(spark, sf_dir):
    made = F.replace(F.element_at(F.array(*(F.lit(a) for a, _ in _NORMALIZED)), (F.col("p_partkey") % len(_NORMALIZED) + 1).cast("int")), F.lit("@"), (F.col("p_partkey") % 8 + 2).cast("string"))
    return normalize.normalize(t(spark, sf_dir, "part").select("p_partkey", made.alias("text"))).select("p_partkey", "norm_text")


@query("SELECT doc_id, md5(replace('흰색 정사각형 ' || text, '흰색 정사각형', '네모')) AS fixed FROM documents")
def misreads_fixed(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(cf.fix_misreads(F.concat(F.lit("흰색 정사각형 "), "text"))).alias("fixed"))


@query("""SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 2 THEN '' ELSE ' <say-as interpret-as="characters">A</say-as>' END AS inner_text FROM part""")
def ssml_inner(spark, sf_dir):
    body = F.concat(F.lit(" "), "p_name", F.lit(' <say-as interpret-as="character">A</say-as> '))
    k = F.col("p_partkey") % 3
    ssml = F.when(k == 0, F.concat(F.lit('<speak v="1"> <prosody rate="x">'), body, F.lit("</prosody></speak>"))).when(k == 1, F.concat(F.lit("<speak>"), body, F.lit("</speak>"))).otherwise(F.concat(F.lit("\n"), "p_name"))
    return t(spark, sf_dir, "part").select("p_partkey", cf.ssml_inner(ssml).alias("inner_text"))


@query("SELECT doc_id, md5(CASE WHEN doc_id % 4 = 0 THEN 'restored ' || doc_id ELSE text END) AS text FROM documents")
def restored_preferred(spark, sf_dir):
    restored = docs(spark, sf_dir).filter("doc_id % 4 = 0").select("doc_id", F.concat(F.lit("restored "), F.col("doc_id").cast("string")).alias("text"))
    return files.prefer_restored(docs(spark, sf_dir).select("doc_id", "text"), restored, "doc_id").select("doc_id", F.md5("text").alias("text"))


@query("SELECT count(*) FILTER (n_nationkey % 4 = 0) AS failures, CASE WHEN count(*) FILTER (n_nationkey % 4 = 0) > 0 THEN 1 ELSE 0 END AS exit_code FROM nation")
def synthesis_failures(spark, sf_dir):
    # a voice that has nothing to say gives a header alone
    texts = t(spark, sf_dir, "nation").select("n_name", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")).alias("text"))
    return sinks.failed(sinks.audio(texts, "n_name", "text"))


_V = [f'</voice><voice name="{v}">' for v in fx.VOICES]


@query(f"""
SELECT p_partkey, {q(fx.ENVELOPE[0] + fx.VOICES[0] + fx.ENVELOPE[1])} || 'A &amp; &lt;' || p_name || '&gt; x 더하기 ' || p_size || ' B 루트 ' || {q(_V[1])} || 'a 더하기 ' || p_partkey || {q(_V[0])} || ' C '
       || CASE WHEN p_partkey % 3 = 0 THEN p_size || ' &amp; D' ELSE '영 점 ' || d || ' ' || d || ' 반복 D' END || {q(fx.ENVELOPE[2])} AS content, 3 AS spans, true AS wellformed
FROM (SELECT *, {_KO.format("(p_partkey % 90 + 10)::VARCHAR")} AS d FROM part)""")
def render_ssml(spark, sf_dir):
    """Markup of texts with formulas: roots in another voice, repeating decimals, and what can only be salvaged."""
    size, k = F.col("p_size").cast("string"), F.col("p_partkey")
    two = (k % 90 + 10).cast("string")
    third = F.when(k % 3 == 0, F.concat(F.lit(r"$\mystery "), size, F.lit("$"))).otherwise(F.concat(F.lit(r"$0.\dot{"), F.left(two, F.lit(1)), F.lit(r"}\dot{"), F.right(two, F.lit(1)), F.lit("}$")))
    text = F.concat(F.lit(" A  & <"), "p_name", F.lit("> $x+"), size, F.lit(r"$  B $\sqrt{(a+"), k.cast("string"), F.lit(")}$ C "), third, F.when(k % 3 == 0, " &").otherwise(""), F.lit("  D\n"))
    return speech.render(t(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey", "text", ssml=True).select("p_partkey", "content", F.col("spans").cast("int").alias("spans"), F.col("xml_error").isNull().alias("wellformed"))


@query("""
SELECT id, CASE WHEN right(w, 1) <> '3' AND id % 2 = 0 THEN 'FIXED' WHEN right(w, 1) <> '3' THEN 'PASS' WHEN id % 2 = 0 THEN 'KNOWN' ELSE 'FAIL' END AS status
FROM (SELECT p_partkey AS id, (p_partkey % 97 + 2)::VARCHAR AS w FROM part)""")
def golden_speech(spark, sf_dir):
    """Golden cases whose inputs are normalized and spoken: a fraction and a power; a case is bad where a number ends in 3."""
    from quillspark.plans.pipelines import golden

    k, w = F.col("p_partkey"), (F.col("p_partkey") % 97 + 2).cast("string")
    cases = t(spark, sf_dir, "part").select(
        k.alias("id"), F.concat(F.lit("넓이는 3x² 이고 값은 \\frac{1}{"), w, F.lit("} 이다")).alias("input"), F.array(F.lit("3 x 제곱"), F.concat(w, F.lit(" 분의 1"))).alias("must"),
        F.array(F.lit("frac"), F.lit("3 분의 1 이다")).alias("mustnot"), F.when(k % 2 == 0, "open").alias("known"),
    )
    return golden(cases)


# --- runs, sinks and services ------------------------------------------------------------------------------------


@query(f"""
SELECT doc_id, detector, severity, doc_id % 2 AS batch FROM documents, {_DETECTORS} WHERE regexp_matches(text, p)
UNION ALL SELECT doc_id, '-', '-', doc_id % 2 FROM documents, (SELECT list(p) AS ps FROM {_DETECTORS}) WHERE len(list_filter(ps, lambda x: regexp_matches(text, x))) = 0""")
def resumed_run(spark, sf_dir):
    """A run over the documents with even ids, then one over all: it works off the others, in a batch of their own. Each stage keeps a manifest."""
    folder, rows = f"{shared_dir(spark)}/run", docs(spark, sf_dir).select("doc_id", "text")
    steps = [("clipped", lambda x: x.select("doc_id", cf.clip(F.col("text"), "source").alias("text"), F.lit(True).alias("seen"))), ("linted", lambda x: _linted(rows.join(x.select("doc_id"), "doc_id")))]
    runs.work_off(spark, folder, rows.filter("doc_id % 2 = 0"), "doc_id", steps)
    return runs.work_off(spark, folder, rows, "doc_id", steps)["linted"].rows().select("doc_id", "detector", "severity", "batch")


def _linted(rows):
    none = F.array(F.struct(F.lit("-").alias("detector"), F.lit("-").alias("severity"), F.lit("").alias("evidence")))
    found = rows.select("doc_id", lint.findings(F.col("text"), brackets=[]).alias("f"))
    return found.select("doc_id", F.explode(F.when(F.size("f") > 0, F.col("f")).otherwise(none)).alias("f")).select("doc_id", "f.detector", "f.severity")


@query("""
WITH f AS (SELECT text, min(doc_id) FILTER (doc_id % 3 = 0) AS early, min(doc_id) AS any_id FROM documents GROUP BY text)
SELECT md5(text) AS input, coalesce(early, any_id) AS doc_id, CASE WHEN early IS NULL THEN 1 ELSE 0 END AS batch FROM f""")
def append_suggestions(spark, sf_dir):
    """Suggestions of two batches, the second written twice: each input is there once."""
    path, rows = f"{shared_dir(spark)}/suggested", docs(spark, sf_dir).select(F.col("text").alias("input"), "doc_id")
    for part, batch in ((rows.filter("doc_id % 3 = 0"), 0), (rows, 1), (rows, 1)):
        table = sinks.append_once(part, path, "input", batch)
    return table.select(F.md5("input").alias("input"), "doc_id", "batch")


_HALVES = "SELECT doc_id, lang, list_distinct(regexp_extract_all(text, '[A-Z][a-z]+')) AS truth, list_distinct(regexp_extract_all(substr(text, 1, length(text) // 2), '[A-Z][a-z]+')) AS h, list_distinct(regexp_extract_all(lower(text) || ' ' || text, '[A-Z]?[a-z]{9,}')) AS w FROM documents"


@query(f"""
WITH w AS ({_HALVES}), s AS (SELECT doc_id, lang, len(list_intersect(h, truth)) AS btp, len(h) - len(list_intersect(h, truth)) AS bfp, len(truth) - len(list_intersect(h, truth)) AS bfn,
    len(list_intersect(w, truth)) AS atp, len(w) - len(list_intersect(w, truth)) AS afp, len(truth) - len(list_intersect(w, truth)) AS afn FROM w),
g AS (SELECT lang, doc_id, CASE WHEN grouping(doc_id) = 0 THEN 'page' WHEN grouping(lang) = 0 THEN 'group' ELSE 'total' END AS level, sum(btp)::BIGINT AS before_tp, sum(bfp)::BIGINT AS before_fp, sum(bfn)::BIGINT AS before_fn,
    sum(atp)::BIGINT AS after_tp, sum(afp)::BIGINT AS after_fp, sum(afn)::BIGINT AS after_fn FROM s GROUP BY GROUPING SETS ((lang, doc_id), (lang), ()))
SELECT *, before_tp / nullif(before_tp + before_fp, 0) AS before_precision, before_tp / nullif(before_tp + before_fn, 0) AS before_recall, after_tp / nullif(after_tp + after_fp, 0) AS after_precision,
    after_tp / nullif(after_tp + after_fn, 0) AS after_recall, after_fp + after_fn > 0 AS failed FROM g""")
def stage_scores(spark, sf_dir):
    """Two ways of finding names against all names of a text: for each document, language and in total, from one aggregation."""
    names = lambda c, p="[A-Z][a-z]+": F.array_distinct(F.regexp_extract_all(c, F.lit(p), F.lit(0)))
    text = F.col("text")
    found = {"before": names(F.substr(text, F.lit(1), F.floor(F.length(text) / 2).cast("int"))), "after": names(F.concat(F.lower(text), F.lit(" "), text), "[A-Z]?[a-z]{9,}")}
    each = F.array(*(F.struct(F.lit(s).alias("stage"), review.set_score(names(text), f).alias("s")) for s, f in found.items()))
    scores = docs(spark, sf_dir).select("doc_id", "lang", F.explode(each).alias("x")).select("doc_id", "lang", "x.stage", "x.s.*")
    return review.stage_scores(scores, "doc_id", ["lang"])


@query(r"""
WITH p AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE text END AS speech FROM documents),
c AS (SELECT doc_id, CASE WHEN length(speech) > 15000 THEN substr(speech, 1, 15000) || chr(10) || '...[speech truncated at 15000 chars]' ELSE speech END AS speech FROM p WHERE regexp_matches(speech, '[^\s]')),
w AS (SELECT doc_id, regexp_extract_all(speech, '[A-Za-z]+|[^A-Za-z]+') AS t FROM c)
SELECT doc_id, list_first(list_filter(list_transform(generate_series(1, len(t) - 2), lambda k: CASE WHEN t[k] = t[k + 2] AND t[k + 1] = ' ' AND regexp_matches(t[k], '[A-Za-z]') THEN t[k] || ' ' || t[k] END), lambda x: x IS NOT NULL)) AS quote, false AS failed FROM w""")
def judge_calls(spark, sf_dir):
    """A judge that is called for each page with speech, four calls at once in a task."""
    from quillspark.functions.providers import RepeatJudge

    pages = docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 9 == 0, "  ").otherwise(F.col("text")).alias("speech"), F.lit("").alias("source"))
    done = review.judge(pages, "speech", "source", RepeatJudge)
    return done.select("doc_id", F.get("findings", F.lit(0))["speech_quote"].alias("quote"), F.col("judge_error").isNotNull().alias("failed"))


@query("SELECT count(*) AS documents, sum(length(text))::BIGINT AS chars, count(*) FILTER (contains(text, '$')) AS dollars FROM documents")
def write_counters(spark, sf_dir):
    """Counters of a table that the tasks take while they write it."""
    path = f"{shared_dir(spark)}/written"
    seen = sinks.counted(docs(spark, sf_dir).select("doc_id", "text"), path, {"documents": F.count("*"), "chars": F.sum(F.length("text")), "dollars": F.count_if(F.contains("text", F.lit("$")))})
    return spark.createDataFrame([tuple(seen[n] for n in ("documents", "chars", "dollars"))], "documents long, chars long, dollars long")


@query("SELECT p_partkey % 7 = 0 AS broken, count(*) AS n, count(*) FILTER (p_partkey % 7 <> 0 AND p_partkey % 2 = 0) AS known, min(CASE WHEN p_partkey % 7 <> 0 THEN p_name END) AS first FROM part GROUP BY ALL")
def case_quarantine(spark, sf_dir):
    """Lines of cases, some of them cut off: what can't be read is kept apart, and nothing is lost."""
    path, k = f"{shared_dir(spark)}/cases", F.col("p_partkey")
    line = F.to_json(F.struct(k.cast("string").alias("id"), F.col("p_name").alias("input"), F.array("p_type").alias("must"), F.when(k % 2 == 0, "open").alias("known")))
    t(spark, sf_dir, "part").select(F.when(k % 7 == 0, F.left(line, F.length(line) - 5)).otherwise(line).alias("value")).write.text(path)
    good, bad = files.case_lines(spark, path)
    one = good.agg(F.lit(False).alias("broken"), F.count("*").alias("n"), F.count("known").alias("known"), F.min("input").alias("first"))
    return one.union(bad.agg(F.lit(True), F.count("*"), F.lit(0).cast("long"), F.lit(None).cast("string")))


@query("""
WITH f AS (SELECT 'S' || p_size AS key, arg_min(p_name, p_partkey) AS value FROM part GROUP BY p_size)
SELECT key, CASE WHEN key IN (SELECT 'S' || n_nationkey FROM nation) THEN (SELECT n_name FROM nation WHERE 'S' || n_nationkey = key) ELSE value END AS value FROM f
UNION SELECT 'S' || n_nationkey, n_name FROM nation""")
def env_precedence(spark, sf_dir):
    """Settings that several lines have: the first counts, and the environment before all of them."""
    lines = t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" S"), F.col("p_size").cast("string"), F.lit(" = '"), "p_name", F.lit("'")).alias("value"))
    own = t(spark, sf_dir, "nation").select(F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("value"))
    return files.settings(lines, order=["p_partkey"], environment=own)


@query("""
SELECT 'part_' || p_partkey AS input, 'part_' || p_partkey || '_' || k AS page, (k = 0 AND p_partkey % 5 = 0)::INT AS errors, p_partkey % 2 AS batch FROM part, (VALUES (0), (1)) v(k)""")
def inbox_review(spark, sf_dir):
    """A drop folder reviewed from files to findings, first half of its files, then all: the second run takes the new ones."""
    from quillspark.plans.pipelines import review_inbox, runs

    k, folder = F.col("p_partkey"), f"{shared_dir(spark)}/inbox"
    text = F.concat(F.when(k % 5 == 0, "x 빈 칸 ").otherwise(""), "p_name", F.lit("\f"), "p_type")
    found = t(spark, sf_dir, "part").select(F.concat(F.lit("part "), k.cast("string"), F.lit(".png")).alias("name"), F.encode(text, "UTF-8").alias("content"), k)
    for part in (found.filter(k % 2 == 0), found):
        review_inbox(spark, part.select("name", "content"), folder)
    rows = runs.Stage(spark, folder, "reviewed", "input").rows()
    return rows.select("input", "page", F.size(F.filter("lint", lambda x: x["severity"] == "error")).alias("errors"), "batch")
