"""Column functions, operators, files and streams on literals; every query against its SQL."""

import os
import random

import duckdb
import plain_speech
import pytest
from pyspark.sql import functions as F

from quillspark.functions import columns as cf
from quillspark.functions import fixed as fx
from quillspark.functions import speechspans, speechtext
from quillspark.functions.providers import ExpansionChat, NoChat, RuleSpeech, retried
from quillspark.operators import dots, lint, normalize, review, spans, speech
from quillspark.plans import catalogue, pipelines
from quillspark.sources import files, sinks
from quillspark.streaming import inbox

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = catalogue.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(str(tuple(map(plain, r))) for r in got.select(columns).collect()) == sorted(str(tuple(map(plain, r))) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


# --- normalization and spans


SPAN_CASES = [("plain", []), ("반지름이 $r$인", ["$r$"]), ("가격은 $5 이고 값은 $3(x+1)$", ["$3(x+1)$"]), ("$5달러$", []), ("보자:\n$$\nx\n$$\n답", ["$$\nx\n$$"]), ("$a\nb$", []), ("$ $ 원", ["$ $"]), ("$a$$b$", ["$a$", "$b$"]), ("$a$와 $b$의", ["$a$", "$b$"]), (r"$$\frac{1}{2}$$ 이므로 $x$", [r"$$\frac{1}{2}$$", "$x$"])]


def test_both_grammars_agree_on_dollars(spark):
    df = spark.createDataFrame(SPAN_CASES, "text string, want array<string>")
    for grammar in (fx.SPAN, fx.SPEECH_SPAN):
        for r in df.select("want", spans.span_array(F.col("text"), grammar).alias("got"), F.array_join(F.transform(spans.parts(F.col("text"), grammar), lambda p: p["body"]), "").alias("again"), "text").collect():
            assert r.got == r.want and r.again == r.text


def test_distinct_spans_keep_their_order(spark):
    assert one(spark, spans.distinct_spans(F.lit("$b$ $a$ $b$ $ c $"))) == ["$b$", "$a$", "$ c $"]


# --- lint


def test_lint(spark):
    text = "삼각형 A B C 는 t e x t 이고 \\alpha 와\n빈 칸, 중괄호 열고 x"
    got = {r.detector: (r.severity, r.evidence) for r in lint.lint(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")).collect()}
    assert set(got) == {"latex-residue", "empty-cell", "letter-spellout", "unbalanced-brackets"}
    assert got["unbalanced-brackets"][0] == "warn" and "\n" not in got["empty-cell"][1] and got["letter-spellout"][1].startswith("...") and "t e x t" in got["letter-spellout"][1]


# --- numbers


def test_readings(spark):
    lit = F.lit
    assert one(spark, cf.READINGS["A-name-first"](lit("0"), lit("1"), lit("23"))) == "순환소수 영 점 일, 순환마디 이삼"
    assert one(spark, cf.READINGS["B-boundary"](lit("0"), lit("1"), lit("23"))) == "영 점 일 다음 이삼이 반복"
    assert one(spark, cf.READINGS["B-boundary"](lit("0"), lit(""), lit("24"))) == "영 점 다음 이사가 반복"
    for fraction, want in ((r"\dot{2}\dot{4}", "영 점 이사 이사 반복"), (r"1\dot{2}\dot{3}", "영 점 일 이삼 이삼 반복"), (r"\dot{1}2\dot{3}", "영 점 일이삼 일이삼 반복"), (r"\dot{2}4", None), (r"\overline{23}", "영 점 이삼 이삼 반복"), (r"1\overline{23}", "영 점 일 이삼 이삼 반복")):
        assert one(spark, cf.read_repeating(lit("0"), lit(fraction))) == want == plain_speech.read_repeating("0", fraction)


def test_dots(spark):
    for number, period, want in (("0.245", "45", "0.24\u03075\u0307"), ("0.24", "4", "0.24\u0307"), ("0.123", "123", "0.1\u030723\u0307")):
        assert one(spark, cf.dotify(F.lit(number), F.lit(period))) == want
    assert [tuple(x) for x in one(spark, cf.dotted_numbers(F.lit("0.2\u03074\u0307, 1.1\\dot{2}\\dot{3} 3.5 0.2\u03074\u0307")))] == [("0.24", "24"), ("1.123", "23")]
    good = {"number": "0.24", "period": "24", "evidence": "x = 0.2424..."}
    text = "$x=0.2424...$ 0.24 10.24 0.245"

    def apply(proposals):
        rows = spark.createDataFrame([(text, proposals)], f"text string, p {dots.PROPOSALS}")
        return tuple(rows.select(dots.applied(F.col("text"), F.col("p")).alias("x")).first().x)

    assert apply([good])[0] == text.replace(" 0.24 ", " 0.2\u03074\u0307 ") and len(apply([good])[1]) == 1
    bad = [{**good, "period": "2"}, {**good, "evidence": "nowhere"}, {**good, "number": "24"}, {**good, "period": ""}, {**good, "number": None}]
    assert apply(bad)[0] == text and len(apply(bad)[1]) == 2 and apply(None) == (text, [])
    # patches add up, on the text as patched so far
    both = apply([good, {"number": "0.245", "period": "5", "evidence": "0.245"}, good])
    assert both[0] == "$x=0.2424...$ 0.2\u03074\u0307 10.24 0.245\u0307" and len(both[1]) == 2


def test_judge_reply(spark):
    finding = '{"findings": [{"category": "reading", "severity": "odd", "speech_quote": "삼 분의", "explanation": "why", "suggested_case": {"id": "a", "input": "b", "must": ["c"]}}, {"speech_quote": "not there", "explanation": "x"}, {"speech_quote": "삼"}]}'
    rows = [(1, "삼 분의 일", finding), (2, "삼", "no json"), (3, " \n\u3000", finding), (4, "삼", '{"other": 1}'), (5, None, finding), (6, "삼", None), (7, "삼", '{"findings": []}')]
    got = {r.k: r for r in review.judged(spark.createDataFrame(rows, "k int, speech string, reply string"), "speech", "reply").collect()}
    assert set(got) == {1, 2, 4, 6, 7} and [f.severity for f in got[1].findings] == ["warn"] and got[1].findings[0].suggested_case.id == "a"
    assert [got[k].judge_error is None for k in (1, 2, 4, 6, 7)] == [True, False, False, False, True] and all(got[k].findings == [] for k in (2, 4, 6, 7))


def test_restore_calls_only_where_it_pays(spark, tmp_path):
    class Counting(ExpansionChat):
        def json(self, system, user, temperature=None):
            open(f"{tmp_path}/{abs(hash(user))}", "w").close()
            return super().json(system, user, temperature)

    rows = [(1, "0.24 = 0.242424..."), (2, "no numbers"), (3, None), (4, "3.14 only")]
    got = {r.k: r.patched for r in dots.restore(spark.createDataFrame(rows, "k int, text string"), "k", "text", Counting).collect()}
    assert got == {1: "0.2\u03074\u0307 = 0.242424...", 2: "no numbers", 3: None, 4: "3.14 only"} and len(os.listdir(tmp_path)) == 1


# --- speech


def pieces(spark, column, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", column.alias("x")).collect()
    got = {r.k: r.x for r in rows}
    return [[tuple(p) for p in got[k]] if isinstance(got[k], list) else got[k] for k in range(len(texts))]


def test_segments(spark):
    cases = {
        r"\sqrt{2}": [("latex", r"\sqrt{2}")], r"\sqrt{3+2\sqrt{2}}": [("root", r"3+2\sqrt{2}")], r"x=\sqrt{a+b}+1": [("latex", "x="), ("root", "a+b"), ("latex", "+1")], r"\sqrt{(a+b)}": [("root", "a+b")],
        r"\sqrt{(a+b)(c+d)}": [("root", "(a+b)(c+d)")], r"\sqrt{a+b": [("latex", r"\sqrt{a+b")], r"0.\dot{3}=\frac{1}{3}": [("text", "영 점 삼 삼 반복"), ("latex", r"=\frac{1}{3}")], "0.24+x": [("latex", "0.24+x")],
    }
    assert pieces(spark, speechspans.segments(F.col("t"), True), list(cases)) == list(cases.values())
    text = r"값 $ $ $\frac{\text{가}}{2}$ 끝"
    assert pieces(spark, speechspans.parts(F.col("t")), [text]) == [[("prose", "값 "), ("prose", " "), ("prose", " "), ("latex", r"\frac{\text{가}}{2}"), ("prose", " 끝")]]


def test_generated_speech_as_in_plain_python(spark):
    rng = random.Random(9)
    make = lambda of, n, most: ["".join(rng.choice(of) for _ in range(rng.randint(0, most))) for _ in range(n)]
    texts = make(["x", "가", " ", "$", "$$", r"\text{가}", r"\text{", "}", "\n", "글 ", "$x$", "$ $", "{", r"\text{$}", "é"], 700, 14)
    assert pieces(spark, speechspans.parts(F.col("t")), texts) == [plain_speech.split_text(t) for t in texts]
    texts = make(["x", "+", r"\sqrt{", r"\sqrt {", "}", "{", "(", ")", "a", "2", "0.", "3", r"\dot{3}", r"\dot{2}", "4", r"\overline{24}", " ", r"\frac", r"\sqrtx", "\\", "1.5"], 1500, 14)
    for ssml in (False, True):
        assert pieces(spark, speechspans.segments(F.col("t"), ssml), texts) == [plain_speech.split_specials(t, ssml) for t in texts]
    texts = make(["<a>", "</a>", "<b x='1'>", "</b>", "<c/>", "x", "&amp;", "&", "<", ">", "&#12;", '<d y="2" />', "가", "</d>"], 1500, 8)
    assert [x is None for x in pieces(spark, speechspans.markup_error(F.col("t")), texts)] == [plain_speech.markup_ok(t) for t in texts]


def test_markup(spark):
    good = ["<speak a='1'>x<break time=\"2\"/> 3 &lt; &#52;</speak>", "<a/><b></b>", "", None]
    assert pieces(spark, speechspans.markup_error(F.col("t")), good) == [None] * 4
    bad = {"<a><b></a></b>": "</a> closes another element, or none, at character 6", "<a><b>x</b>": "<a> is never closed", "<a>a &amp b</a>": "a bare & at character 5", "<a>가 < b</a>": "a bare < at character 5", "a > b": "a bare > at character 2"}
    assert pieces(spark, speechspans.markup_error(F.col("t")), list(bad)) == list(bad.values())


def test_verbalizer():
    assert speechtext.verbalize(r"\frac{1}{2}+x^2") == "2 분의 1 더하기 x 제곱" and speechtext.verbalize(r"-3-\sqrt{2}") == "마이너스 3 빼기 루트 2" and speechtext.verbalize(r"5\mathrm{cm}") == "5 센티미터"
    for bad in (r"\weird", "x^", r"\frac{1}{2", "?"):
        with pytest.raises(speechtext.Unreadable):
            speechtext.verbalize(bad)


def test_salvage(spark):
    assert one(spark, cf.salvage(F.lit(r"\pm \sqrt{2}\text{ 가} \mystery*{x_1} \frac"))) == "플러스 마이너스 루트 2 가 x 1 분수"


def test_ladder_and_markup(spark):
    rows = [(1, r"값은 $\sqrt{a+b}$ & $x$"), (2, r"$\weird 7$"), (3, r"$\weird$"), (4, None), (5, "글  글")]
    df = spark.createDataFrame(rows, "k int, text string")
    got = {r.k: r for r in speech.render(df, "k", "text").collect()}
    assert got[1].content == "값은 루트 a 더하기 b & x" and got[2].content == "7" and got[3].content == f"[{fx.UNSUPPORTED}: \\weird]" and got[4].content == "" and got[5].content == "글 글"
    assert [(got[k].spans, got[k].ok, got[k].salvaged, got[k].unsupported) for k in (1, 2, 3, 4)] == [(2, 2, 0, 0), (1, 0, 1, 0), (1, 0, 0, 1), (0, 0, 0, 0)]
    xml = {r.k: r for r in speech.render(df, "k", "text", ssml=True).collect()}
    assert all(r.xml_error is None for r in xml.values()) and f'</voice><voice name="{fx.VOICES[1]}">a 더하기 b</voice>' in xml[1].content and "&amp;" in xml[1].content
    assert sinks.wellformed(spark.createDataFrame([("a", None), ("b", "x")], "content string, xml_error string")).collect()[0].content == "a\n"


def test_reading_aloud(spark):
    cases = [("ok", "x²+1", ["x 제곱 더하기 1"], None, None), ("bad", "x²", ["세제곱"], None, None), ("known", "x²", ["세제곱"], None, "open"), ("fixed", "x²", None, ["dollar"], "was open")]
    got = {r.id: r.status for r in pipelines.golden(spark.createDataFrame(cases, "id string, input string, must array<string>, mustnot array<string>, known string")).collect()}
    assert got == {"ok": "PASS", "bad": "FAIL", "known": "KNOWN", "fixed": "FIXED"}
    pages = pipelines.read_aloud(spark.createDataFrame([(1, "0.24 = 0.242424... 이다")], "k int, text string"), "k", "text", chat=ExpansionChat, service=RuleSpeech)
    assert pipelines.linted(pages, "k").first().errors == 0 and "이사 이사 반복" in pages.first().content


# --- review


def test_suggestions_and_report(spark):
    proposed = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), ("c", 4)], "input string, n int")
    known = spark.createDataFrame([("b",)], "input string")
    assert {(r.input, r.n) for r in review.fresh_suggestions(proposed, [known], "n").collect()} == {("a", 1), ("c", 4)}
    found = f"array<{review.FINDING}>"
    pages = spark.createDataFrame([("in", "p1", [("d", "error", "e")], [("math", "warn", "q", "", "r", "why", None)], None), ("in", "p2", [], [], None), ("in", "p3", [], [], "down")], f"input string, page string, lint array<struct<detector:string,severity:string,evidence:string>>, judge {found}, judge_error string")
    text = review.report(pages, "input", "page").first().report
    assert text == "## p1\n- lint [error] d: e\n- judge [warn] math: why\n    - speech: 'q'\n    - should say: 'r'\n\n## p2\n- clean\n\n## p3\n- JUDGE ERROR: down\n"


def test_scores(spark):
    rows = spark.createDataFrame([(["a", "b"], ["b", "c", "c"]), ([], [])], "t array<string>, g array<string>").select(review.set_score(F.col("t"), F.col("g")).alias("s")).select("s.*")
    assert tuple(review.micro_totals(rows).first()) == (1, 1, 1, 0.5, 0.5)
    assert review.micro_totals(rows.filter("tp = 0")).first().precision is None


def test_verdicts(spark):
    df = spark.createDataFrame([(True, None), (False, True), (True, False), (True, True), (False, False)], "f boolean, e boolean")
    assert [r.v for r in df.select(cf.verdict(F.col("f"), F.col("e")).alias("v")).collect()] == ["unverified", "MISS", "spurious?", "ok", "ok"]


# --- files and streams


@pytest.fixture
def folder(tmp_path):
    for name, text in {"b c.PNG": "page1\fpage2", "a.pdf": "x\fy", "n.txt": "no", "d.md": "# d", "d.norm.md": "n", "d.dots.md": "r", "d.expect": " Math ", "d.md.expect_dots": "# c\n0.24:24\nnone\n"}.items():
        (tmp_path / name).write_text(text)
    return f"file://{tmp_path}"


def test_sources(spark, folder):
    assert [r.name for r in files.images(spark, folder).collect()] == ["b c.PNG"] and {r.name for r in files.images(spark, folder, pdf=True).collect()} == {"b c.PNG", "a.pdf"}
    assert {r.name for r in files.markdown(spark, folder).collect()} == {"d.md", "d.dots.md"} and [r.name for r in files.cached_pages(spark, folder).collect()] == ["d.md"] and [r.text for r in files.normalized(spark, folder).collect()] == ["n"]
    assert [(r.name, r.expected) for r in files.expectations(spark, folder).collect()] == [("d", True)]
    assert [tuple(x) for x in files.dot_truths(spark, folder).first().truth] == [("0.24", "24")]
    pages = files.page_images(files.images(spark, folder, pdf=True).filter("name = 'a.pdf'"))
    assert [(r.name, r.page_no) for r in pages.collect()] == [("a_p01.png", 1), ("a_p02.png", 2)]
    read = files.recognise(files.images(spark, folder))
    assert {(r.stem, r.page_idx, r.text) for r in read.collect()} == {("b_c", 0, "page1"), ("b_c", 1, "page2")} and files.joined_pages(read).first().text == "page1\n\npage2"
    both = files.prefer_restored(files.cached_pages(spark, folder).withColumn("k", F.lit(1)), spark.createDataFrame([(1, "better")], "k int, text string"), "k")
    assert both.first().text == "better" and files.line(spark, "x").first().text == "x"


def test_cases_and_sinks(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"id": "a", "input": "x", "must": ["y"]}, {"id": "b", "input": "z", "known": "k"}]')
    rows = files.cases(spark, f"file://{tmp_path}/c.json").orderBy("id").collect()
    assert [(r.id, r.must, r.known) for r in rows] == [("a", ["y"], None), ("b", None, "k")]
    df = spark.createDataFrame([("n", "글\n둘")], "name string, t string")
    sinks.text_files(df, f"file://{tmp_path}/t", "name", "t")
    assert spark.read.text(f"file://{tmp_path}/t/name=n", wholetext=True).first().value == "글\n둘\n"
    sinks.json_lines(df, f"file://{tmp_path}/j")
    assert spark.read.json(f"file://{tmp_path}/j").first().t == "글\n둘"
    sinks.table(df, f"file://{tmp_path}/p", ["name"])
    assert spark.read.parquet(f"file://{tmp_path}/p").first().t == "글\n둘"
    assert sinks.changed(spark.createDataFrame([("a", "b"), ("a", "a"), ("a", None)], "text string, patched string")).count() == 1
    done = sinks.audio(df, "name", "t")
    assert done.first().ok and sinks.failed(done).first().exit_code == 0
    assert not sinks.audio(spark.createDataFrame([("e", None)], "name string, t string"), "name", "t").first().ok


def test_inbox_takes_each_file_once(spark, folder, tmp_path, tmp_path_factory):
    at = tmp_path_factory.mktemp("inbox")
    out, check = f"file://{at}/out", f"file://{at}/check"

    def run():
        inbox.work_off(inbox.files(spark, folder), files.recognise, out, check)
        return sorted(r.text for r in spark.read.parquet(out).collect())

    assert run() == ["page1", "page2", "x", "y"]
    (tmp_path / "e.jpeg").write_text("new")
    assert run() == ["new", "page1", "page2", "x", "y"]


def test_settings(spark):
    lines = spark.createDataFrame([(" A = 'b=c' ",), ("# X=1",), ("none",), ('B="2"',)], "value string")
    assert {(r.key, r.value) for r in files.settings(lines).collect()} == {("A", "b=c"), ("B", "2")}


def test_clip_and_stem(spark):
    assert one(spark, cf.clip(F.lit("abcdef"), "source", 3)) == "abc\n...[source truncated at 3 chars]" and one(spark, cf.clip(F.lit("abc"), "s", 3)) == "abc"
    assert one(spark, cf.safe_stem(F.lit("수학 (1).md"))) == "수학_1_md" and one(spark, cf.safe_stem(F.lit("!!"))) == "input"
    assert one(spark, cf.ssml_inner(F.lit('<speak><prosody rate="1"> <say-as interpret-as="character">x</say-as> </prosody></speak>'))) == '<say-as interpret-as="characters">x</say-as>'
    assert one(spark, cf.strip(F.lit("\u00a0 a\n\t "))) == "a"


def test_retries():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    assert retried(flaky, sleep=waits.append) == "ok" and waits == [10.0, 15.0]
    with pytest.raises(OSError, match="busy"):
        retried(lambda: (_ for _ in ()).throw(OSError("busy")), attempts=2, sleep=waits.append)
    assert NoChat().json("", "")["numbers"] == []


def test_whole_items_are_searched(spark, tmp_path):
    items = [(1, "short one"), (2, "first line\nsecond line of the item"), (3, "a first line of more than sixty characters, as the other query wants it\nand more"), (4, "word"), (5, None), (6, "")]
    texts = ["x " + items[1][1], "a short one here", items[2][1].split("\n")[0], "y\n" + items[2][1] + " z", "crossword", "none", None]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, catalogue.contains_whole_benchmark(spark, str(tmp_path)).collect()))
    assert got == [(d, i) for d, x in rows for i, p in items if x and p and p in x]
