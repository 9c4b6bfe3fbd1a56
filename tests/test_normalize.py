"""Normalization by its contract, as column expressions: fixed cases, what holds for any text, and plain Python over generated texts and whole tables."""

import os
import random

import plain_math
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import columns as cf
from quillspark.operators import normalize

# Texts of the contract and what must become of them; texts that must stay; repairs.
REWRITTEN = [
    ("넓이가 x²이다", "넓이가 $x^2$이다"), ("x ≤ 3", r"$x \leq 3$"), ("3 × 4", r"$3 \times 4$"), ("√n", r"$\sqrt{n}$"), ("원주율 π", "원주율 $\\pi$"), ("$x²$", "$x^2$"), ("3x", "$3x$"), ("x-y", "$x-y$"), ("2+3", "$2+3$"),
    ("(x+1)", "$(x+1)$"), ("$x^{2}$", "$x^2$"), ("$x^{10}$", "$x^{10}$"), ("$a_{1}$", "$a_1$"), ("$a_{10}$", "$a_{10}$"), (r"\(x+1\)", "$x+1$"), (r"\[x+1\]", "$$x+1$$"),
    (r"\begin{aligned}x&=1\\y&=2\end{aligned}", r"$$\begin{aligned}x&=1\\y&=2\end{aligned}$$"), ("$$x^2+1$$", "$$x^2+1$$"), (r"$\sqrt 10$", r"$\sqrt{10}$"), (r"$\sqrt a$", r"$\sqrt{a}$"), (r"$\sqrt(25)$", r"$\sqrt{25}$"),
    ("|x-2|", "$|x-2|$"), ("x:y=3:4일 때", "$x:y=3:4$일 때"), ("-2.4", "$-2.4$"), ("0.2\u03073\u0307", r"$0.\dot{2}\dot{3}$"), ("{(-2)⁴}", r"$\{(-2)^4\}$"),
]
LEFT_ALONE = ["x의 값", "A형과 B형", "3.14", "7. 다음 물음에 답하시오.", "가격은 $5달러$이다", "가격은 $5 이고 값은 $3(x+1)$", "$f(x)=2(x+1)$", "(1) 45", "중1-1 단원평가", "정비례 · 반비례", "자연수 2개의 합:", ""]
REPAIRED = [
    (r"$p\leq k<q(p, q$는 소수)", r"$p\leq k<q$(p, q는 소수)"), ("5. (3x+4)=7", "5. $(3x+4)=7$"), ("13÷4=3⋯1이다", r"$13\div 4=$몫 3 나머지 1이다"), ("1, 4, ⋯", "1, 4, …"), ("□ABCD", "사각형 ABCD"), ("□안", r"$\Box$안"), ("☐안", r"$\Box$안"),
    (r"2$\frac{1}{3}$", r"$2\frac{1}{3}$"), (r"우유가 2\frac{3}{4}L", r"우유가 $2\frac{3}{4}$L"), (r"$\sqrt{분산}$", r"$\sqrt{\text{분산}}$"), (r"\boxed{4}", r"$\Box 4$"), ("초$1-2$ 문제", "초1-2 문제"), ("sin 30°", "싸인 $30°$"),
    ("절맛값", "절댓값"), (r"$\angle A=90^{\circ}$", r"$\angle A=90°$"), (r"$5cm$", r"$5\mathrm{cm}$"), ("<div class='a'>글</div>", " 글 "), (r"9=3^{2}", "$9=3^2$"), (r"26=2\times13", r"$26=2\times 13$"),
    (r"$\Box\quad(a<0)$", r"$\Box, (a<0)$"), ("(3)(2)에서", "(3)(2)에서"), ("(2)(x+1)", "$(2)(x+1)$"), ("nested fraction + √ + ±", "nested fraction + 루트  + 플러스 마이너스 "),
    (r"$$\begin{cases}\\ &-2.4\\ &\end{cases}$$", "$$-2.4$$"), ("$ \\begin{array}{r}\n4\n\\end{array} $", "$$4$$"),
]

ALL = REWRITTEN + REPAIRED + [(t, t) for t in LEFT_ALONE]


def native(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: r.out for r in rows.select("k", normalize.normalized(F.col("text")).alias("out")).collect()}
    return [got[k] for k in range(len(texts))]


def test_fixed_cases(spark):
    texts = [t for t, _ in ALL]
    assert native(spark, texts) == [want for _, want in ALL]
    assert [plain_math.normalize(t) for t in texts] == [want for _, want in ALL]


def test_a_second_pass_changes_nothing(spark):
    once = native(spark, [t for t, _ in REWRITTEN] + LEFT_ALONE)
    assert native(spark, once) == once


def test_hidden_bodies_come_back(spark):
    (out,) = native(spark, [r"즉, $ \frac{(9\text{와 }12\text{의 공배수})}{(26\text{과 }13\text{의 공약수})} $의 꼴. $f=\begin{cases} x & (x는 짝수)\end{cases}$"])
    assert "\x00" not in out and "공배수" in out and r"\text{는 짝수}" in out


PIECES = [
    "x", "2", "3x", "+", "-", " ", "(", ")", "$", "$$", r"\(", r"\)", r"\[", r"\]", "{", "}", "^", "_", "가", "나다", "와 ", ".", ",", "|", ":", "√", "²", "³", "₁", "°", "\n", "&", r"\\", r"\text{", r"\text{가}", r"\frac{1}{2}", r"\frac", r"\sqrt",
    r"\begin{array}{c}", r"\begin{cases}", r"\end{cases}", r"\end{array}", r"\times", r"\pi ", r"\foo", "(1)", "[2] ", "3)", "1-2", "1. ", "sin ", "cos", "word", "nested", "^{2}", "_{1}", "^{q}", r"^{\circ}", "0.2\u0307", "≤", "□", "□ABC", r"\quad(", "5cm",
    "⋯", "=", "<", ">", "a", "·", "…", r"\boxed{가}", "é", "²cm", "<table><tr><td>", "</td></tr></table>", "<br>", "절맛값", "초", "tan", r"\sin", r"\frac{가}{나}", r"\div", "^{12}", "⁻",
]


def test_generated_texts_as_in_plain_python(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 24))) for _ in range(3000)]
    for text, got in zip(texts, native(spark, texts), strict=True):
        assert got == plain_math.normalize(text), text


def test_whole_documents_as_in_plain_python(spark):
    at = "/root/testdata/sf0.001"
    if not os.path.isdir(at):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    pages = spark.read.parquet(f"{at}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    rows = normalize.normalize(docs.select("doc_id", "text").union(pages)).collect()
    assert sum(r.text != r.norm_text for r in rows) > 20
    for r in rows:
        assert r.norm_text == plain_math.normalize(r.text), r.doc_id


def test_nothing_leaves_the_jvm(spark):
    plan = normalize.normalize(spark.createDataFrame([("x²",)], "text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_long_texts(spark):
    """Long runs, arguments and environments: no pattern's recursion grows with the text."""
    n = 20_000
    texts = [r"\frac{" + "a" * n + "}{" + "{b}" * n + "}", r"$\begin{array}{c}" + "x" * n + r"\end{array}$", "(" * 300 + "x+1" * n, "가" * n + "x²" * 500, "$" + "x" * n, r"\text{" * 500 + "}" * 500]
    assert [len(x) > 100 for x in native(spark, texts)] == [True] * len(texts)


def test_control_characters_stay(spark):
    assert native(spark, ["\x00\x01 x² \x02가 \\text{\x03}\x04", "\x000\x00", None]) == ["\x00\x01 $x^2$ \x02가 \x03\x04", "\x000\x00", None]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="x2+- ()$\\{}^_가나.,|:√²□\n<>abc&", max_size=40))
def test_any_text_survives(text):
    out = plain_math.normalize(text)
    assert isinstance(out, str)
    if not set(text) & set("\\$^_√²□<>(|:+-2"):
        assert out == text


def test_tables(spark):
    texts = ["<table border=1><tr><td>일</td><td> 월 </td></tr><tr><td></td></tr></table>", "<table><td>a</td></table>", "<table></table>"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(cf.table_lines(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == ["\n\n일 월\n\n", "\n\na\n\n", " "]


def test_cut_leaves_everything_in_place(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("(x)") for _ in range(rng.randint(0, 20))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cf.unclosed_cut(F.col("t")).alias("cut"), cf.looks_math(F.col("t")).alias("math"), cf.parens_balanced(F.col("t")).alias("even")).collect()
    for r in rows:
        assert r.cut == plain_math.cut(r.t) and r.math == plain_math.mathematical(r.t)
        depth = [r.t[: k + 1].count("(") - r.t[: k + 1].count(")") for k in range(len(r.t))] or [0]
        assert r.even == (depth[-1] == 0 and min(depth) >= 0)
