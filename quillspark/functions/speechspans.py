"""Parts of a text and segments of a formula for speech, and a check of markup, by column expressions.

What nests is read by a fold over tokens with an array as its stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import columns as cf
from quillspark.functions import fixed as fx
from quillspark.functions.columns import let
from quillspark.functions.mathspans import restored, sub

_PLAIN, _ALL = "(?dU)", "(?dsU)"
#: A hidden body, the ends of a part, the ends of a root. Texts lose these characters, which no speech has.
_BODY, _PART, _ROOT, _END = "\x00", "\x01", "\x02", "\x03"
_MARKS = _BODY + _PART + _ROOT + _END


def _piece(kind: Column | str, body: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), body.alias("body"))


def parts(text: Column) -> Column:
    r"""Prose and formulas in order, as (kind: prose or latex, body); spans that hold nothing are a space of prose. Bodies of \text may hold anything."""

    def span(p: Column) -> Column:
        size = F.when(p.startswith("$$"), 2).otherwise(1)
        return let(cf.strip(F.substr(p, size + 1, F.length(p) - 2 * size)), lambda b: _piece(F.when(b == "", "prose").otherwise("latex"), F.when(b == "", " ").otherwise(b)))

    def cut(t: Column) -> Column:
        bodies = F.regexp_extract_all(t, F.lit(_PLAIN + fx.TEXT), F.lit(1))
        hidden = F.regexp_replace(t, _PLAIN + fx.TEXT, rf"\\text{{{_BODY}}}")
        fenced = F.regexp_replace(hidden, _ALL + fx.SPEECH_SPAN, f"{_PART}$0{_PART}")
        each = F.transform(F.split(restored(fenced, _BODY, bodies), _PART, -1), lambda p, k: F.when(k % 2 == 0, _piece("prose", p)).otherwise(span(p)))
        return F.filter(each, lambda p: p["body"] != "")

    return let(F.translate(text, _MARKS, ""), cut)


def _repeating(latex: Column) -> Column:
    """The formula with repeating decimals as they are read, each between marks."""

    def read(f: Column, _: Column) -> Column:
        said = cf.read_repeating(F.regexp_extract(f, _PLAIN + fx.REPEATING, 1), F.regexp_extract(f, _PLAIN + fx.REPEATING, 2))
        return let(said, lambda s: F.when(s.isNull(), f).otherwise(F.concat(F.lit(_PART), s, F.lit(_PART))))

    return sub(latex, _PLAIN + fx.REPEATING, read)


def _closed(inner: Column, frame: Column, what: str) -> Column:
    """A frame's text and segments with those of the group that ends in it."""
    group = F.concat(frame["opens"], inner["text"], F.lit("}"))
    if what == "text":
        return F.concat(frame["text"], group)
    root = frame["opens"].startswith("\\sqrt") & inner["text"].rlike(fx.COMPLEX_RADICAND)
    whole = F.concat(F.lit(_ROOT), inner["text"], F.lit(_END))
    return F.concat(frame["segs"], F.when(root, whole).otherwise(F.concat(frame["opens"], inner["segs"], F.lit("}"))))


def _rooted(latex: Column) -> Column:
    """The formula with its outermost roots of more than a number or letter between marks, a root that never closes left as it is."""
    tokens = F.regexp_extract_all(latex, F.lit(r"\\sqrt(?![a-zA-Z]) *\{|[{}]|[^{}\\]+|\\"), F.lit(0))
    frames = "array<struct<opens:string,text:string,segs:string>>"
    start = F.struct(F.array().cast(frames).alias("stack"), F.lit("").alias("text"), F.lit("").alias("segs"))

    def step(x: Column, t: Column) -> Column:
        opened = F.struct(F.array_append(x["stack"], F.struct(t.alias("opens"), x["text"].alias("text"), x["segs"].alias("segs"))).alias("stack"), F.lit("").alias("text"), F.lit("").alias("segs"))
        said = F.struct(x["stack"].alias("stack"), F.concat(x["text"], t).alias("text"), F.concat(x["segs"], t).alias("segs"))
        closed = let(F.element_at(x["stack"], -1), lambda f: F.struct(F.slice(x["stack"], F.lit(1), F.size(x["stack"]) - 1).alias("stack"), _closed(x, f, "text").alias("text"), _closed(x, f, "segs").alias("segs")))
        return F.when(t.endswith("{"), opened).when((t == "}") & (F.size(x["stack"]) > 0), closed).otherwise(said)

    # what never closes is text, and roots within it count
    end = F.aggregate(tokens, start, step)
    return let(end, lambda x: F.concat(F.array_join(F.transform(x["stack"], lambda f: F.concat(f["segs"], f["opens"])), ""), x["segs"]))


def _bare(body: Column) -> Column:
    """A radicand without the one pair of parentheses that holds all of it."""
    inner = F.substr(body, F.lit(2), F.length(body) - 2)
    return F.when((F.length(body) > 1) & body.startswith("(") & body.endswith(")") & let(inner, cf.parens_balanced), inner).otherwise(body)


def segments(latex: Column, ssml: bool) -> Column:
    """A formula as (kind: latex, text or root, body): ready text of repeating decimals, roots (for markup alone), and what stands around them."""

    def roots(s: Column) -> Column:
        cut = F.transform(F.split(_rooted(s), f"[{_ROOT}{_END}]", -1), lambda p, k: F.when(k % 2 == 0, _piece("latex", p)).otherwise(_piece("root", _bare(p))))
        return F.filter(F.when(s.contains("\\sqrt"), cut).otherwise(F.array(_piece("latex", s))), lambda p: (p["kind"] == "root") | (cf.strip(p["body"]) != ""))

    def cut(pieces: Column) -> Column:
        each = F.transform(pieces, lambda p, k: F.when(k % 2 == 1, F.array(_piece("text", p))).otherwise(roots(p) if ssml else F.array(_piece("latex", p))))
        # beside ready text, blank pieces are nothing
        return F.flatten(F.when(F.size(pieces) == 1, each).otherwise(F.transform(each, lambda e: F.filter(e, lambda p: (p["kind"] == "root") | (cf.strip(p["body"]) != "")))))

    return let(F.translate(latex, _MARKS, ""), lambda t: let(F.split(_repeating(t), _PART, -1), cut))


def markup_error(xml: Column) -> Column:
    """What is wrong with the nesting of tags or with single characters, the first of it; null if nothing is. More than one root is fine."""
    opens, closes, entity = fx.MARKUP
    token = f"{closes}|{opens}|{entity}|[<>&]"

    def steps(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(token), F.lit(0))
        placed = F.arrays_zip(found.alias("token"), F.slice(F.split(t, token, -1), F.lit(1), F.size(found)).alias("before"))
        start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("at"))

        def step(x: Column, p: Column) -> Column:
            tag, size = p["token"], F.size(x["open"])
            name = F.regexp_extract(tag, "^</?([^\\s/>]+)", 1)
            at = x["at"] + F.length(p["before"])
            wrong = F.concat(F.lit("a bare "), tag, F.lit(" at character "), at.cast("string"))
            end = F.when((size == 0) | (F.get(x["open"], size - 1) != name), F.concat(tag, F.lit(" closes another element, or none, at character "), at.cast("string")))
            next_open = F.when(tag.startswith("</"), F.slice(x["open"], F.lit(1), F.greatest(size - 1, F.lit(0)))).when(tag.startswith("<") & (name != "") & ~tag.endswith("/>"), F.array_append(x["open"], name)).otherwise(x["open"])
            error = F.when(F.length(tag) == 1, wrong).when(tag.startswith("</"), end)
            return F.when(x["error"].isNotNull(), x).otherwise(F.struct(next_open.alias("open"), error.alias("error"), (at + F.length(tag)).alias("at")))

        return F.aggregate(placed, start, step)

    left = lambda x: F.when(F.size(x["open"]) > 0, F.concat(F.lit("<"), F.element_at(x["open"], -1), F.lit("> is never closed")))
    return let(xml, lambda t: let(steps(t), lambda x: F.coalesce(x["error"], left(x))))
