"""Rewriting of math in mixed Korean and LaTeX text to canonical $..$ spans, by column expressions alone.

Whatever a pattern finds is rewritten by `sub`: the text between the finds and the finds are two arrays, which are
zipped again. Bodies that must stay out of sight are one mark each, and come back in their order, since
nothing moves. `let` names a value, so that an expression that needs it repeatedly computes it once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import columns as cf
from quillspark.functions import fixed as fx
from quillspark.functions.columns import gated, let, template

#: Python's reading of ., ^ and $ (line feeds alone) and of \s, \d, \w (all of Unicode).
_PLAIN, _LINES, _ALL = "(?dU)", "(?dmU)", "(?dsU)"
#: Marks of hidden bodies, of fractions in prose, around list markers, of new \text, and of these five characters where a text has them.
_BODY, _FRACTION, _MARKER, _NEW, _OWN = "\x00", "\x01", "\x02", "\x03", "\x04"
_CONTROLS = r"[\x00-\x04]"
_HANGUL = "[가-힣]"
#: fx.RUN as Java tries it fast: its ASCII characters first, the many others only for characters beyond ASCII.
_BEYOND = f"[[^\\x00-\\x7F]&&[{fx.DOT_ABOVE}{fx.ANY_SYMBOL}]]"
_RUN = f"[[{fx.RUN_ASCII}]{_BEYOND}](?:[[{fx.RUN_ASCII} ]{_BEYOND}]*[[{fx.RUN_ASCII}]{_BEYOND}])?"


def joined(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def sub(text: Column, pattern: str, becomes: Callable[[Column, Column], Column]) -> Column:
    """The text with each find as becomes(find, the text between it and the find before)."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(between, found, lambda b, f: F.when(f.isNull(), b).otherwise(F.concat(b, becomes(f, b)))), "")


def replaced(text: Column, table: dict[str, str] | Iterable[tuple[str, str]]) -> Column:
    for old, new in table.items() if isinstance(table, dict) else table:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def restored(text: Column, mark: str, bodies: Column) -> Column:
    """Each mark as the body of its number."""
    return F.array_join(F.zip_with(F.split(text, mark, -1), bodies, lambda t, b: F.concat(t, F.coalesce(b, F.lit("")))), "")


# --- expressions ----------------------------------------------------------------------------


def _again(s: Column) -> Column:
    for pattern, to in fx.ENVIRONMENT_AGAIN:
        s = F.regexp_replace(s, _ALL + pattern, template(to))
    return s


def tidied(s: Column) -> Column:
    """Environments without empty rows and cells; one of a single plain row is unwrapped. Each round but the last takes a row's end, a cell's or an environment."""

    def rounds(start: Column) -> Column:
        most = F.sequence(F.lit(0), F.regexp_count(start, F.lit(r"\\\\|&|\\begin")))
        first = F.struct(start.alias("s"), F.lit(False).alias("done"))
        return F.aggregate(most, first, lambda x, _: F.when(x["done"], x).otherwise(let(_again(x["s"]), lambda s: F.struct(s.alias("s"), (s == x["s"]).alias("done")))))["s"]

    def once(t: Column) -> Column:
        for pattern, to in fx.ENVIRONMENT_ONCE:
            t = F.regexp_replace(t, _PLAIN + pattern, template(to))
        return let(t, rounds)

    return gated(s, lambda t: t.rlike(r"&|\\\\|\\begin"), once)


def _beyond_ascii(s: Column) -> Column:
    s = F.regexp_replace(s, f"([0-9]){fx.DOT_ABOVE}", r"\\dot{$1}")
    for sign, table in (("^", fx.SUPERSCRIPTS), ("_", fx.SUBSCRIPTS)):
        s = F.translate(F.regexp_replace(s, f"[{''.join(table)}]+", sign + "{$0}"), "".join(table), "".join(table.values()))
    return replaced(s, {k: v for k, v in fx.SYMBOLS.items() if k != v})


def canonical(s: Column) -> Column:
    """The LaTeX of an expression."""
    s = gated(tidied(s), lambda t: t.contains("circ"), lambda t: F.regexp_replace(t, _PLAIN + fx.DEGREE, "°"))
    s = gated(s, lambda t: t.rlike(r"[^\x00-\x7F]"), _beyond_ascii)
    for pattern, to in fx.EXPRESSION:
        s = F.regexp_replace(s, _PLAIN + pattern, template(to))
    return cf.strip(s)


def printed(s: Column) -> Column:
    """The LaTeX of an expression whose braces are characters of the text, not groups."""
    return canonical(F.regexp_replace(s, r"[{}]", r"\\$0"))


# --- parts of a formula that are prose ----------------------------------------------------------

_NUMBER, _CHAIN = rf"{_PLAIN}\A{fx.PROBLEM_NUMBER}", rf"{_PLAIN}\A(?:{fx.LIST_MARKER})+"
_ONE_MARKER = rf"{_PLAIN}({fx.MARKER})"


def _numbered(s: Column) -> Column:
    """(lead, rest): a problem number at the beginning as it is written before a formula."""
    found = F.struct(joined(F.regexp_extract(s, _NUMBER, 1), ". ").alias("lead"), F.regexp_replace(s, _NUMBER, "").alias("rest"))
    return F.when(s.rlike(_NUMBER), found).otherwise(F.struct(F.lit("").alias("lead"), s.alias("rest")))


def _marked(s: Column) -> Column:
    """(lead, rest): the chain of list markers at the beginning. Its last is a factor if a parenthesis adjoins it that looks like mathematics."""

    def parts(chain: Column, behind: Column) -> Column:
        factor = behind.startswith("(") & ~chain.rlike(_PLAIN + r"\s\z") & cf.looks_math(behind)
        last = F.when(factor, F.regexp_extract(chain, _ONE_MARKER + r"\z", 1)).otherwise(F.lit(""))
        return let(last, lambda x: F.struct(
            F.regexp_replace(F.left(chain, F.length(chain) - F.length(x)), _ONE_MARKER + r"\s*", "$1 ").alias("lead"),
            F.concat(x, behind).alias("rest"),
        ))

    whole = F.struct(F.lit("").alias("lead"), s.alias("rest"))
    return let(F.regexp_extract(s, _CHAIN, 0), lambda c: F.when(c == "", whole).otherwise(let(F.substr(s, F.length(c) + 1), lambda b: parts(c, b))))


def _cut(s: Column) -> Column:
    """(formula, behind): behind begins at the outermost parenthesis that never closes."""
    at = F.when(s.contains("("), cf.unclosed_cut(s)).otherwise(F.length(s))
    return let(at, lambda k: F.struct(F.left(s, k).alias("formula"), F.substr(s, k + 1).alias("behind")))


def _inline(body: Column) -> Column:
    """(before, formula, behind) of an inline span; formula is null where nothing of one is left."""

    def after(number: Column, marks: Column) -> Column:
        return let(_cut(marks["rest"]), lambda c: F.struct(
            F.concat(number["lead"], marks["lead"], F.when(cf.strip(c["formula"]) == "", c["formula"]).otherwise(F.lit(""))).alias("before"),
            F.when(cf.strip(c["formula"]) != "", c["formula"]).alias("formula"), c["behind"].alias("behind"),
        ))

    return let(_numbered(body), lambda n: let(_marked(n["rest"]), lambda m: after(n, m)))


def _read(core: Column) -> Column:
    """(before, formula, behind) of a run in prose; null where it is no formula."""

    def closed(lead: Column, rest: Column) -> Column:
        bare = F.ltrim(rest, F.lit(")]}"))
        bare = F.when(rest.rlike(r"\A[)\]}]"), F.regexp_replace(bare, _PLAIN + r"\A[\s\x1C-\x1F]+", "")).otherwise(rest)
        return let(bare, lambda b: F.when((b == rest) | cf.looks_math(b), let(_cut(b), lambda c: F.when(
            cf.strip(c["formula"]) != "",
            F.struct(F.concat(lead, F.left(rest, F.length(rest) - F.length(b))).alias("before"), c["formula"].alias("formula"), c["behind"].alias("behind")),
        ))))

    def marked(number: Column, rest: Column) -> Column:
        return let(_marked(rest), lambda m: F.when(
            (m["lead"] == "") | ((cf.strip(m["rest"]) != "") & cf.looks_math(m["rest"])), closed(F.concat(number, m["lead"]), m["rest"])
        ))

    def numbered(n: Column) -> Column:
        counts = (n["lead"] != "") & cf.looks_math(n["rest"])
        return marked(F.when(counts, n["lead"]).otherwise(F.lit("")), F.when(counts, n["rest"]).otherwise(core))

    return let(_numbered(core), numbered)


def wrapped_run(run: Column, between: Column) -> Column:
    """A run of formula characters in prose, wrapped where it is mathematics. between: the text that ends before it."""

    def wrap(core: Column) -> Column:
        graded = F.right(between, F.lit(1)).rlike(_HANGUL) & core.rlike(rf"{_PLAIN}\A(?:{fx.GRADE_RANGE})\z")
        said = F.when(core.rlike(cf.NOT_ASCII + fx.SIGNALS["symbol"]), replaced(run, fx.SAID_IN_PROSE)).otherwise(run)
        ends = F.regexp_extract(run, r"\A[ .,:]*", 0), F.regexp_extract(run, r"[ .,:]*\z", 0)
        spoken = let(F.when(~graded, _read(core)), lambda r: F.when(r.isNull(), run).otherwise(joined(ends[0], r["before"], "$", printed(r["formula"]), "$", r["behind"], ends[1])))
        return F.when(core.rlike(fx.ENGLISH_WORD), said).when((F.btrim(core, F.lit("·⋅… ")) != "") & cf.looks_math(core), spoken).otherwise(run)

    # letters alone are neither mathematics nor symbols that are said
    return F.when(run.rlike("[^A-Za-z .,]"), let(F.btrim(run, F.lit(" .,:")), wrap)).otherwise(run)


# --- prose -----------------------------------------------------------------------------------------


def _scripts(s: Column, sign: str, table: dict[str, str]) -> Column:
    """Scripts in braces as characters, where each of one to four has one."""
    plain = "".join(v for v in table.values())
    pattern = sign + r"\{([" + plain.replace("-", r"\-") + r"]{1,4})\}"
    return gated(s, lambda t: t.rlike(pattern), lambda t: sub(t, pattern, lambda f, _: F.translate(F.regexp_extract(f, pattern, 1), plain, "".join(table))))


def _plain(s: Column) -> Column:
    """Prose without LaTeX: known commands and scripts as characters, fractions as spans, the rest dropped."""
    s = F.regexp_replace(s, _PLAIN + fx.DEGREE, "°")
    s = F.regexp_replace(F.regexp_replace(s, _PLAIN + fx.TEXT, "$1"), _PLAIN + fx.TEXT_OPENS, " ")

    def rest(t: Column) -> Column:
        fractions = F.transform(F.regexp_extract_all(t, F.lit(_PLAIN + fx.FRACTION), F.lit(0)), lambda f: F.regexp_replace(f, _PLAIN + fx.FRACTION, r"\$$1\\frac{$2}{$3}\$"))
        t = F.regexp_replace(t, _PLAIN + fx.FRACTION, _FRACTION)
        for command, said in fx.PROSE_COMMANDS.items():
            t = F.regexp_replace(t, rf"\\{command}(?![A-Za-z]) ?", said)
        t = _scripts(_scripts(t, r"\^", fx.SUPERSCRIPTS), "_", fx.SUBSCRIPTS)
        t = F.replace(F.regexp_replace(t, fx.COMMAND, " "), F.lit("\\"), F.lit(" "))
        return restored(t, _FRACTION, fractions)

    return let(s, rest)


def prose(part: Column) -> Column:
    for word, said in fx.TRIG_WORDS.items():
        part = gated(part, lambda t, w=word: t.contains(w), lambda t, w=word, to=said: F.regexp_replace(t, rf"{_PLAIN}(?<![\p{{L}}\p{{N}}_]){w}(?![A-Za-z])\s*", to))
    part = gated(part, lambda t: t.rlike(r"\\|[\^_]\{"), _plain)
    part = F.regexp_replace(part, _LINES + fx.INNER_MARKER, f"$1{_MARKER}$2{_MARKER}")
    return F.replace(let(part, lambda t: sub(t, _RUN, wrapped_run)), F.lit(_MARKER), F.lit(""))


# --- whole texts --------------------------------------------------------------------------------------


def _shown(piece: Column) -> Column:
    """(out, label): what becomes of a piece, and the bare text that it is instead behind Hangul, if it may be a label."""
    inner = lambda n: F.substring(piece, n + 1, F.length(piece) - 2 * n)
    between = lambda a, b: piece.startswith(a) & piece.endswith(b)
    dollars, begins, dollar = between("$$", "$$"), piece.startswith("\\begin"), between("$", "$") & (F.length(piece) > 1)
    # a block is a formula as a whole
    block = F.when(dollars, inner(2)).when(begins, piece).when(~dollar & between("\\[", "\\]"), inner(2))
    line = F.when(~dollars & dollar, inner(1)).when(between("\\(", "\\)"), inner(2))

    def written(kind: Column) -> Column:
        parts = F.when(kind["block"].isNotNull(), F.struct(F.lit("").alias("before"), kind["block"].alias("formula"), F.lit("").alias("behind"))).otherwise(_inline(kind["line"]))
        sign = F.when(kind["block"].isNotNull(), "$$").otherwise("$")
        spoken = let(parts, lambda p: F.concat(p["before"], F.when(p["formula"].isNull(), "").otherwise(F.concat(sign, canonical(p["formula"]), sign)), p["behind"]))
        bare = cf.strip(kind["line"])
        return F.struct(
            F.when(kind["block"].isNull() & kind["line"].isNull(), prose(piece)).otherwise(spoken).alias("out"),
            F.when(piece.startswith("$") & bare.rlike(rf"{_PLAIN}\A(?:{fx.GRADE_RANGE})\z"), bare).alias("label"),
        )

    return let(F.struct(block.alias("block"), line.alias("line")), written)


def _pieces(text: Column) -> Column:
    """Spans and what stands between them, without empty pieces."""
    between, spans = F.split(text, _ALL + fx.SPAN, -1), F.regexp_extract_all(text, F.lit(_ALL + fx.SPAN), F.lit(0))
    return F.filter(F.flatten(F.zip_with(between, spans, lambda b, s: F.array(b, F.coalesce(s, F.lit(""))))), lambda p: p != "")


def _spoken(text: Column) -> Column:
    def shown(outs: Column) -> Column:
        first = F.array(F.lit(None).cast("struct<out:string,label:string>"))
        before = F.concat(first, F.slice(outs, F.lit(1), F.greatest(F.size(outs) - 1, F.lit(0))))
        label = lambda x, y: x["label"].isNotNull() & F.coalesce(F.right(y["out"], F.lit(1)).rlike(_HANGUL), F.lit(False))
        return F.array_join(F.zip_with(outs, before, lambda x, y: F.when(label(x, y), x["label"]).otherwise(F.coalesce(x["out"], F.lit("")))), "")

    return let(F.transform(_pieces(text), _shown), lambda outs: F.when(F.size(outs) > 0, shown(outs)).otherwise(F.lit("")))


def _hangul_hidden(text: Column) -> Column:
    r"""Hangul in environments, outside \text, becomes \text."""
    word = rf"(\\text\s*\{{[^{{}}]*\}})|({fx.HANGUL_RUN})"
    become = lambda e: replaced(F.regexp_replace(e, _PLAIN + word, f"$1{_NEW}{{$2}}"), [(_NEW + "{}", ""), (_NEW, "\\text")])
    return gated(text, lambda t: t.contains("\\begin") & t.rlike(_HANGUL), lambda t: sub(t, _ALL + fx.ENVIRONMENT, lambda e, _: become(e)))


def _bodies_hidden(text: Column) -> Column:
    def hide(t: Column) -> Column:
        bodies = F.regexp_extract_all(t, F.lit(_PLAIN + fx.TEXT), F.lit(1))
        return restored(_spoken(F.regexp_replace(t, _PLAIN + fx.TEXT, rf"\\text{{{_BODY}}}")), _BODY, bodies)

    return let(_hangul_hidden(text), hide)


def wrapped(text: Column) -> Column:
    """A repaired text with all its mathematics in canonical spans. The five first control characters stay as they are."""

    def hide(t: Column) -> Column:
        own = F.regexp_extract_all(t, F.lit(_CONTROLS), F.lit(0))
        return restored(_bodies_hidden(F.regexp_replace(t, _CONTROLS, _OWN)), _OWN, own)

    return let(text, hide)
