"""Column functions: all run in the JVM, none needs Python on executors."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import fixed as fx

#: What Python's str.strip() takes off, for ends of a text.
_ENDS = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def gated(text: Column, sign: Callable[[Column], Column], becomes: Callable[[Column], Column]) -> Column:
    """becomes(text) where the text has the sign, else the text."""
    return let(text, lambda t: F.when(sign(t), becomes(t)).otherwise(t))


def template(to: Iterable[str | int]) -> str:
    """Texts and group numbers as a replacement."""
    return "".join(f"${x}" if isinstance(x, int) else x.replace("\\", "\\\\").replace("$", "\\$") for x in to)


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, _ENDS, "")


def clip(c: Column, label: str, limit: int = fx.CLIP_AT) -> Column:
    """The first `limit` characters and a line that says so; shorter texts as they are."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(f"\n...[{label} truncated at {limit} chars]"))).otherwise(c)


def escape_xml(c: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def safe_stem(c: Column) -> Column:
    """A file stem: runs of other than word characters and hyphens as one underscore; `input` if none is left."""
    name = F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\-]+", "_"), "^_+|_+$", "")
    return F.when(name == "", F.lit("input")).otherwise(name)


def origin(url: Column) -> Column:
    """Scheme and host of a URL."""
    return F.concat(F.parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.parse_url(url, F.lit("AUTHORITY")))


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(fx.IMAGE_SUFFIXES)


def read_digits(c: Column) -> Column:
    """Digits as compact Sino-Korean words."""
    return F.translate(c, "0123456789", fx.DIGITS)


def subject_particle(word: Column) -> Column:
    """The particle by whether the last syllable ends in a consonant."""
    code = F.ascii(F.right(word, F.lit(1))) - 0xAC00
    return F.when(code.between(0, 11171) & (code % 28 != 0), F.lit("이")).otherwise(F.lit("가"))


def reading_head(whole: Column, before: Column) -> Column:
    return F.concat(read_digits(whole), F.lit(f" {fx.POINT}"), F.when(before != "", F.concat(F.lit(" "), read_digits(before))).otherwise(F.lit("")))


def _named_first(whole: Column, before: Column, block: Column) -> Column:
    return F.concat(F.lit("순환소수 "), reading_head(whole, before), F.lit(", 순환마디 "), read_digits(block))


def _bounded(whole: Column, before: Column, block: Column) -> Column:
    words = read_digits(block)
    return F.concat(reading_head(whole, before), F.lit(" 다음 "), words, subject_particle(words), F.lit(f" {fx.REPEATS}"))


def _twice(whole: Column, before: Column, block: Column) -> Column:
    words = read_digits(block)
    return F.concat(reading_head(whole, before), F.lit(" "), words, F.lit(" "), words, F.lit(f" {fx.REPEATS}"))


#: Ways to read a repeating decimal, by name: (whole digits, digits before the block, block) -> text. Add more here.
READINGS = {"A-name-first": _named_first, "B-boundary": _bounded, "C-repeat-twice": _twice}


def read_repeating(whole: Column, fraction: Column) -> Column:
    r"""The reading of whole.fraction whose repeating digits carry \dot{} or \overline{}; null if digits follow the last dot."""
    marked = F.regexp_replace(F.regexp_replace(fraction, r"\\dot\{([0-9])\}", "<$1"), r"\\overline\{([0-9])([0-9]*)\}", "<$1$2=")
    over = fraction.contains("overline")
    before = F.regexp_extract(marked, "^([0-9]*)<", 1)
    block = F.regexp_replace(F.regexp_extract(marked, "^[0-9]*(<.*)$", 1), "[<=]", "")
    valid = over | marked.rlike(r"<[0-9]$")
    return F.when(valid, _twice(whole, before, block))


def same_setup(wanted: dict[str, Column], applied: dict[str, Column]) -> Column:
    """Whether each setting asked for is the one in effect; a missing one isn't."""
    same = F.lit(True)
    for name, value in wanted.items():
        same = same & F.coalesce(applied.get(name, F.lit(None)) == value, F.lit(False))
    return same


def table_lines(text: Column) -> Column:
    """Tables in a text as their cells' texts: a line for each row that has any, blank lines between; a space if none has."""
    table, row, cell = (f"(?isU){p}" for p in (fx.TABLE, fx.TABLE_ROW, fx.TABLE_CELL))

    def line(markup: Column) -> Column:
        cells = F.transform(F.regexp_extract_all(markup, F.lit(cell), 1), lambda c: strip(F.regexp_replace(c, fx.TAG, " ")))
        return F.array_join(F.filter(cells, lambda c: c != ""), " ")

    def lines(markup: Column) -> Column:
        rows = F.regexp_extract_all(markup, F.lit(row), 1)
        kept = F.filter(F.transform(F.when(F.size(rows) > 0, rows).otherwise(F.array(markup)), line), lambda x: x != "")
        return F.when(F.size(kept) > 0, F.concat(F.lit("\n\n"), F.array_join(kept, "\n\n"), F.lit("\n\n"))).otherwise(F.lit(" "))

    between = F.split(text, table, -1)
    tables = F.transform(F.regexp_extract_all(text, F.lit(table), 0), lines)
    return F.when(text.rlike(table), F.array_join(F.zip_with(between, F.concat(tables, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")).otherwise(text)


def repaired(text: Column) -> Column:
    """The whole-text rewrites of normalization, in their order; each where its sign is in the text."""
    for wrong, right in fx.TYPOS:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    text = let(F.translate(text, "☐▢", "□□"), table_lines)
    for sign, pattern, any_case, to in fx.REPAIRS:
        pattern = f"(?{'i' * any_case}dsU){pattern}"
        text = gated(text, lambda t, sign=sign: t.contains(sign), lambda t, pattern=pattern, to=to: F.regexp_replace(t, pattern, template(to)))
    return text


def needs_check(text: Column) -> Column:
    """A decimal and a sign of repetition: only such a text is worth a costly look."""
    return text.rlike(fx.DECIMAL) & text.rlike(fx.REPETITION)


def dotify(number: Column, period: Column) -> Column:
    """The number with dots above the first and last digit of its trailing period."""
    before = F.substr(number, F.lit(1), F.length(number) - F.length(period))
    inner = F.substr(period, F.lit(2), F.greatest(F.length(period) - 2, F.lit(0)))
    last = F.when(F.length(period) > 1, F.concat(F.right(period, F.lit(1)), F.lit(fx.DOT_ABOVE))).otherwise(F.lit(""))
    return F.concat(before, F.left(period, F.lit(1)), F.lit(fx.DOT_ABOVE), inner, last)


def bare(text: Column) -> Column:
    """Text for comparing quotes: no LaTeX delimiters, white space, dollars or backslashes."""
    return F.regexp_replace(F.regexp_replace(text, r"\\[()\[\]]", ""), r"(?U)[\s$\\\x1C-\x1F]+", "")


def dotted_numbers(text: Column) -> Column:
    """Distinct (number, period) of decimals with dotted digits, in order of appearance."""
    marked = F.regexp_replace(text, r"\\dot\{([0-9])\}", f"$1{fx.DOT_ABOVE}")
    tokens = F.filter(F.regexp_extract_all(marked, F.lit(f"[0-9]+\\.(?:[0-9]{fx.DOT_ABOVE}?)+"), 0), lambda t: t.contains(fx.DOT_ABOVE))
    return F.array_distinct(F.transform(tokens, lambda t: F.struct(
        F.replace(t, F.lit(fx.DOT_ABOVE), F.lit("")).alias("number"),
        F.replace(F.regexp_extract(t, f"\\.[0-9]*?([0-9]{fx.DOT_ABOVE}(?:.*[0-9]{fx.DOT_ABOVE})?)[0-9]*$", 1), F.lit(fx.DOT_ABOVE), F.lit("")).alias("period"),
    )))


#: Java tries a large class character by character; most characters are told from all symbols by this.
NOT_ASCII = r"(?=[^\x00-\x7F])"


def math_signals(text: Column) -> dict[str, Column]:
    """The signs of mathematics in a run, one flag each, and the sign against it."""
    flags = {f"sig_{name}": text.rlike((NOT_ASCII if name == "symbol" else "") + pattern) for name, pattern in fx.SIGNALS.items()}
    flags["sig_paren"] = text.contains("(") & text.rlike("[0-9A-Za-z]")
    flags["english"] = text.rlike(fx.ENGLISH_WORD)
    return flags


def looks_math(text: Column) -> Column:
    flags = math_signals(text)
    english, signs = flags.pop("english"), list(flags.values())
    found = signs[0]
    for s in signs[1:]:
        found = found | s
    return ~english & found


def strip_markup(text: Column) -> Column:
    """Structural tags as one space each."""
    return F.regexp_replace(text, f"(?is){fx.HTML_BLOCK}", " ")


def _walk(text: Column, opener: str, closer: str):
    """Folds over characters: depth, whether it ever went below zero, where the open group began (1-based, else 0)."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("below"), F.lit(0).alias("cut"), F.lit(0).alias("at"))
    only = F.filter(F.transform(F.split(text, ""), lambda c, k: F.struct(c.alias("c"), (k + 1).alias("k"))), lambda x: x["c"].isin(opener, closer))

    def step(a: Column, x: Column) -> Column:
        up = x["c"] == opener
        depth = F.when(up, a["depth"] + 1).otherwise(F.greatest(a["depth"] - 1, F.lit(0)))
        return F.struct(
            depth.alias("depth"), (a["below"] | (~up & (a["depth"] == 0))).alias("below"),
            F.when(up & (a["depth"] == 0), x["k"]).when(~up & (depth == 0), F.lit(0)).otherwise(a["cut"]).alias("cut"), x["k"].alias("at"),
        )

    return F.aggregate(only, start, step)


def parens_balanced(text: Column) -> Column:
    end = _walk(text, "(", ")")
    return ~end["below"] & (end["depth"] == 0)


def unclosed_cut(text: Column) -> Column:
    """Characters before the outermost parenthesis that never closes; the length if all close."""
    end = _walk(text, "(", ")")
    return F.when((end["depth"] > 0) & (end["cut"] > 0), end["cut"] - 1).otherwise(F.length(text))


def fix_misreads(speech: Column) -> Column:
    return F.replace(speech, F.lit(fx.MISREAD[0]), F.lit(fx.MISREAD[1]))


def salvage(latex: Column) -> Column:
    r"""Words of LaTeX that can't be parsed: \text bodies and known commands stay, the rest goes."""
    out = F.regexp_replace(latex, r"\\text\s*\{([^{}]*)\}", " $1 ")
    for command, word in fx.SALVAGED.items():
        out = F.regexp_replace(out, rf"\\{command}(?![a-zA-Z])\*?", f" {word} ")
    out = F.regexp_replace(out, r"\\[a-zA-Z]+\*?", " ")
    return strip(F.regexp_replace(F.regexp_replace(out, r"[\\{}$~&^_]", " "), r"(?U)\s+", " "))


def ssml_inner(ssml: Column) -> Column:
    """What stands in an SSML answer's envelope, the prosody element first."""
    prosody, speak = (F.regexp_extract(ssml, rf"(?s)<{tag}[^>]*>(.*)</{tag}>", 1) for tag in ("prosody", "speak"))
    inner = F.when(ssml.rlike("(?s)<prosody[^>]*>.*</prosody>"), prosody).when(ssml.rlike("(?s)<speak[^>]*>.*</speak>"), speak).otherwise(ssml)
    return strip(F.replace(inner, F.lit('interpret-as="character"'), F.lit('interpret-as="characters"')))


def verdict(found: Column, expected: Column) -> Column:
    """Whether finding agrees with the truth; unknown truth is unverified."""
    return F.when(expected.isNull(), "unverified").when(expected & ~found, "MISS").when(~expected & found, "spurious?").otherwise("ok")


def expectation(token: Column) -> Column:
    """True, false or unknown from a truth file's text."""
    t = F.lower(strip(token))
    return F.when(t.rlike("^(math|y|true|1)"), True).when(t.rlike("^(n|false|0)"), False)


def case_status(text: Column, must: Column, mustnot: Column, known: Column) -> Column:
    """PASS, FIXED (a known failure that passes), KNOWN or FAIL by contained and absent phrases."""
    empty = F.array().cast("array<string>")
    missing = F.exists(F.coalesce(must, empty), lambda p: ~text.contains(p))
    present = F.exists(F.coalesce(mustnot, empty), lambda p: text.contains(p))
    good, flagged = ~missing & ~present, F.coalesce(known, F.lit("")) != ""
    return F.when(good & ~flagged, "PASS").when(good, "FIXED").when(flagged, "KNOWN").otherwise("FAIL")


def voice_variants(text: Column, voice: str = fx.VOICES[0], pause: str = '<break time="400ms"/>') -> Column:
    """A text with {br} marks in two forms to compare by ear: (variant, ssml, content); a is plain, b has pauses at the marks."""
    a, b, c = fx.ENVELOPE
    body = F.replace(escape_xml(text), F.lit("{br}"), F.lit(pause))
    return F.array(
        F.struct(F.lit("a").alias("variant"), F.lit(False).alias("ssml"), F.replace(text, F.lit("{br}"), F.lit("")).alias("content")),
        F.struct(F.lit("b").alias("variant"), F.lit(True).alias("ssml"), F.concat(F.lit(a + voice + b), body, F.lit(c)).alias("content")),
    )
