"""Normalization of one text in plain Python: what tests hold the column expressions against, over generated texts and whole tables."""

from __future__ import annotations

import re
from functools import reduce
from itertools import zip_longest

from quillspark.functions import fixed as fx

X, XI = re.DOTALL, re.DOTALL | re.IGNORECASE


def put(s, table, flags=0):
    """Rewrites in order: (pattern, texts and group numbers)."""
    for pattern, to in table:
        s = re.sub(pattern, lambda m, to=to: "".join(m[x] if isinstance(x, int) else x for x in to), s, flags=flags)
    return s


def words(s, table):
    return reduce(lambda t, pair: t.replace(*pair), dict(table).items(), s)


def cells(markup):
    found = [re.findall(fx.TABLE_CELL, row, XI) for row in re.findall(fx.TABLE_ROW, markup, XI) or [markup]]
    lines = [" ".join(filter(None, (re.sub(fx.TAG, " ", c).strip() for c in row))) for row in found]
    return "".join(["\n\n", "\n\n".join(filter(None, lines)), "\n\n"]) if any(lines) else " "


def repaired(s):
    s = re.sub("[☐▢]", "□", words(s, fx.TYPOS))
    s = re.sub(fx.TABLE, lambda m: cells(m[0]), s, flags=XI)
    for _, pattern, any_case, to in fx.REPAIRS:
        s = put(s, [(pattern, to)], XI if any_case else X)
    return s


def canonical(s):
    s = put(s, fx.ENVIRONMENT_ONCE)
    while True:
        tidy = put(s, fx.ENVIRONMENT_AGAIN, X)
        if tidy == s:
            break
        s = tidy
    s = put(s, [(fx.DEGREE, ["°"]), (f"([0-9]){fx.DOT_ABOVE}", [r"\dot{", 1, "}"])])
    for sign, table in (("^", fx.SUPERSCRIPTS), ("_", fx.SUBSCRIPTS)):
        s = re.sub(f"[{''.join(table)}]+", lambda m, sign=sign: f"{sign}{{{m[0]}}}", s).translate(str.maketrans(table))
    return put(s.translate(str.maketrans(fx.SYMBOLS)), fx.EXPRESSION).strip()


def mathematical(s):
    signs = [bool(re.search(p, s)) for p in fx.SIGNALS.values()]
    return (any(signs) or "(" in s and re.search("[0-9A-Za-z]", s) is not None) and re.search(fx.ENGLISH_WORD, s) is None


def cut(s):
    """Where the outermost parenthesis opens that never closes; the length if all close."""
    at = [len(s)]
    for k, c in enumerate(s):
        at = [*at, k] if c == "(" else at[:-1] if c == ")" and len(at) > 1 else at
    return at[1] if len(at) > 1 else len(s)


def numbered(s):
    m = re.match(fx.PROBLEM_NUMBER, s)
    return (m[1] + ". ", s[m.end() :]) if m else ("", s)


def marked(s):
    """The whole chain of list markers; its last goes back if it is a factor."""
    chain = re.match(f"(?:{fx.LIST_MARKER})*", s)[0]
    behind = s[len(chain) :]
    each = re.findall(fx.MARKER, chain)
    if each and behind.startswith("(") and not chain[-1].isspace() and mathematical(behind):
        behind = each.pop() + behind
    return "".join(f"{x} " for x in each), behind


def run_wrapped(run, before):
    core = run.strip(" .,:")
    if not core.strip("·⋅… ") or not mathematical(core):
        return words(run, fx.SAID_IN_PROSE) if re.search(fx.ENGLISH_WORD, core) and re.search(fx.SIGNALS["symbol"], core) else run
    if re.match("[가-힣]", before[-1:]) and re.fullmatch(fx.GRADE_RANGE, core):
        return run
    number, rest = numbered(core)
    if number and not mathematical(rest):
        number, rest = "", core
    marks, rest = marked(rest)
    if marks and not (rest.strip() and mathematical(rest)):
        return run
    bare = re.sub(r"\A[)\]}]+\s*", "", rest)
    if bare != rest and not mathematical(bare):
        return run
    formula, behind = bare[: cut(bare)], bare[cut(bare) :]
    if not formula.strip():
        return run
    head, tail = run[: len(run) - len(run.lstrip(" .,:"))], run[len(run.rstrip(" .,:")) :]
    return "".join([head, number, marks, rest[: len(rest) - len(bare)], "$", canonical(re.sub("[{}]", lambda m: "\\" + m[0], formula)), "$", behind, tail])


def prose(s):
    for word, said in fx.TRIG_WORDS.items():
        s = re.sub(rf"\b{word}(?![A-Za-z])\s*", said, s)
    if re.search(r"\\|[\^_]\{", s):
        s = put(s, [(fx.DEGREE, ["°"]), (fx.TEXT, [1]), (fx.TEXT_OPENS, [" "])])
        # what stands between fractions is made plain by itself, but the fractions are there as one character
        fractions = ["$" + m[1] + r"\frac{" + m[2] + "}{" + m[3] + "}$" for m in re.finditer(fx.FRACTION, s)]
        s = re.sub(fx.FRACTION, "\x01", s)
        for command, said in fx.PROSE_COMMANDS.items():
            s = re.sub(rf"\\{command}(?![A-Za-z]) ?", said, s)
        for sign, table in ((r"\^", fx.SUPERSCRIPTS), ("_", fx.SUBSCRIPTS)):
            chars = "".join(table.values())
            s = re.sub(sign + r"\{([" + re.escape(chars) + r"]{1,4})\}", lambda m, c=chars, t=table: m[1].translate(str.maketrans(c, "".join(t))), s)
        s = re.sub(fx.COMMAND, " ", s).replace("\\", " ")
        s = "".join(a + b for a, b in zip_longest(s.split("\x01"), fractions, fillvalue=""))
    s = re.sub(fx.INNER_MARKER, "\\1\x02\\2\x02", s, flags=re.MULTILINE)
    return re.sub(fx.RUN, lambda m: run_wrapped(m[0], s[: m.start()]), s).replace("\x02", "")


def line(body):
    number, rest = numbered(body)
    marks, rest = marked(rest)
    formula = rest[: cut(rest)]
    return number + marks + (f"${canonical(formula)}$" if formula.strip() else formula) + rest[cut(rest) :]


def shown(piece, before):
    fence = lambda a, b: piece.startswith(a) and piece.endswith(b)
    if fence("$$", "$$") or piece.startswith("\\begin"):
        return f"$${canonical(piece if piece.startswith('\\') else piece[2:-2])}$$"
    if fence("$", "$") and len(piece) > 1:
        label = re.match("[가-힣]", before) and re.fullmatch(fx.GRADE_RANGE, piece[1:-1].strip())
        return piece[1:-1].strip() if label else line(piece[1:-1])
    if fence("\\(", "\\)"):
        return line(piece[2:-2])
    return f"$${canonical(piece[2:-2])}$$" if fence("\\[", "\\]") else prose(piece)


def normalize(s):
    """Null stays null. Texts must be free of the first five control characters."""
    if s is None:
        return None
    s = repaired(s)
    kept = rf"(\\text\s*\{{[^{{}}]*\}})|({fx.HANGUL_RUN})"
    s = re.sub(fx.ENVIRONMENT, lambda e: re.sub(kept, lambda m: m[1] or "\\text{" + m[2] + "}", e[0]), s, flags=X)
    bodies, out = re.findall(fx.TEXT, s), ""
    for piece in re.split(f"({fx.SPAN})", re.sub(fx.TEXT, lambda m: "\\text{\x00}", s), flags=X):
        out += shown(piece, out[-1:]) if piece else ""
    return "".join(a + b for a, b in zip_longest(out.split("\x00"), bodies, fillvalue=""))
