"""Parts, segments and markup of one text in plain Python: what tests hold the column expressions against."""

from __future__ import annotations

import re

from quillspark.functions import fixed as fx

_SPAN = re.compile(fx.SPEECH_SPAN, re.DOTALL)
_REPEATING = re.compile(fx.REPEATING)
_DIGITS = str.maketrans("0123456789", fx.DIGITS)


def split_text(text: str) -> list[tuple[str, str]]:
    """(prose or latex, body) parts in order; spans that hold nothing are a space of prose."""
    bodies = iter(re.findall(fx.TEXT, text))
    hidden = re.sub(fx.TEXT, lambda m: "\\text{\x00}", text)
    restored = lambda s: re.sub(r"(?<=\\text\{)\x00(?=\})", lambda _: next(bodies), s)
    out, at = [], 0
    for m in [*_SPAN.finditer(hidden), None]:
        before = restored(hidden[at : m.start() if m else None])
        if before:
            out.append(("prose", before))
        if m:
            body = restored(m[0].strip("$") if not m[0].startswith("$$") else m[0][2:-2]).strip()
            out.append(("latex", body) if body else ("prose", " "))
            at = m.end()
    return out


def read_repeating(whole: str, fraction: str) -> str | None:
    """Digits before the block once, the block twice; None if digits follow the last dotted one."""
    before, mark, block = re.sub(r"\\dot\{(\d)\}", r"<\1", fraction.replace("\\overline{", "<").replace("}", "" if "overline" in fraction else "}")).partition("<")
    if not mark or ("overline" not in fraction and not re.search(r"\\dot\{\d\}$", fraction)):
        return None
    words = block.replace("<", "").translate(_DIGITS)
    head = [whole.translate(_DIGITS), fx.POINT, *([before.translate(_DIGITS)] if before else [])]
    return " ".join([*head, words, words, fx.REPEATS])


def split_repeating(latex: str) -> list[tuple[str, str]]:
    """Repeating decimals as ready text, the LaTeX around them as it is."""
    out, at = [], 0
    for m in _REPEATING.finditer(latex):
        said = read_repeating(m[1], m[2])
        if said is not None:
            out += [("latex", latex[at : m.start()]), ("text", said)]
            at = m.end()
    return [s for s in [*out, ("latex", latex[at:])] if s[1].strip()] if out else [("latex", latex)]


def _group_end(s: str, start: int) -> int:
    """The index behind the brace group that opens at start, or -1."""
    depth = 0
    for at in range(start, len(s)):
        depth += {"{": 1, "}": -1}.get(s[at], 0)
        if not depth:
            return at + 1
    return -1


def _one_pair(s: str) -> bool:
    """Whether parentheses are balanced, never closing before they open."""
    depth = 0
    for c in s:
        depth += {"(": 1, ")": -1}.get(c, 0)
        if depth < 0:
            return False
    return depth == 0


def split_radicals(latex: str) -> list[tuple[str, str]]:
    """Outermost roots of more than a number or letter as segments of their own."""
    out, plain, at = [], 0, 0
    for m in re.finditer(r"\\sqrt(?![a-zA-Z]) *(?=\{)", latex):
        if m.start() < at:
            continue
        end = _group_end(latex, m.end())
        body = latex[m.end() + 1 : end - 1]
        if end < 0 or not re.search(fx.COMPLEX_RADICAND, body):
            continue
        if len(body) > 1 and body[0] == "(" and body[-1] == ")" and _one_pair(body[1:-1]):
            body = body[1:-1]
        out += [("latex", latex[plain : m.start()]), ("root", body)]
        plain = at = end
    return [s for s in [*out, ("latex", latex[plain:])] if s[0] == "root" or s[1].strip()]


def split_specials(latex: str, ssml: bool) -> list[tuple[str, str]]:
    return [piece for kind, body in split_repeating(latex) for piece in (split_radicals(body) if ssml and kind == "latex" else [(kind, body)])]


def markup_ok(xml: str) -> bool:
    """Tags taken off by pairs, the innermost first; what is left must have no tag, and no sign that only a reference may have."""
    opens, closes, entity = fx.MARKUP
    tokens = [m for m in re.findall(f"({closes})|({opens})|({entity})|([<>&])", xml)]
    if any(bad for *_, bad in tokens):
        return False
    tags = [(c or o) for c, o, _, _ in tokens if (c or o) and not (o and o.endswith("/>"))]
    names = [("/" if t.startswith("</") else "") + re.match(r"</?([^\s/>]+)", t)[1] for t in tags]
    while True:
        pair = next((k for k in range(len(names) - 1) if names[k + 1] == "/" + names[k]), None)
        if pair is None:
            return not names
        del names[pair : pair + 2]
