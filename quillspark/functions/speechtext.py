"""A small verbalizer of formulas: the row function behind the speaking stand-in."""

from __future__ import annotations

import re


class Unreadable(ValueError):
    """LaTeX that the verbalizer doesn't know."""


# Words of the verbalizer.
_WORDS = {
    "+": "더하기", "=": "는", "<": "작다", ">": "크다", "*": "곱하기", "/": "나누기", ",": "콤마", ":": "콜론", "(": "괄호 열고", ")": "괄호 닫고", "[": "대괄호 열고", "]": "대괄호 닫고", "|": "절댓값", "°": "도", ".": "점",
    r"\times": "곱하기", r"\div": "나누기", r"\cdot": "곱하기", r"\pm": "플러스 마이너스", r"\leq": "작거나 같다", r"\geq": "크거나 같다", r"\neq": "같지 않다", r"\pi": "파이", r"\infty": "무한대", r"\angle": "각", r"\triangle": "삼각형",
    r"\equiv": "합동", r"\perp": "수직", r"\parallel": "평행", r"\Box": "네모", r"\alpha": "알파", r"\beta": "베타", r"\gamma": "감마", r"\theta": "세타", r"\lambda": "람다", r"\mu": "뮤", r"\sigma": "시그마", r"\phi": "파이", r"\omega": "오메가",
    r"\rho": "로", r"\Delta": "델타", r"\sin": "싸인", r"\cos": "코싸인", r"\tan": "탄젠트", r"\in": "원소", r"\to": "오른쪽 화살표", r"\sim": "닮음", r"\{": "중괄호 열고", r"\}": "중괄호 닫고", r"\quad": "", r"\,": "", r"\ ": "", "~": "",
}
_UNITS = {"cm": "센티미터", "mm": "밀리미터", "km": "킬로미터", "kg": "킬로그램", "mL": "밀리리터", "ml": "밀리리터"}
_POWERS = {"2": "제곱", "3": "세제곱"}


def verbalize(latex: str) -> str:
    """Korean words of simple formulas: numbers, letters, operators, fractions, roots, scripts. Else Unreadable."""
    tokens = re.findall(r"\\[A-Za-z]+|\\.|\d+(?:\.\d+)?|\S", latex)
    at = 0

    def group() -> list[str]:
        nonlocal at
        if at >= len(tokens):
            raise Unreadable(latex)
        if tokens[at] != "{":
            return atom()
        at += 1
        out = many("}")
        at += 1
        return out

    def many(end: str | None) -> list[str]:
        out: list[str] = []
        while at < len(tokens) and tokens[at] != end:
            out += atom(first=not out or out[-1] in _WORDS.values())
        if end and at >= len(tokens):
            raise Unreadable(latex)
        return out

    def atom(first: bool = False) -> list[str]:
        nonlocal at
        t = tokens[at]
        at += 1
        if t == r"\frac":
            over, under = group(), group()
            out = [*under, "분의", *over]
        elif t == r"\sqrt":
            out = ["루트", *group()]
        elif t in (r"\mathrm", r"\text"):
            at += 1
            body = ""
            while at < len(tokens) and tokens[at] != "}":
                body += tokens[at]
                at += 1
            at += 1
            out = [_UNITS.get(body, body)]
        elif t in ("-", "−"):
            out = ["마이너스" if first else "빼기"]
        elif t == "{":
            at -= 1
            out = group()
        elif t in _WORDS:
            out = [_WORDS[t]] if _WORDS[t] else []
        elif t.isalnum() or re.fullmatch(r"\d+\.\d+", t):
            out = [t]
        else:
            raise Unreadable(f"{t} in {latex}")
        while at < len(tokens) and tokens[at] in ("^", "_"):
            sign = tokens[at]
            at += 1
            script = " ".join(group())
            out.append((_POWERS.get(script) or f"{script} 제곱") if sign == "^" else f"아래첨자 {script}")
        return out

    return " ".join(filter(None, many(None)))
