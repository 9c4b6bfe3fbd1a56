"""External services behind small protocols, with deterministic stand-ins.

A provider is made once in each task and called for each row. Services that cost money do their own
retries: a Spark task retry would call them again for every row.
"""

from __future__ import annotations

import io
import re
import time
import wave
from collections.abc import Callable
from typing import Any, Protocol


class Ocr(Protocol):
    def pages(self, path: str, content: bytes) -> list[str]: ...


class Renderer(Protocol):
    def render(self, content: bytes, dpi: int) -> list[bytes]: ...


class Chat(Protocol):
    def json(self, system: str, user: str, temperature: float | None = None) -> dict[str, Any]: ...


class Speech(Protocol):
    def speak(self, latex: str, domain: str, style: str, ssml: bool) -> str: ...


class MathML(Protocol):
    def convert(self, latex: str) -> str: ...


class Voice(Protocol):
    def synthesize(self, text: str, ssml: bool) -> bytes: ...


def retried(call: Callable[[], Any], attempts: int = 3, wait: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Calls until it works; waits longer after each failure, and raises the last one."""
    for k in range(1, attempts + 1):
        try:
            return call()
        except Exception:
            if k == attempts:
                raise
            sleep(wait * (k + 1))
    raise AssertionError


class TextOcr:
    """Stand-in: an image's bytes are its text, form feeds part pages."""

    def pages(self, path: str, content: bytes) -> list[str]:
        return content.decode("utf-8", "replace").split("\f")


class SplitRenderer:
    """Stand-in: form feeds part a document's pages."""

    def render(self, content: bytes, dpi: int) -> list[bytes]:
        return content.split(b"\f")


class NoChat:
    """Stand-in that reports nothing."""

    def json(self, system: str, user: str, temperature: float | None = None) -> dict[str, Any]:
        return {"numbers": [], "findings": []}


class RepeatJudge:
    """Stand-in for a judge: objects to the first word that the speech says twice in a row."""

    def json(self, system: str, user: str, temperature: float | None = None) -> dict[str, Any]:
        speech = user.partition("\n\nSPEECH:\n")[2]
        said = re.search(r"(?<![A-Za-z])([A-Za-z]+) \1(?![A-Za-z])", speech)
        finding = {"category": "repeat", "severity": "error", "speech_quote": said[0], "explanation": f"{said[1]} is said twice"} if said else None
        return {"findings": [finding] if finding else []}


class ExpansionChat:
    """Stand-in for the restoring service: a decimal is repeating where the text prints its expansion with an ellipsis."""

    def json(self, system: str, user: str, temperature: float | None = None) -> dict[str, Any]:
        found = []
        for m in re.finditer(r"(\d+)\.(\d*?)(\d+?)\3+ ?(?:\.\.\.|…|⋯|\\cdots)", user):
            found.append({"number": f"{m[1]}.{m[2]}{m[3]}", "period": m[3], "evidence": m[0]})
        return {"numbers": found, "findings": []}


class FlatMathML:
    """Stand-in: numbers, letters and signs in a row; commands, groups and scripts are beyond it."""

    def convert(self, latex: str) -> str:
        if re.search(r"[\\{}^_]", latex):
            raise ValueError("a command, group or script")
        tags = {"n": "mn", "i": "mi"}
        parts = ((tags.get(m.lastgroup, "mo"), m[0]) for m in re.finditer(r"(?P<n>[0-9]+)|(?P<i>[A-Za-z])|[^\s0-9A-Za-z]", latex))
        return "<math><mrow>" + "".join(f"<{tag}>{text.replace('&', '&amp;').replace('<', '&lt;')}</{tag}>" for tag, text in parts) + "</mrow></math>"


class RuleSpeech:
    """Reads simple formulas by rule; raises for the others."""

    def speak(self, latex: str, domain: str, style: str, ssml: bool) -> str:
        from quillspark.functions.speechtext import verbalize

        words = verbalize(latex)
        return f"<speak><prosody>{words}</prosody></speak>" if ssml else words


class SilentVoice:
    """Stand-in: a valid WAV file of silence, a hundredth of a second for each character."""

    def synthesize(self, text: str, ssml: bool) -> bytes:
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(24_000)
            w.writeframes(b"\0\0" * 240 * len(text))
        return out.getvalue()


