"""Calls of services within a task: some at once, each with a deadline, answers in the order of the questions."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future
from concurrent.futures import TimeoutError as Late
from typing import Any

from quillspark.functions.providers import Chat, retried

AT_ONCE, DEADLINE = 4, 180.0
#: Characters of a message that an error keeps.
SAID = 300


def _begun(call: Callable[[], Any]) -> Future:
    out: Future = Future()

    def run() -> None:
        try:
            out.set_result(call())
        except BaseException as x:
            out.set_exception(x)

    # a daemon: a call that never returns doesn't keep the worker alive
    threading.Thread(target=run, daemon=True).start()
    return out


def in_order(calls: Iterable[Callable[[], Any]], at_once: int = AT_ONCE, deadline: float = DEADLINE) -> Iterator[tuple[Any, str | None]]:
    """(answer, None) or (None, error) of each call, in order. At most at_once run; one that is late is given up, and its place is free."""
    running: deque[tuple[Future, float]] = deque()

    def answer() -> tuple[Any, str | None]:
        future, began = running.popleft()
        try:
            return future.result(timeout=max(0.0, began + deadline - time.monotonic())), None
        except Late as x:
            return None, f"{type(x).__name__}: {x}"[:SAID] if future.done() else f"no answer in {deadline:g} s"
        except Exception as x:
            return None, f"{type(x).__name__}: {x}"[:SAID]

    for call in calls:
        if len(running) == at_once:
            yield answer()
        running.append((_begun(call), time.monotonic()))
    while running:
        yield answer()


class NotAnObject(ValueError):
    """A reply that is no JSON object."""


def asked(service: Chat, system: str, user: str, temperature: float | None = None, **retry: Any) -> dict[str, Any]:
    """One reply, a JSON object; asked again when a call fails or the reply has another shape."""

    def once() -> dict[str, Any]:
        reply = service.json(system, user, temperature)
        if not isinstance(reply, dict):
            raise NotAnObject(f"the reply is of type {type(reply).__name__}")
        return reply

    return retried(once, **retry)
