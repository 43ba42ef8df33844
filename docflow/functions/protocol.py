"""The protocol of numbered lines on the side of the model's client: the parser's rules for one answer."""

from __future__ import annotations

import re
from collections.abc import Callable

from .words import END_MARK, ERROR_MARK, SEPARATOR

_LINE = re.compile(r"^<([0-9]+)/>(.*)$", re.M)


def parse(answer: str) -> dict[int, str]:
    """Index to text of an answer (F1): the rest of each numbered line, the last of equal numbers; ValueError with the
    status ``error``, ``missing_end`` or ``no_lines`` otherwise."""
    text = answer.strip()
    if text.startswith(ERROR_MARK):
        raise ValueError("error")
    if not text.endswith(END_MARK):
        raise ValueError("missing_end")
    found = {int(m[1]): m[2].strip() for m in _LINE.finditer(text.replace(END_MARK, "").strip())}
    if not found:
        raise ValueError("no_lines")
    return found


def one_line(answer: str) -> str:
    """The text of an answer to a request for one line, numbered or not; ValueError as ``parse``."""
    text = answer.strip()
    return parse(text if text.startswith("<0/>") else "<0/>" + text)[0]


def separators(text: str) -> int:
    return text.count(SEPARATOR)


def quote_pairs(text: str, quotes: str = "“”«»") -> int:
    return sum(map(text.count, quotes)) // 2


def attempts(ask: Callable[[int, bool], str], accept: Callable[[str], bool], most: int) -> int:
    """The attempt (from 1) whose answer was accepted, or 0 (V6): ``ask`` gets the attempt and whether to reason, which is
    the last one only; what either raises is a failed attempt."""
    for n in range(1, most + 1):
        try:
            if accept(ask(n, n == most)):
                return n
        except Exception:  # noqa: BLE001  a model or an answer that fails in any way is asked again
            continue
    return 0
