"""Prompts as column expressions: short neutral wording around the slots that carry data."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import END_MARK

RULES = f"Answer with the numbered lines only, each as <n/>text, keep every </> separator, and end with {END_MARK}."
_ONE = f"Answer with the translated line alone, and end with {END_MARK}."


@dataclass(frozen=True)
class Templates:
    """The wording; a name in braces is a slot.  ``from_folder`` takes texts of a folder instead."""

    translate: str = f"Translate each numbered line into {{language}}. {RULES}"
    refine: str = f"Refine the translation. {RULES}\nLines: {{lines}}\nGlossary: {{glossary}}\nOriginal:\n{{original}}\nTranslation:\n{{translation}}"
    missing_lines: str = f"Translate the numbered lines only; these are missing: {{missing}}. {RULES}\n{{chunk}}"
    fragments: str = f"Translate again with exactly {{expected}} separators at the same places. {_ONE}\nBefore, with {{actual}}: {{wrong}}\n<0/>{{original}}"
    fragments_anywhere: str = f"Translate again with exactly {{expected}} separators wherever they fit. {_ONE}\nBefore, with {{actual}}: {{wrong}}\n<0/>{{original}}"
    quotes: str = f"Translate again with exactly {{expected}} pairs of quotation marks. {_ONE}\nBefore, with {{actual}}: {{wrong}}\n<0/>{{original}}"

    @classmethod
    def from_folder(cls, folder: str | Path) -> Templates:
        """Templates from the files <name>.txt of a folder; names without a file keep their wording."""
        found = {f.name: p.read_text(encoding="utf-8") for f in fields(cls) if (p := Path(folder) / f"{f.name}.txt").exists()}
        return replace(cls(), **found)


WORDING = Templates()


def render(template: str, **slots: Column) -> Column:
    """A template with its slots filled (F15); a null slot is empty, an unknown one raises KeyError."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(slots[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def fill(template: str, **slots: object) -> str:
    """``render`` of one text in Python."""
    parts = re.split(r"\{(\w+)\}", template)
    return "".join([p if not i % 2 else "" if slots[p] is None else str(slots[p]) for i, p in enumerate(parts)])


def first_pass(language: str, wording: Templates = WORDING) -> Column:
    """System prompt of the first phase (F16)."""
    return render(wording.translate, language=F.lit(language))


def second_pass(original: Column, initial: Column, glossary: Column, n_lines: Column, wording: Templates = WORDING) -> Column:
    """Refinement prompt (F17): the original, the first translation, the glossary and the number of lines."""
    known = F.when(F.coalesce(glossary, F.lit("")) == "", "no terms").otherwise(glossary)
    return render(wording.refine, lines=n_lines, glossary=known, original=original, translation=initial)


def missing_lines(chunk: Column, missing: Column, wording: Templates = WORDING) -> Column:
    """Request for lines that did not come (F18): ``missing`` an array of indices, the first five of them named."""
    named = F.array_join(F.transform(F.slice(missing, 1, 5), lambda x: x.cast("string")), ", ")
    return render(wording.missing_lines, missing=named, chunk=chunk)


def retry_fragments(original: Column, expected: Column, strict: bool = True, wrong: Column | None = None, actual: Column | None = None, wording: Templates = WORDING) -> Column:
    """Request to translate a line again with its separators (F19), at their places or (not ``strict``) anywhere; the
    counts are of fragments, one more than separators."""
    none = F.lit("")
    return render(wording.fragments if strict else wording.fragments_anywhere, expected=expected - 1, actual=none if actual is None else actual - 1, wrong=none if wrong is None else wrong, original=original)


def retry_quotes(original: Column, expected: Column, wrong: Column | None = None, actual: Column | None = None, wording: Templates = WORDING) -> Column:
    """Request to translate a line again with its quotation pairs."""
    none = F.lit("")
    return render(wording.quotes, expected=expected, actual=none if actual is None else actual, wrong=none if wrong is None else wrong, original=original)


def reason(check: Column, expected: Column, actual: Column) -> Column:
    """Why a line failed."""
    return F.concat(check, F.lit(": expected "), expected.cast("string"), F.lit(", got "), actual.cast("string"))
