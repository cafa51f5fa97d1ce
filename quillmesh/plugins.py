"""Registry of source languages: a plugin turns sources (file, text) into facts, chosen by file extension."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    facts: Callable[[DataFrame], DataFrame]
    relations: Callable[[DataFrame], DataFrame]


_KNOWN: dict[str, Language] = {}


def register(language: Language) -> None:
    """Make a language known; an extension belongs to one language only."""
    for other in _KNOWN.values():
        if other.name != language.name and set(other.extensions) & set(language.extensions):
            raise ValueError(f"{language.name} claims an extension of {other.name}")
    _KNOWN[language.name] = language


def languages() -> list[str]:
    return sorted(_KNOWN)


def language_of(file: str) -> Language | None:
    ext = "." + file.rsplit(".", 1)[-1].lower() if "." in file else ""
    return next((x for x in _KNOWN.values() if ext in x.extensions), None)


def facts(sources: DataFrame) -> dict[str, DataFrame]:
    """Facts of mixed sources by language; files of no language are left out."""
    ext = F.lower(F.regexp_extract("file", r"(\.[^./]*)$", 1))
    return {n: x.facts(sources.where(ext.isin(*x.extensions))) for n, x in _KNOWN.items()}


def _cobol() -> Language:
    from .cobol import facts as ft

    return Language("cobol", (".cbl", ".cob", ".cpy"), ft.facts, ft.relations)


register(_cobol())
