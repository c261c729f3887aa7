"""Which local language model suits a project of a given size."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Choice(NamedTuple):
    model: str
    gigabytes: float
    files: int | None
    lines: int | None


#: Model, its size, and the most files and lines of a project it is advised for (None: any).
CHOICES = {
    "tiny": Choice("qwen2.5-coder:1.5b", 1.0, 200, 50_000),
    "small": Choice("gemma3:4b", 3.3, 1_500, 500_000),
    "deep": Choice("qwen2.5-coder:7b", 4.7, None, None),
}
#: Former names of choices.
FORMER = {"medium": "deep", "large": "deep"}


def resolve(name: str) -> str:
    """The key of CHOICES that a typed name means; ValueError for none."""
    typed = name.strip().casefold()
    found = FORMER.get(typed, typed)
    if found not in CHOICES:
        raise ValueError(f"{name!r} is not one of {', '.join(CHOICES)}")
    return found


def advise(files: Column, lines: Column) -> Column:
    """The first choice whose limits hold a project of so many files and lines, per row."""
    fits = [F.when(F.lit(True) if c.files is None else (files <= c.files) & (lines <= c.lines), F.lit(name)) for name, c in CHOICES.items()]
    return F.coalesce(*fits)


def table(marked: str | None = None) -> str:
    """The choices as text, a star before the advised one."""
    return "\n".join(f"{'*' if name == marked else ' '} {name}: {c.model}, {c.gigabytes} GB" for name, c in CHOICES.items())
