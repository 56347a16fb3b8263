"""What the operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from cinderlake.operators.graph import components
from cinderlake.storage import BROADCAST_ROWS, Stored, broadcast_if_small, shared_dir

__all__ = ["BROADCAST_ROWS", "Stored", "broadcast_if_small", "column", "components", "fresh_name", "held", "let_go", "shared_dir", "slices"]


def column(df: DataFrame, name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return df["`" + name.replace("`", "``") + "`"]


def fresh_name(df: DataFrame, start: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while start.lower() in taken:
        start += "_"
    return start


def slices(texts, most_chars: int):
    """Index ranges of consecutive texts of together at most ``most_chars`` characters, at least one text each."""
    start = held = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and held + n > most_chars:
            yield start, i
            start, held = i, 0
        held += n
    if len(texts) > start:
        yield start, len(texts)


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """What ``make`` gives, kept in the Python worker for the next task that asks for ``name``; what other operators kept there goes."""
    if name not in _held:
        let_go()
        _held[name] = make()
    return _held[name]


def let_go() -> None:
    """Releases what operators have kept in this Python worker, and gives the memory back to the system where libc can."""
    if _held:
        _held.clear()
        gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
