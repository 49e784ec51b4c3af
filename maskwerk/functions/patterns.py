"""Many literal patterns in one pass over a text: an automaton of all of them, in Arrow batches.

The patterns reach executors once, as a broadcast of MOST_BYTES at most; more are split into several automata, a pass
each. A worker builds an automaton when it first meets its broadcast, and keeps the last KEPT ones. A pass
takes time in proportion to the text and to what is found in it, however many patterns there are.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark import SparkContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F

#: UTF-8 bytes of patterns in one automaton, which takes some 100 times that in a worker.
MOST_BYTES = 4 << 20
KEPT = 4


class _Folded(dict):
    """A table for str.translate: each character in the case in which Java compares without regard to case, as one character."""

    def __missing__(self, code: int) -> int:
        up = chr(code).upper()
        low = (up if len(up) == 1 else chr(code)).lower()
        self[code] = ord(low[0]) if len(low) == 1 or code == 0x130 else code
        return self[code]


_FOLDED = _Folded()
_built: OrderedDict[str, ahocorasick.Automaton] = OrderedDict()


def folded(text: str) -> str:
    """text without regard to case, of the same length."""
    return text.translate(_FOLDED)


def _automaton(name: str, patterns: Sequence[str]) -> ahocorasick.Automaton:
    """The automaton of a list of patterns, with their places in it; name tells lists apart."""
    if name not in _built:
        made = ahocorasick.Automaton()
        for k, word in enumerate(patterns):
            made.add_word(word, k)
        made.make_automaton()
        _built[name] = made
    _built.move_to_end(name)
    while len(_built) > KEPT:
        _built.popitem(last=False)
    return _built[name]


def parts(patterns: Sequence[str], most: int = MOST_BYTES) -> Iterator[list[str]]:
    """patterns in lists of `most` bytes at most, or of one longer pattern."""
    part, size = [], 0
    for p in patterns:
        n = len(p.encode())
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append(p)
        size += n
    if part:
        yield part


def found(text: str, automaton: ahocorasick.Automaton, patterns: Sequence[str]) -> list[tuple[int, int, int]]:
    """(start, end, pattern) of each pattern's occurrences in a text, from left to right without overlaps of its own, by end."""
    ends: dict[int, int] = {}
    out = []
    for last, k in automaton.iter(text) if len(automaton) else ():
        start = last + 1 - len(patterns[k])
        if start >= ends.get(k, 0):
            ends[k] = last + 1
            out.append((start, last + 1, k))
    return out


def _broadcast(patterns: Sequence[str], most: int) -> list[tuple[str, Broadcast]]:
    """Parts of the patterns, each with a name of its own."""
    context = SparkContext.getOrCreate()
    return [(uuid.uuid4().hex, context.broadcast(part)) for part in parts(list(dict.fromkeys(patterns)), most)]


def occurrences(patterns: Sequence[str], most: int = MOST_BYTES) -> Callable[[Column], Column]:
    """A function of a text column: structs start, end and text of all occurrences of all patterns, in any case. Patterns are not empty."""
    held = _broadcast([folded(p) for p in patterns if p], most)

    @F.pandas_udf("array<struct<start:int,end:int,text:string>>")
    def hits(texts: pd.Series) -> pd.Series:
        known = [(_automaton(name, b.value), b.value) for name, b in held]

        def of(text: str | None) -> list[dict]:
            low = folded(text or "")
            return [{"start": s, "end": e, "text": text[s:e]} for s, e in sorted((s, e) for a, words in known for s, e, _ in found(low, a, words))]

        return texts.map(of)

    return hits


def held_by(patterns: Sequence[str], most: int = MOST_BYTES) -> Callable[[Column], Column]:
    """A function of a text column: which patterns stand in it, each once, as they are written."""
    held = _broadcast([p for p in patterns if p], most)

    @F.pandas_udf("array<string>")
    def which(texts: pd.Series) -> pd.Series:
        known = [(_automaton(name, b.value), b.value) for name, b in held]
        return texts.map(lambda t: sorted(words[k] for a, words in known if len(a) for k in {k for _, k in a.iter(t or "")}))

    return which
