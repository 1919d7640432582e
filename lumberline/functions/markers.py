"""Marker characters inside a line: two that neither the line nor an expression has."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The block of noncharacters that Unicode leaves to programs.  All of one class: no expression tells one
#: from another unless it names it.
NONCHARACTERS = [chr(c) for c in range(0xFDD0, 0xFDF0)]


class Markers:
    """Two noncharacters that the expressions at hand do not have, and lines with them out of the way.

    A line that holds a marker all the same gets another pair in its place, character for character, so that
    lengths and matches stay as they are.  A line without any free pair holds the marker's whole block and
    counts as a line without match.
    """

    def __init__(self, *expressions: str) -> None:
        free = [c for c in NONCHARACTERS if not any(c in e for e in expressions)]
        if len(free) < 4:
            raise ValueError("the expressions name the noncharacters that matching needs")
        self.first, self.second, *rest = free
        self._pairs = [a + b for a, b in list(pairwise(rest))[::2]]

    def pair(self, text: Column) -> Column:
        """What stands in for the markers in a line that holds one: the first pair that is free, an empty text if none
        is; null for a line without markers.  To be kept as a column: it is asked once per line."""
        has = lambda c: F.contains(text, F.lit(c))
        free = [F.when(~(has(p[0]) | has(p[1])), F.lit(p)) for p in self._pairs]
        return F.when(has(self.first) | has(self.second), F.coalesce(*free, F.lit("")))

    def cleared(self, text: Column, pair: Column) -> Column:
        other = F.call_function("translate", text, F.lit(self.first + self.second), pair)
        return F.when(pair.isNull(), text).when(pair != "", other)

    def restored(self, part: Column, pair: Column) -> Column:
        """A part of the cleared line as it stood in the line."""
        own = F.call_function("translate", part, pair, F.lit(self.first + self.second))
        return F.when(pair.isNull(), part).otherwise(own)
