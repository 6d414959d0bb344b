"""Two string similarities and the native bounds that keep them off most pairs.

``indel``       100 * 2*LCS / (len a + len b)
``ratcliff``    matching-block ratio of ``difflib``, its rule for frequent characters included

Both are at most the indel ratio, and lev <= len a + len b - 2*LCS, so a pair above ratio r has
lev < (1 - r) * (len a + len b). Levenshtein with that threshold runs in the JVM; only survivors
reach the Arrow kernels below.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BooleanType, DoubleType

# The kernels travel with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Label threshold in percent, heading threshold as a ratio.
LABEL_THRESHOLD = 95.0
HEADING_THRESHOLD = 0.85


# Combined length beyond which the bit-parallel kernel beats the quadratic JVM test.
LONG_PAIR = 2000


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word-parallel row per character
    between the common ends."""
    start, end = 0, 0
    shorter = min(len(a), len(b))
    while start < shorter and a[start] == b[start]:
        start += 1
    while end < shorter - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start:len(a) - end], b[start:len(b) - end]
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return start + end + len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if a == b else 100.0 * 2 * common_subsequence(a, b) / total


# From so many characters of the second text on, those that are more than this share
# of it (and one) begin and prolong no block; they only widen one that is found.
JUNK_FROM, JUNK_SHARE = 200, 100

#: So many steps of ``difflib`` for each character cost less than an automaton of them.
FEW_STEPS = 24


class Automaton:
    """The suffix automaton of a text: every stretch of it is a path, and a state knows where its
    stretches end first. Characters in ``skipped`` are on no path."""

    def __init__(self, text: str, skipped: frozenset[str]) -> None:
        self.paths: list[dict[str, int]] = [{}]
        self.link, self.size, self.ends = [-1], [0], [-1]
        last = 0
        for at, ch in enumerate(text):
            last = 0 if ch in skipped else self._after(last, ch, at)

    def _state(self, paths: dict[str, int], link: int, size: int, end: int) -> int:
        self.paths.append(paths)
        self.link.append(link)
        self.size.append(size)
        self.ends.append(end)
        return len(self.size) - 1

    def _after(self, last: int, ch: str, at: int) -> int:
        paths, link, size = self.paths, self.link, self.size
        known = paths[last].get(ch)
        if known is not None and size[known] == size[last] + 1:
            return known
        if known is not None:
            return self._copy(last, known, ch)
        new = self._state({}, 0, size[last] + 1, at)
        while last >= 0 and ch not in paths[last]:
            paths[last][ch] = new
            last = link[last]
        if last >= 0:
            onto = paths[last][ch]
            link[new] = onto if size[onto] == size[last] + 1 else self._copy(last, onto, ch)
        return new

    def _copy(self, last: int, onto: int, ch: str) -> int:
        """A state for the shorter stretches of ``onto``, which also end elsewhere."""
        copy = self._state(dict(self.paths[onto]), self.link[onto], self.size[last] + 1, self.ends[onto])
        self.link[onto] = copy
        while last >= 0 and self.paths[last].get(ch) == onto:
            self.paths[last][ch] = copy
            last = self.link[last]
        return copy

    def longest(self, text: str) -> tuple[int, int, int]:
        """Start in ``text``, start in the automaton's text and length of the longest stretch that both
        have, the first in ``text`` and then in the other."""
        paths, link, size = self.paths, self.link, self.size
        state = length = 0
        best = (0, 0, 0)
        for at, ch in enumerate(text):
            while state and ch not in paths[state]:
                state = link[state]
                length = size[state]
            if ch in paths[state]:
                state = paths[state][ch]
                length += 1
                if length > best[2]:
                    best = (at - length + 1, self.ends[state] - length + 1, length)
        return best


def matched(a: str, b: str) -> int:
    """Characters in the matching blocks of two texts: the longest common block, and those left and
    right of it, as ``difflib`` finds them, but in time that grows with a text and not its square."""
    n, counts = len(b), Counter(b)
    skipped = frozenset(ch for ch, k in counts.items() if n >= JUNK_FROM and k > n // JUNK_SHARE + 1)
    total, todo = 0, [(0, len(a), 0, n)]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        if alo >= ahi or blo >= bhi:
            continue
        i, j, size = Automaton(b[blo:bhi], skipped).longest(a[alo:ahi])
        i, j = i + alo, j + blo  # the starts, where nothing is found; these may be widened, too
        end = i + size
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        while end < ahi and j + end - i < bhi and a[end] == b[j + end - i]:
            end += 1
        if end > i:
            total += end - i
            todo += [(alo, i, blo, j), (end, ahi, j + end - i, bhi)]
    return total


def ratcliff_ratio(a: str, b: str) -> float:
    if a == b:
        return 1.0
    left, right = Counter(a), Counter(b)
    if sum(k * right[ch] for ch, k in left.items()) <= FEW_STEPS * (len(a) + len(b)):
        return SequenceMatcher(None, a, b).ratio()
    return 2.0 * matched(a, b) / (len(a) + len(b))


def is_near(a: str, b: str, threshold: float) -> bool:
    """Whether the Ratcliff ratio is above ``threshold``; the indel ratio, never smaller, is cheaper
    and tried first."""
    return indel_ratio(a, b) / 100 > threshold and ratcliff_ratio(a, b) > threshold


@F.pandas_udf(DoubleType())
def indel_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def ratcliff_near(a: Column, b: Column, threshold: float) -> Column:
    """Whether the Ratcliff ratio of two columns is above ``threshold``; false where one is null."""
    @F.pandas_udf(BooleanType())
    def near(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([x is not None and y is not None and is_near(x, y, threshold) for x, y in zip(left, right)], dtype="bool")

    return near(a, b)


def may_exceed(a: str, b: str, ratio: float) -> Column:
    """Necessary condition, on the columns named, for a similarity above ``ratio`` (0 to 1). Equal
    texts and lengths are looked at first; long pairs are left to the kernel."""
    total = f"(length({a}) + length({b}))"
    slack = f"cast(ceil({1 - ratio!r}D * {total}) as int) + 1"
    return F.expr(
        f"{a} = {b} or (abs(length({a}) - length({b})) <= {slack} "
        f"and ({total} > {LONG_PAIR} or levenshtein({a}, {b}, {slack}) >= 0))"
    )


def length_band(text: Column, ratio: float) -> Column:
    """Logarithmic length class; texts above ``ratio`` lie in the same or a neighbouring class."""
    step = math.log((2 - ratio) / ratio) + 1e-3
    return F.floor(F.log(F.greatest(F.length(text), F.lit(1))) / F.lit(step)).cast("int")


def neighbouring_bands(text: Column, ratio: float) -> Column:
    band = length_band(text, ratio)
    return F.array(band - 1, band, band + 1)
