"""Encoding of texts word by word, each distinct word once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the pattern that splits a text before the merges of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: By that pattern a space is the first character of what follows it, unless that is white space or
#: the end. Texts without such spaces split into words at every space, and a word's tokens depend
#: on the word alone.
ODD_SPACE = re.compile(r" (?=\s|$)")

#: Words that a worker remembers, twice; longer ones are encoded each time.
REMEMBERED, LONG = 50_000, 64


class WordCoder:
    """Token ids of texts as little-endian unsigned 32-bit numbers. Subclasses say how whole texts
    and words with a space before them are encoded."""

    #: Characters that are worked on together; a longer text is worked on alone.
    together = 2_000_000

    def __init__(self) -> None:
        self.recent: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        raise NotImplementedError

    def spaced(self, words: list[str]) -> list[bytes]:
        raise NotImplementedError

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        part, size = [], 0
        for text in texts:
            if part and size + len(text) > self.together:
                yield from self._together(part)
                part, size = [], 0
            part.append(text)
            size += len(text)
        if part:
            yield from self._together(part)

    def _together(self, texts: list[str]) -> list[bytes]:
        odd = [at for at, text in enumerate(texts) if ODD_SPACE.search(text)]
        odd_ids = dict(zip(odd, self.whole([texts[at] for at in odd])))
        lists = pc.split_pattern(pa.array([None if at in odd_ids else text for at, text in enumerate(texts)], pa.string()).fill_null(""), " ")
        firsts = lists.offsets.to_numpy()[:-1]
        coded = lists.flatten().dictionary_encode()
        words, which = coded.dictionary.to_pylist(), coded.indices.to_numpy().copy()
        heads = self.whole([words[at] for at in which[firsts]])
        which[firsts] = len(words) + np.arange(len(texts))  # the first word has no space before it
        ids, places = self._known(words) + heads, which.tolist()
        cuts = lists.offsets.to_pylist()
        return [
            odd_ids[at] if at in odd_ids else b"".join(map(ids.__getitem__, places[a:b]))
            for at, (a, b) in enumerate(zip(cuts, cuts[1:]))
        ]

    def _known(self, words: list[str]) -> list[bytes]:
        recent, old = self.recent, self.old
        ids = [recent.get(word) or old.get(word) for word in words]
        missing = [at for at, found in enumerate(ids) if not found]
        for at, found in zip(missing, self.spaced([words[at] for at in missing])):
            ids[at] = found
        if len(recent) >= REMEMBERED:
            self.old, self.recent = recent, {}
        room = REMEMBERED - len(self.recent)
        self.recent.update((word, found) for word, found in islice(zip(words, ids), room) if len(word) <= LONG)
        return ids
