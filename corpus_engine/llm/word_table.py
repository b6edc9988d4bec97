"""Token ids of many texts at once: each different word of a batch is encoded once.

The pattern of byte-level tokenizers begins a match at every space that stands between two
characters other than white space, so texts may be cut there and the words between encoded apart.
Arrow finds the different words of a batch, one run of the pattern cuts them into pieces, the ids
of pieces are kept in bounded tables, and numpy lays the ids of all words out in a row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a worker's tables of pieces.
PIECES = 100_000
#: Nothing, or white space at an end: what any of the libraries takes for white space.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BLANK = f"^$|^{SPACE}|{SPACE}$"


class Table(dict):
    """A bounded table filled as keys come up.

    A full table is put aside, and keys found there come back; the one put aside before goes.
    """

    def __init__(self, make: Callable, most: int = PIECES):
        super().__init__()
        self.make, self.most, self.aside = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.aside = dict(self)
            self.clear()
        value = self.aside.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def _split(words: pa.Array) -> list[str]:
    """Strings without spaces as a list; faster than one by one."""
    if not len(words):
        return []
    row = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(row, " ")[0].as_py().split(" ")


class WordEncoder:
    """Encodes batches of texts. piece_ids(piece) gives the ids of a match of `pattern` as bytes of `dtype`."""

    def __init__(self, pattern: str, piece_ids: Callable[[str], bytes], dtype: str):
        import regex

        self.findall = regex.compile(pattern).findall
        self.edge = regex.compile(r"\s").match
        self.dtype = np.dtype(dtype)
        self.pieces = Table(piece_ids)
        self.plain = Table(lambda word: piece_ids(" " + word))  # words of letters are one piece with their space

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.findall(text)))

    def _mixed(self, text: str) -> bytes:
        """A text with white space beside some of its spaces: no cut is made at those."""
        first, *rest = text.split(" ")
        parts: list[list[str]] = [[first]]
        black = bool(first) and not self.edge(first[-1])
        for word in rest:
            if black and word and not self.edge(word[0]):
                parts.append(["", word])
            else:
                parts[-1].append(word)
            black = bool(word) and not self.edge(word[-1])
        return b"".join([self.whole(" ".join(part)) for part in parts])

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's ids begin, and the end)."""
        if not texts:
            return np.empty(0, self.dtype), np.zeros(1, np.int64)
        parts = pc.split_pattern(pa.array(texts, pa.string()), " ")
        begins = np.asarray(parts.offsets).astype(np.int64)
        found = parts.values.dictionary_encode()
        names, codes = found.dictionary, found.indices.to_numpy().astype(np.int64)
        heads = begins[:-1]  # the words at the head of a text have no space before them
        inner = np.ones(len(codes), bool)
        inner[heads] = False
        blank = np.asarray(pc.match_substring_regex(names, BLANK))
        used = np.zeros(len(names), bool)
        used[codes[inner]] = True
        used &= ~blank
        letters = used & np.asarray(pc.and_(pc.string_is_ascii(names), pc.utf8_is_alpha(names)))
        pool = [b"", *map(self.plain.__getitem__, _split(names.filter(letters)))]
        sizes = list(map(len, pool))
        place = np.zeros(len(names), np.int64)
        place[letters] = np.arange(1, len(pool))
        others = np.flatnonzero(used & ~letters)
        if len(others):
            cut = self.findall(" " + " ".join(_split(names.take(pa.array(others)))))
            made = list(map(self.pieces.__getitem__, cut))
            starts = np.flatnonzero(np.fromiter((piece[0] == " " for piece in cut), bool, len(cut)))  # a word has one space
            place[others] = np.arange(len(pool), len(pool) + len(others))
            pool += made
            sizes += np.add.reduceat(np.fromiter(map(len, made), np.int64, len(made)), starts).tolist()
        at = place[codes]
        odd = np.logical_or.reduceat(blank[codes], heads)
        for k, head in enumerate(heads.tolist()):
            if odd[k]:
                at[head : begins[k + 1]] = 0
                pool.append(self._mixed(texts[k]))
            else:
                pool.append(self.whole(names[codes[head]].as_py()))
            at[head] = len(sizes)
            sizes.append(len(pool[-1]))
        counts = np.array(sizes, np.int64) // self.dtype.itemsize
        starts = np.cumsum(counts) - counts
        ids = np.frombuffer(b"".join(pool), self.dtype)
        counts = counts[at]
        ends = np.cumsum(counts)
        rows = np.repeat(starts[at] - (ends - counts), counts)
        rows += np.arange(len(rows))
        return ids[rows], np.concatenate(([0], ends))[begins]
