"""Operator 3: byte-level BPE encoding and decoding with an Aho-Corasick automaton.

Bytes are mapped to Latin-1 characters, so that pyahocorasick finds vocabulary entries in
them. A sequence of tokens is the one that merging gives if and only if every two neighbours
are compatible, that is, merging their bytes alone gives the two again; that is memoised. So
the longest matches are tried first, and where neighbours do not go together the search goes
back to shorter ones; a position once given up is not tried again, so the time is linear.

Words recur: each different word of a batch of texts is encoded once, see word_table.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.llm import word_table
from corpus_engine.llm.batches import map_texts

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Entries of a worker's table of neighbour pairs.
PAIRS = 250_000


def last_merge(data: bytes, ranks: dict[bytes, int]) -> tuple[list[int], tuple[bytes, bytes] | None]:
    """BPE by its definition: join the leftmost pair of lowest rank until no pair is known.

    Gives the ids and the two parts that were joined last.
    """
    parts, last = [data[i : i + 1] for i in range(len(data))], None
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        last = (parts[best], parts[best + 1])
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts], last


def merged(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    return last_merge(data, ranks)[0]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@lru_cache(maxsize=4)
def load_vocabulary(path: str) -> tuple[dict[bytes, int], dict[int, tuple[int, int]]]:
    """The ranks, and for each token that merging makes the two tokens it is made of last.

    A single byte is made of itself twice. Tokens that merging never makes are left out: they
    encode a whole piece only. Parts have lower ranks than what they make, as training gives.
    """
    ranks = read_ranks(path)
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the vocabulary lacks the single bytes {missing[:5]}")
    made = {}
    for token, i in ranks.items():
        ids, last = last_merge(token, ranks)
        if ids == [i]:
            made[i] = (i, i) if last is None else (ranks[last[0]], ranks[last[1]])
            if last is not None and max(made[i]) > i:
                raise ValueError(f"token {i} ranks before its parts")
    return ranks, made


class ByteBpe:
    """Encodes and decodes texts; one per Python worker."""

    def __init__(self, ranks: dict[bytes, int], made: dict[int, tuple[int, int]], pattern: str):
        import ahocorasick

        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.tokens))]
        self.automaton = ahocorasick.Automaton()
        self.parts = made
        self.made = {self.tokens[i].decode("latin-1"): i for i in made}
        for word, i in self.made.items():
            self.automaton.add_word(word, (i, len(word)))
        self.automaton.make_automaton()
        self.growths: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words = word_table.WordEncoder(pattern, self._piece, "<u4")

    def _growth(self, token: int, side: int) -> list[int]:
        """The tokens at one end of a token (0 first, 1 last) while it is being merged, in time."""
        known = self.growths[side].get(token)
        if known is None:
            known, at = [token], token
            while self.parts[at][side] != at:
                at = self.parts[at][side]
                known.append(at)
            known.reverse()
            self.growths[side][token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives the two again; memoised.

        Merges go by rank. While the end of `left` and the start of `right` grow, a merge across
        the border happens if it ranks before the next merge of either; among equal ranks the
        leftmost goes first.
        """
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            ends, starts = self._growth(left, 1), self._growth(right, 0)
            tokens, ranks = self.tokens, self.ranks
            i = j = 0
            known = True
            while True:
                next_end = ends[i + 1] if i + 1 < len(ends) else len(tokens)
                next_start = starts[j + 1] if j + 1 < len(starts) else len(tokens)
                across = ranks.get(tokens[ends[i]] + tokens[starts[j]])
                if across is not None and across < next_end and across <= next_start:
                    known = False
                    break
                if next_end == next_start == len(tokens):
                    break
                if next_end <= next_start:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """One match of the pattern."""
        data = piece.encode()
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        word = data.decode("latin-1")
        ids = [i for _, (i, _) in self.automaton.iter_long(word)]
        pairs, left = self.pairs, ids[0]
        for k in range(1, len(ids)):
            right = ids[k]
            pair = (left, right)
            if not (pairs[pair] if pair in pairs else self.compatible(left, right)):
                return self._search(word, ids[:k])
            left = right
        return ids

    def _longest(self, word: str) -> list[int]:
        """The length of the longest match that starts at each position."""
        longest = [1] * len(word)
        for end, (_, size) in self.automaton.iter(word):
            if size > longest[end - size + 1]:
                longest[end - size + 1] = size
        return longest

    def _search(self, word: str, ids: list[int]) -> list[int]:
        """Go on after `ids`: longest matches first, shorter ones where neighbours do not go together.

        A position that no token leads on from is given up for good, and the token before it is
        taken back.
        """
        n, made, pairs, sizes = len(word), self.made, self.pairs, [len(self.tokens[i]) for i in ids]
        longest = self._longest(word)
        given_up = bytearray(n + 1)
        at = sum(sizes)
        size = longest[at]
        while at < n:
            left = ids[-1] if ids else None
            while size:
                i = made.get(word[at : at + size])
                if i is not None and not given_up[at + size]:
                    pair = (left, i)
                    if left is None or (pairs[pair] if pair in pairs else self.compatible(left, i)):
                        break
                size -= 1
            if size:
                ids.append(i)
                sizes.append(size)
                at += size
                if at < n:
                    size = longest[at]
            else:
                given_up[at] = 1
                ids.pop()
                size = sizes.pop()
                at -= size
                size -= 1
        return ids

    def _piece(self, piece: str) -> bytes:
        packed = self.packed
        return b"".join([packed[i] for i in self.encode_piece(piece)])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, begins = self.words.batch(texts)
        at = begins.tolist()
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:])]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join(map(tokens.__getitem__, memoryview(ids).cast("I")))


def encoder(spark: SparkSession, path: str, pattern: str):
    """A function that gives the worker's ByteBpe; the vocabulary (fixed size) is broadcast."""
    shared = spark.sparkContext.broadcast((*load_vocabulary(path), pattern))
    key = f"{spark.sparkContext.applicationId} {path} {pattern}"
    return lambda: _Worker.get(key, shared)


class _Worker:
    """The encoders of this Python process by vocabulary."""

    held: dict[str, ByteBpe] = {}

    @classmethod
    def get(cls, key: str, shared) -> ByteBpe:
        if key not in cls.held:
            cls.held.clear()
            cls.held[key] = ByteBpe(*shared.value)
        return cls.held[key]


def encode_texts(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """docs(text, *keep) -> keep, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids array<int>.

    One row per row, texts whole; null text counts as empty: 0 tokens, hashes of no bytes. Other
    columns are not read. No rows: no rows. Needs no shuffle.
    """
    get = encoder(docs.sparkSession, path, pattern)

    def work():
        bpe, sha256 = get(), hashlib.sha256

        def do(texts: list[str | None]) -> list[pa.Array]:
            encoded = bpe.encode_all([t or "" for t in texts])
            made = [
                pa.array([len(e) // 4 for e in encoded], pa.int64()),
                pa.array([sha256(e).hexdigest() for e in encoded], pa.string()),
                pa.array([sha256(bpe.decode(e)).hexdigest() for e in encoded], pa.string()),
            ]
            if ids:
                ends = [0, *accumulate(len(e) // 4 for e in encoded)]
                values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(encoded))])
                made.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))
            return made

        return do

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return map_texts(docs, list(keep), "text", work, schema)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; one row per row, repeated rows and null doc_ids kept.

    Null and empty texts: 0 tokens, hashes of no bytes. Texts of any length are encoded whole, in
    batches by their length. Other columns are not read. No documents: no rows.
    """
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_texts(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
