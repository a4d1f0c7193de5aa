"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct words of a batch of documents are laid end to end as one array of
symbols. An inverted index maps each mergeable pair (by the rank of its merge)
to the positions where it stands in any word, and a heap holds the ranks in the
index. Merges are applied in rank order, each to all its positions at once; only
the two neighbours of a merged pair are looked up and indexed anew. Overlapping
positions go from left to right. A word in which a merge makes a pair of lower
rank than the one at work is encoded by itself, so every word's ids are those of
encoding it alone.

There is no shuffle: words repeat mostly within a batch, and one block (about
8 MB of texts) is one corpus to replay; words are remembered between blocks. Each
executor reads the rank file once; its path is a parameter and must be readable
on every executor, or its bytes are shipped by the caller as ``ranks``.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavement.llm.columns import arrow_struct, give_back, sha256, with_struct

_MEMORY = 96_000_000   # bytes of words and ids, with what Python adds, that a task remembers between blocks
_ENTRY = 240           # bytes that an entry takes besides its characters


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    """Token bytes to rank, and the tokens by rank. Ranks must be 0 to n - 1 or have gaps, never repeat."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = {base64.b64decode(a): int(b) for a, b in pairs}
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return ranks, tokens


@functools.lru_cache(maxsize=8)
def splitter(pattern: str):
    """A function from text to its words. For ASCII texts the classes of the pattern are spelled out, which is faster."""
    plain = pattern
    for name, letters in ((r"[^\s\p{L}\p{N}]", r"[^ \t\n\r\f\vA-Za-z0-9]"), (r"\p{L}", "[A-Za-z]"), (r"\p{N}", "[0-9]"),
                          (r"\S", r"[^ \t\n\r\f\v]"), (r"\s", r"[ \t\n\r\f\v]")):
        plain = plain.replace(name, letters)
    every = regex.compile(pattern).findall
    if r"\p" in plain or "(?i" in plain or re.search(r"\[[^\]]*\[", plain):
        return every  # classes that are not spelled out
    narrow = re.compile(plain).findall
    return lambda text: narrow(text) if text.isascii() else every(text)


class Merges:
    """All merges of a vocabulary: the pairs of ids whose bytes together are a token, and that token's rank."""

    def __init__(self, ranks: dict[bytes, int], tokens: list[bytes]):
        self.ranks, self.tokens = ranks, tokens
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = rank
        self.pairs = np.array(sorted(pairs), np.int64) if pairs else np.array([-1], np.int64)
        self.rank_of = np.array([pairs.get(p, -1) for p in self.pairs.tolist()], np.int64)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of ids, -1 where there is none."""
        codes = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
        return np.where(self.pairs[at] == codes, self.rank_of[at], -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (little-endian unsigned 32-bit), by one replay of the merges over all words."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        index = _Index()
        # between bytes, one table holds all ranks
        table = self.look_up(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))
        raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        starts = np.flatnonzero(after >= 0)
        index.add(table[raw[starts] * 256 + raw[starts + 1]], starts)
        astray = []   # merges that made a pair of lower rank: their words are done by themselves
        while index.heap:
            r, at = index.pop()
            at = at[(ids[at] >= 0) & (after[at] >= 0)]
            at = at[self.look_up(ids[at], ids[after[at]]) == r]
            if not len(at):
                continue
            right = after[at]
            touching = np.flatnonzero(right[:-1] == at[1:])
            if len(touching):  # overlapping pairs go from left to right: of a chain, every other one
                linked = np.zeros(len(at), bool)
                linked[touching + 1] = True
                place = np.arange(len(at))
                begin = np.maximum.accumulate(np.where(linked, 0, place))
                at = at[(place - begin) % 2 == 0]
                right = after[at]
            beyond = after[right]
            ids[at], ids[right] = r, -1
            after[at] = beyond
            more = beyond >= 0
            before[beyond[more]] = at[more]
            left = before[at]
            lefts = np.concatenate([left[left >= 0], at[more]])
            found = self.look_up(ids[lefts], ids[after[lefts]])
            if len(found) and ((found >= 0) & (found < r)).any():
                astray.append(lefts[(found >= 0) & (found < r)])
            index.add(found, lefts)
        alive = ids >= 0
        flat, kept = ids[alive].astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(alive)))
        bounds = (kept[np.concatenate(([0], ends))] * 4).tolist()
        out = [flat[a:b] for a, b in zip(bounds, bounds[1:])]
        for word in np.unique(np.searchsorted(ends, np.concatenate(astray), side="right")).tolist() if astray else ():
            out[word] = self.alone(words[word])
        return out

    def alone(self, word: bytes) -> bytes:
        """One word, by a heap of (rank, place): for the rare word whose merges do not come in rank order."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def note(at: int) -> None:
            right = after[at]
            r = self.ranks.get(self.tokens[ids[at]] + self.tokens[ids[right]], -1)
            if r >= 0:
                heapq.heappush(heap, (r, at, ids[at], ids[right]))

        for at in range(len(ids) - 1):
            note(at)
        while heap:
            r, at, a, b = heapq.heappop(heap)
            right = after[at]
            if right < 0 or ids[at] != a or ids[right] != b:
                continue
            ids[at], ids[right], after[at] = r, -1, after[right]
            if after[at] >= 0:
                before[after[at]] = at
                note(at)
            if before[at] >= 0:
                note(before[at])
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()


class _Index:
    """Inverted index from the rank of a pair to the places where its left symbol stands, popped in rank order."""

    def __init__(self):
        self.places: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []

    def add(self, ranks: np.ndarray, places: np.ndarray) -> None:
        use = ranks >= 0
        ranks, places = ranks[use], places[use]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        at = [0, *cuts.tolist(), len(ranks)]
        known = self.places
        for r, a, b in zip(ranks[at[:-1]].tolist(), at, at[1:]):
            held = known.get(r)
            if held is None:
                known[r] = [places[a:b]]
                heapq.heappush(self.heap, r)
            else:
                held.append(places[a:b])

    def pop(self) -> tuple[int, np.ndarray]:
        r = heapq.heappop(self.heap)
        held = self.places.pop(r)
        return r, np.unique(np.concatenate(held))


@functools.lru_cache(maxsize=4)
def _merges(path: str) -> Merges:
    return Merges(*load_ranks(path))


class _Numbers(dict):
    """Words in the order in which they were met."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Encoder:
    """Texts of one task to ids; remembers words, so that a frequent word is replayed once."""

    def __init__(self, path: str, pattern: str):
        self.merges, self.find = _merges(path), splitter(pattern)
        self.forget()

    def forget(self) -> None:
        self.numbers, self.ids, self.size = _Numbers(), [], 0

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; none for null or empty."""
        if self.size > _MEMORY:
            self.forget()
        number = self.numbers.__getitem__
        # a text is kept as the numbers of its words: four bytes a word
        split = [array("I", map(number, self.find(t))) if t else () for t in texts]
        fresh = [w.encode("utf-8") for w in islice(self.numbers, len(self.ids), None)]
        whole = [self.merges.ranks.get(raw) for raw in fresh]
        replayed = iter(self.merges.replay([raw for raw, rank in zip(fresh, whole) if rank is None]))
        found = [next(replayed) if rank is None else rank.to_bytes(4, "little") for rank in whole]
        self.ids += found
        self.size += sum(map(len, fresh)) + sum(map(len, found)) + _ENTRY * len(fresh)
        return [b"".join(map(self.ids.__getitem__, words)) for words in split]


def decode_ids(ids: bytes, tokens: list[bytes]) -> bytes:
    """Bytes of little-endian ids; an id without a token is an error."""
    if not ids:
        return b""
    found = np.frombuffer(ids, "<u4")
    if int(found.max()) >= len(tokens):
        raise ValueError(f"no token has id {int(found.max())}")
    return b"".join(map(tokens.__getitem__, found.tolist()))


def _blocks(texts: pa.Array, most: int = 8_000_000):
    """Runs of texts of about ``most`` characters, so that one replay has a bounded size."""
    block, size = [], 0
    for scalar in texts:
        text = scalar.as_py()
        block.append(text)
        size += len(text or "")
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode(text: Column, path: str, pattern: str) -> Column:
    """Ids of each text as binary (little-endian unsigned 32-bit). Null and empty texts have no ids."""

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = Encoder(path, pattern)
        for texts in batches:
            yield pa.array([x for block in _blocks(texts) for x in coder.encode(block)], pa.binary())
        coder.forget()
        give_back()

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """The bytes that ``ids`` (as from ``encode``) stand for; null decodes to no bytes."""

    @F.arrow_udf("binary")
    def text(column: pa.Array) -> pa.Array:
        tokens = load_ranks(path)[1]
        return pa.array([decode_ids(x.as_py() or b"", tokens) for x in column], pa.binary())

    return text(ids)


def token_columns(df: DataFrame, path: str, pattern: str, text: str = "text", ids: bool = False) -> tuple[DataFrame, str]:
    """``df`` with a struct (n_tokens, ids_sha256, decoded_sha256) per row, and its name.

    With ``ids`` the token ids themselves come along, as binary. Null and empty
    texts: no tokens and the digests of nothing. Repeated rows are encoded
    alike; other columns pass through whatever their names are.
    """
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    if ids:
        fields, schema = [*fields, ("ids", pa.binary())], f"{schema}, ids binary"

    @F.arrow_udf(schema)
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder, tokens = Encoder(path, pattern), load_ranks(path)[1]
        for texts in batches:
            rows = []
            for block in _blocks(texts):
                for found in coder.encode(block):
                    rows.append((len(found) // 4, sha256(found), sha256(decode_ids(found, tokens)), found)[:len(fields)])
            yield arrow_struct(fields, rows)
            del rows
        coder.forget()
        give_back()

    return with_struct(df, text, digest, "_tokens")
