"""Token counts by compiled finite-state tokenizers.

A byte-level BPE vocabulary is compiled to two deterministic transducers.

* The splitter reads classes of characters and marks where words start. It has a
  few states, so the maps that characters make of them (state before to state
  after) form a small monoid, whose product table is made once. A block of text
  is cut in chunks; the map of each chunk is the product over its characters, for
  all chunks at once; a prefix scan composes the maps, which gives each chunk its
  entry state; then all chunks run again from there and mark the starts.
* The counter reads the bytes of a word. Each transition carries the number of
  tokens by which the encoding of the longer prefix differs from that of the
  shorter one (it may be negative), so the tokens of a word are the sum over its
  path. A state says, for every suffix that could still grow into a token, where
  it stands in the trie of tokens, the last token before it, and how many tokens
  lie behind it; that decides all further emissions. States are made when they are
  first met and kept, ``STATES`` at most; when there are more, the table starts
  anew. All words of a block take a step at once; the longest words
  go one by one.

The last token of a prefix's encoding is the only token that ends there and
forms with the last token before it a pair that encodes to itself.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavement.llm.columns import arrow_struct, with_struct

#: Characters of a block, characters of a chunk, and bytes up to which words step together.
BLOCK, CHUNK, STEPS = 1 << 20, 256, 48
#: States of the counter that are kept at once (about 250 bytes each), and slots of its table of transitions.
STATES, SLOTS = 300_000, 1 << 21

# Classes of characters the splitter tells apart. X: s, t, m, d; RV: r, v.
OTHER, LETTER, NUMBER, SPACE, WHITE, QUOTE, X, RV, E, LL, END = range(11)
# Its states: before a word; in letters, numbers, other signs; after a space, after other white space;
# after a word's first quote, and that with r or v, and that with l.
BEGIN, IN_L, IN_N, IN_O, IN_S, IN_W, IN_Q, IN_QR, IN_QL = range(9)
#: Marks of a transition: a word starts here; a word started one character earlier.
HERE, EARLIER = 1, 2


def _step(state: int, c: int) -> tuple[int, int]:
    """(next state, marks) of the splitter."""
    kind = IN_L if c in (LETTER, X, RV, E, LL) else {NUMBER: IN_N, SPACE: IN_S, WHITE: IN_W, QUOTE: IN_Q, END: BEGIN}.get(c, IN_O)
    new = kind, HERE
    if c == END:
        return (BEGIN, HERE | (EARLIER if state in (IN_QR, IN_QL) else 0))
    if state == BEGIN:
        return new
    if state in (IN_S, IN_W):
        if kind in (IN_S, IN_W):
            return kind, 0
        # the last white character of a run goes by itself, or with what follows if it is a space
        return (IN_O if kind == IN_Q else kind, EARLIER) if state == IN_S else (kind, EARLIER | HERE)
    if state == IN_Q:
        if c == X:
            return BEGIN, 0
        if c in (RV, LL):
            return (IN_QR if c == RV else IN_QL), 0
        return (IN_O, 0) if kind in (IN_O, IN_Q) else new
    if state in (IN_QR, IN_QL):
        if c == (E if state == IN_QR else LL):
            return BEGIN, 0
        return (IN_L, EARLIER) if kind == IN_L else (kind, EARLIER | HERE)
    if kind == state or (state == IN_O and kind == IN_Q):
        return state, 0
    return new


class Splitter:
    """The splitter's tables: classes of all characters, the monoid of state maps and its products."""

    def __init__(self):
        every = np.arange(0x110000)
        text = "".join(map(chr, every[(every < 0xD800) | (every > 0xDFFF)]))
        self.classes = np.full(0x110001, OTHER, np.uint8)
        for pattern, c in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\p{White_Space}", WHITE)):
            self.classes[[ord(x) for x in regex.findall(pattern, text)]] = c
        for chars, c in ((" ", SPACE), ("'", QUOTE), ("stmd", X), ("rv", RV), ("e", E), ("l", LL)):
            self.classes[[ord(x) for x in chars]] = c
        self.classes[0x110000] = END
        steps = [[_step(s, c) for s in range(9)] for c in range(11)]
        self.next = np.array([[s for s, _ in row] for row in steps], np.uint8)
        self.marks = np.array([[m for _, m in row] for row in steps], np.uint8)
        # close the maps of single characters, and the identity, under composition
        maps, number = [tuple(range(9))], {tuple(range(9)): 0}
        first = [tuple(row) for row in self.next.tolist()]
        for m in maps:
            for g in first:
                both = tuple(g[s] for s in m)
                if both not in number:
                    number[both] = len(maps)
                    maps.append(both)
        self.of_class = np.array([number[g] for g in first], np.uint16)
        self.maps = np.array(maps, np.uint8)
        self.product = np.array([[number[tuple(b[s] for s in a)] for b in maps] for a in maps], np.uint16)

    def starts(self, chars: np.ndarray) -> np.ndarray:
        """Places where words start, or a text ends, in code points with 0x110000 after each text."""
        c = self.classes[chars]
        n = len(c)
        pad = -n % CHUNK
        grid = np.ascontiguousarray(np.concatenate([c, np.full(pad, END, np.uint8)]).reshape(-1, CHUNK).T)
        chunk = self.of_class[grid[0]]
        size = len(self.maps)
        flat = self.product.ravel()
        for row in grid[1:]:
            chunk = flat[chunk.astype(np.intp) * size + self.of_class[row]]
        step = 1  # inclusive prefix scan over the chunks' maps
        while step < len(chunk):
            chunk[step:] = flat[chunk[:-step].astype(np.intp) * size + chunk[step:]]
            step *= 2
        state = np.concatenate([[BEGIN], self.maps[chunk[:-1], BEGIN]]).astype(np.intp)
        marks = np.empty(grid.shape, np.uint8)
        to, out = self.next.ravel(), self.marks.ravel()
        for k, row in enumerate(grid):
            at = row.astype(np.intp) * 9 + state
            marks[k] = out[at]
            state = to[at].astype(np.intp)
        flags = marks.T.ravel()[:n]
        here = (flags & HERE) != 0
        here[:-1] |= (flags[1:] & EARLIER) != 0
        return np.flatnonzero(here)


class Counter:
    """The counter: a lazily determinised transducer over the bytes of a word."""

    def __init__(self, tokens: dict[bytes, int], merges: dict[tuple[int, int], tuple[int, int]]):
        """Token bytes to id; pairs of ids to (rank, id of the merged token)."""
        self.merges = merges
        self.names = {i: t for t, i in tokens.items()}
        self.byte = [tokens[bytes([b])] for b in range(256)]
        # trie: node * 256 + byte -> node; nodes that are tokens; nodes that go on
        self.trie: dict[int, int] = {}
        self.token_at = [-1]
        inner = set()
        for token, i in tokens.items():
            node = 0
            for b in token:
                inner.add(node)
                child = self.trie.get(node << 8 | b)
                if child is None:
                    child = self.trie[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                node = child
            self.token_at[node] = i
        self.inner = [node in inner for node in range(len(self.token_at))]
        self.pairs: dict[int, bool] = {}
        self.anew()

    def anew(self) -> None:
        """Forget all states but the first. A state is a tuple of suffixes, each packed in one number:
        node of the trie, last token before it + 1 (20 bits), tokens behind that + 2048 (12 bits)."""
        self.content: list[tuple[int, ...]] = [(2048,)]
        self.number = {self.content[0]: 0}
        # open addressing from state * 256 + byte to next state * 512 + emitted + 256 (|emitted| < 256)
        self.keys, self.entries = np.full(SLOTS, -1, np.int64), np.empty(SLOTS, np.int32)
        self.filled = 0
        self.known: dict[int, int] = {}

    def full(self) -> bool:
        return len(self.content) >= STATES or self.filled * 2 >= SLOTS

    def alone(self, word: bytes) -> list[int]:
        """Ids of a short string by applying the lowest merge again and again."""
        ids = [self.byte[b] for b in word]
        while len(ids) > 1:
            ranks = [self.merges.get(p, _NONE) for p in zip(ids, ids[1:])]
            rank, made = min(ranks)
            if made < 0:
                break
            out, i = [], 0
            while i < len(ids):
                found = i + 1 < len(ids) and ranks[i][0] == rank
                out.append(made if found else ids[i])
                i += 2 if found else 1
            ids = out
        return ids

    def pair(self, key: int) -> bool:
        """Whether the two (last token + 1, token; 20 bits each) stay as they are when their bytes are encoded together."""
        expected = [t for t in ((key >> 20) - 1, key & 0xFFFFF) if t >= 0]
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        known = self.pairs[key] = self.alone(b"".join(self.names[t] for t in expected)) == expected
        return known

    def learn(self, state: int, b: int) -> int:
        """The entry of a state's transition on a byte; its target is made if it is new."""
        trie, token_at, inner, pairs = self.trie, self.token_at, self.inner, self.pairs
        grown, token, emitted = [], -1, 0
        for suffix in self.content[state]:
            child = trie.get(suffix >> 32 << 8 | b)
            if child is None:
                continue
            if token < 0 <= token_at[child]:
                key = (suffix >> 12 & 0xFFFFF) << 20 | token_at[child]
                known = pairs.get(key)
                if known or known is None and self.pair(key):
                    token, emitted = token_at[child], 2049 - (suffix & 0xFFF)
            if inner[child]:
                grown.append(child << 32 | suffix & 0xFFFFFFFF)
        if token < 0:
            raise ValueError("the vocabulary is not one of byte-level BPE: no token ends here")
        content = (*[suffix + emitted for suffix in grown], token + 1 << 12 | 2048)
        target = self.number.get(content)
        if target is None:
            target = self.number[content] = len(self.content)
            self.content.append(content)
        return target << 9 | emitted + 256

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Entries of transitions, -1 where unknown."""
        slot = _slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.entries[slot], np.int32(-1))
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (SLOTS - 1)
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.entries[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out

    def note(self, keys: np.ndarray, entries: np.ndarray) -> None:
        """Remember new transitions, each once."""
        slot = _slot(keys)
        self.filled += len(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot] == keys
            self.entries[slot[mine]] = entries[mine]
            keys, entries, slot = keys[~mine], entries[~mine], (slot[~mine] + 1) & (SLOTS - 1)

    def word(self, data: bytes) -> int:
        """Tokens of one word, however long."""
        state, count = 0, 0
        for b in data:
            entry = self.known.get(state << 8 | b)
            if entry is None:
                if len(self.content) >= STATES or len(self.known) >= STATES:  # start anew with the state at hand
                    here = self.content[state]
                    self.anew()
                    state = self.number.setdefault(here, len(self.content))
                    if state == len(self.content):
                        self.content.append(here)
                entry = self.known[state << 8 | b] = self.learn(state, b)
            state, count = entry >> 9, count + (entry & 511) - 256
        return count

    def words(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each word: ``size`` bytes of ``data`` from ``begin``."""
        count = np.zeros(len(begin), np.int64)
        order = np.argsort(STEPS + 1 - np.minimum(size, STEPS + 1).astype(np.int16), kind="stable")
        lengths = size[order]
        long = int(np.searchsorted(-lengths, -STEPS, side="left"))
        for i in order[:long].tolist():
            count[i] = self.word(data[begin[i]:begin[i] + size[i]].tobytes())
        if self.full():
            self.anew()
        order, lengths = order[long:], lengths[long:]
        at = begin[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        active, aside = len(order), [np.empty(0, np.int64)]
        for k in range(STEPS):
            active = int(np.searchsorted(-lengths[:active], -k, side="left"))
            if not active:
                break
            keys = state[:active] << 8 | data[at[:active] + k]
            entries = self.look_up(keys)
            unknown = np.flatnonzero(entries < 0)
            if len(unknown):
                fresh, which = np.unique(keys[unknown], return_inverse=True)
                most = 0 if self.full() else STATES
                learned = [self.learn(key >> 8, key & 255) for key in fresh[:most].tolist()]
                self.note(fresh[:most], np.array(learned, np.int32))
                # where the table is full, words go one by one
                entries[unknown] = np.array([*learned, *[-1] * (len(fresh) - len(learned))], np.int32)[which]
                lost = unknown[entries[unknown] < 0]
                aside.append(lost)
                entries[lost] = 256
            state[:active] = entries >> 9
            total[:active] += (entries & 511) - 256
        count[order] = total
        for i in order[np.unique(np.concatenate(aside))].tolist():
            count[i] = self.word(data[begin[i]:begin[i] + size[i]].tobytes())
        return count


_NONE = (1 << 60, -1)


def _slot(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable ones for themselves, the rest from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizer:
    """Both transducers of a vocabulary file, and the special strings that stand in texts as one token each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, split = whole["model"], whole["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] \
                or whole["normalizer"] or odd or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in whole["added_tokens"]):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        letters = byte_letters()
        spell = lambda token: bytes(letters[x] for x in token)
        special = {a["content"] for a in whole["added_tokens"]}
        ids = {t: i for t, i in model["vocab"].items() if t not in special}
        merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            merges[(ids[a], ids[b])] = (rank, ids[a + b])
        self.splitter = Splitter()
        self.counter = Counter({spell(t): i for t, i in ids.items()}, merges)
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def parts(self, text: str):
        """(stretch of text, special tokens after it); long stretches are cut before white space, where a word always ends."""
        stretches = self.special.split(text) if self.special and self.special.search(text) else [text]
        for k, stretch in enumerate(stretches):
            at = 0
            while len(stretch) - at > BLOCK:
                cut = _CUT.search(stretch, at + BLOCK)
                if cut is None:
                    break
                yield stretch[at:cut.end()], 0
                at = cut.end()
            yield stretch[at:] if at else stretch, int(k < len(stretches) - 1)

    def count(self, texts) -> np.ndarray:
        """Tokens of each text (null: none)."""
        counts: list[int] = []
        held: list[tuple[int, str]] = []
        size = 0
        for text in texts:
            counts.append(0)
            for stretch, extra in self.parts(text) if text else ():
                counts[-1] += extra
                if stretch:
                    held.append((len(counts) - 1, stretch))
                    size += len(stretch) + 1
                if size >= BLOCK:
                    self._block(held, counts)
                    held, size = [], 0
        self._block(held, counts)
        return np.array(counts, np.int64)

    def _block(self, held: list[tuple[int, str]], counts: list[int]) -> None:
        if not held:
            return
        joined = "\0".join([t for _, t in held] + [""])
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        ends = np.cumsum([len(t) + 1 for _, t in held]) - 1
        chars[ends] = 0x110000
        starts = self.splitter.starts(chars)
        data = np.frombuffer(joined.encode("utf-8"), np.uint8)
        first = starts if len(data) == len(chars) else np.flatnonzero((data & 0xC0) != 0x80)[starts]
        after = np.append(first[1:], len(data))
        word = chars[starts] != 0x110000
        found = self.counter.words(data, first[word], (after - first)[word])
        which = np.searchsorted(ends, starts[word], side="left")
        for (row, _), n in zip(held, np.bincount(which, weights=found, minlength=len(held)).tolist()):
            counts[row] += int(n)


#: A sign that is no white space, with a blank or a line's end behind it.
_CUT = re.compile(r"[^\s\x1c-\x1f\x85](?=[ \n\t])")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 512) -> tuple[DataFrame, str]:
    """``df`` with a struct (n_bytes, n_tokens, over_limit) per row, and its name.

    Null and empty texts have no bytes and no tokens. Special strings of the
    vocabulary inside a text count as one token each. Long texts are read block by
    block, so memory follows the block and not the text; only a stretch without
    any blank is taken whole. Equal rows count alike; an empty table has no rows;
    other columns pass through whatever their names are. ``path`` must be readable
    on every executor.
    """

    @F.arrow_udf("n_bytes long, n_tokens long, over_limit boolean")
    def count(texts: pa.Array) -> pa.Array:
        found = tokenizer(path).count(t.as_py() for t in texts).tolist()
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        fields = [("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]
        return arrow_struct(fields, [(b, n, n > limit) for b, n in zip(sizes, found)])

    return with_struct(df, text, count, "_count")
