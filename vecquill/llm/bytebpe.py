"""A byte-level BPE tokenizer's ids for whole batches of texts, pre-token by pre-token.

Texts are cut into the pre-tokens of the tokenizer's own pattern by arithmetic on character classes, each pre-token is
named by a 64-bit hash of its bytes, and a table holds the ids of every pre-token seen. The table starts with those
vocabulary strings that the library was shown to encode alone as exactly one token (``proven_whole``); only the rest
are handed to the library's merges, once each while they stay in the table. A text that holds a special token's string
is encoded by the library itself, which is its default treatment.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

from vecquill.llm.shared import expand as _expand
from vecquill.llm.textbytes import span_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pre-tokens that the table holds at most; beyond, it starts again from the proven ones.
TABLE_LIMIT = 1 << 20
#: Bytes of a pre-token beyond which the library merges it.
LONG_PRETOKEN = 64
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
# What counts as white space in the tokenizer's pattern (Unicode White_Space).
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The endings that the pattern splits off after an apostrophe.
_ENDINGS_1, _ENDINGS_2 = "stmd", ("re", "ve", "ll")

_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    global _classes
    if _classes is None:
        kinds = np.full(0x110000, _OTHER, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                kinds[c] = _LETTER
            elif k == "N":
                kinds[c] = _NUMBER
        kinds[_WHITE] = _SPACE
        _classes = kinds
    return _classes


def pretoken_starts(chars: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """A flag for each character: a pre-token begins here. doc_start flags the first character of each text."""
    n = len(chars)
    kind = char_classes()[chars]
    prev = np.empty(n, np.uint8)
    prev[0] = 255
    prev[1:] = kind[:-1]
    prev[doc_start] = 255
    ends_doc = np.empty(n, bool)
    ends_doc[-1] = True
    ends_doc[:-1] = doc_start[1:]
    nxt = np.empty(n, np.uint8)
    nxt[-1] = 255
    nxt[:-1] = kind[1:]
    nxt[ends_doc] = 255
    white = kind == _SPACE
    run = kind != prev  # a run of one class begins
    # the last white space before something else stands apart from the white space before it
    start = run | (white & (nxt != _SPACE) & (nxt != 255))
    # a plain space takes what follows with it
    glued = np.zeros(n, bool)
    glued[1:] = (chars[:-1] == 32) & ~white[1:]
    glued[doc_start] = False
    start &= ~glued
    # apostrophe endings: the apostrophe begins a pre-token and a listed ending follows
    at = np.flatnonzero((chars == 39) & start)
    if len(at):
        pad = np.concatenate([chars, [0, 0]])
        same1 = ~ends_doc[at]
        one = same1 & np.isin(pad[at + 1], [ord(c) for c in _ENDINGS_1])
        same2 = same1 & ~ends_doc[np.minimum(at + 1, n - 1)]
        two = np.zeros(len(at), bool)
        for e in _ENDINGS_2:
            two |= (pad[at + 1] == ord(e[0])) & (pad[at + 2] == ord(e[1]))
        two &= same2
        for hit, size in ((at[one], 1), (at[two & ~one], 2)):
            start[hit + 1] = False  # the ending belongs to the apostrophe
            after = hit + 1 + size
            after = after[after < n]
            start[after] = ~glued[after]
    return start


class Merges:
    """The merge rules of a byte-level BPE model, applied to many pre-tokens in step: in each round every pre-token
    that still has a pair with a rule merges its pair of least rank, the leftmost of several."""

    def __init__(self, tokenizer):
        model = json.loads(tokenizer.to_str())["model"]
        vocab = model["vocab"]
        letters = byte_alphabet()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank, self.merged = key[order], order.astype(np.int64), np.array([vocab[a + b] for a, b in pairs], np.int64)
        # most pairs that occur have a rule or recur: a direct-mapped table of the pair answers first
        self.slot = np.full(1 << 20, -1, np.int64)
        self.slot[self._at(self.key)] = np.arange(len(key))

    def _at(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        i = self.slot[self._at(key)]
        out = np.full(len(key), NO_RULE, np.int64)
        hit = (i >= 0) & (self.key[i] == key)
        out[hit] = self.rank[i[hit]]
        other = np.flatnonzero((i >= 0) & ~hit)  # the place is taken by another pair
        j = np.minimum(np.searchsorted(self.key, key[other]), len(self.key) - 1)
        ok = self.key[j] == key[other]
        out[other[ok]] = self.rank[j[ok]]
        return out

    def apply(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens in a row and how many each has. data: their bytes in a row."""
        ids, word = self.byte_id[data], np.repeat(np.arange(len(sizes)), sizes)
        done_ids, done_word = [], []
        # rank of the pair that begins at each symbol; the last symbol of a word has none
        rank = np.full(len(ids), NO_RULE, np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1]) if len(word) else np.zeros(0, np.int64)
        rank[inner] = self.ranks(ids[inner], ids[inner + 1])
        while len(ids):
            starts = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
            lengths = np.diff(np.concatenate([starts, [len(word)]]))
            best = np.minimum.reduceat(rank, starts)
            over = best == NO_RULE
            if over.any():
                gone = np.repeat(over, lengths)
                done_ids.append(ids[gone])
                done_word.append(word[gone])
                keep = ~gone
                ids, word, rank, best, lengths = ids[keep], word[keep], rank[keep], best[~over], lengths[~over]
                if not len(ids):
                    break
                starts = np.cumsum(lengths) - lengths
            at = np.flatnonzero(rank == np.repeat(best, lengths))
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]  # the leftmost of each word
            ids[at] = self.merged[best]
            rank[at] = NO_RULE
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            spot = at - np.arange(len(at))  # its place once the right symbols are gone
            ids, word, rank = ids[keep], word[keep], rank[keep]
            for l in (spot - 1, spot):
                l = l[(l >= 0) & (l + 1 < len(ids))]
                l = l[word[l] == word[l + 1]]
                rank[l] = self.ranks(ids[l], ids[l + 1])
            last = spot[(spot + 1 >= len(ids))]
            rank[last] = NO_RULE
        flat = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64)
        of = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        order = np.argsort(of, kind="stable")
        return flat[order].astype(np.uint32), np.bincount(of, minlength=len(sizes))


NO_RULE = 1 << 40


class PretokenTable:
    """An open-addressing table from a pre-token's hash to its ids, probed for many hashes at once."""

    def __init__(self, tokenizer, size_bits: int = 22):
        self.tokenizer = tokenizer
        self.bits, self.mask = size_bits, (1 << size_bits) - 1
        self.special = [t for t in (a.content for a in tokenizer.get_added_tokens_decoder().values())]
        self._whole = proven_whole(tokenizer)
        self.merges = Merges(tokenizer)
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.slots = np.zeros(1 << self.bits, np.int32)
        self.ids, self.n_ids, self.begin, self.count, self.n = np.zeros(1 << 20, np.uint32), 0, np.zeros(1 << 17, np.int64), np.zeros(1 << 17, np.int32), 0
        hashes, ids = self._whole
        self._insert(hashes, ids, np.ones(len(ids), np.int32))

    def _insert(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        m = len(hashes)
        while self.n + m > len(self.begin):
            self.begin, self.count = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.count, 2 * len(self.count))
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.begin[self.n : self.n + m] = self.n_ids + np.cumsum(counts) - counts
        self.count[self.n : self.n + m] = counts
        number = np.arange(self.n, self.n + m, dtype=np.int32)
        self.n, self.n_ids = self.n + m, self.n_ids + len(ids)
        at, todo = (hashes & np.uint64(self.mask)).astype(np.int64), np.arange(m)
        while len(todo):
            free = self.keys[at[todo]] == 0
            self.keys[at[todo[free]]] = hashes[todo[free]]  # of several that want one place, the last gets it
            self.slots[at[todo[free]]] = number[todo[free]]
            todo = todo[self.keys[at[todo]] != hashes[todo]]
            at[todo] = (at[todo] + 1) & self.mask

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash's entry, or -1."""
        at = (hashes & np.uint64(self.mask)).astype(np.int64)
        key = self.keys[at]
        out = np.where(key == hashes, self.slots[at], np.int32(-1))
        todo = np.flatnonzero((key != hashes) & (key != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            key = self.keys[at[todo]]
            hit = key == hashes[todo]
            out[todo[hit]] = self.slots[at[todo[hit]]]
            todo = todo[~hit & (key != 0)]
        return out

    def entries(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of the entry of each pre-token, after the unknown ones have been merged and added."""
        hashes = span_hashes(data, starts, ends) | np.uint64(1)
        out = self.find(hashes)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            fresh, first = np.unique(hashes[missing], return_index=True)
            if self.n + len(fresh) > TABLE_LIMIT and self.n > len(self._whole[0]):
                self._reset()
                return self.entries(data, starts, ends)
            at = missing[first]
            raw = data.tobytes()
            ids, counts = self._merge([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            self._insert(fresh, ids, counts)
            out[missing] = self.find(hashes[missing])
        return out

    def _merge(self, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each pre-token: merges for all of them at once, the library for very long ones."""
        sizes = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        long_ = np.flatnonzero(sizes > LONG_PRETOKEN)
        short = np.flatnonzero(sizes <= LONG_PRETOKEN)
        flat, counts = self.merges.apply(np.frombuffer(b"".join(pretokens[i] for i in short), np.uint8), sizes[short])
        of = np.repeat(short, counts)
        if len(long_):
            more = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch([pretokens[i].decode() for i in long_], add_special_tokens=False)]
            flat, of = np.concatenate([flat, *more]), np.concatenate([of, np.repeat(long_, [len(x) for x in more])])
        order = np.argsort(of, kind="stable")
        return flat[order], np.bincount(of, minlength=len(pretokens)).astype(np.int32)

    def tokenize(self, data: np.ndarray, offs: np.ndarray, with_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Of a slice of texts: the tokens of each text, and all ids in a row if wanted."""
        rows = len(offs) - 1
        odd = self._holds_special(data, offs)
        counts = np.zeros(rows, np.int64)
        if len(data) == 0:
            return counts, np.zeros(0, np.uint32) if with_ids else None
        lead = (data & 0xC0) != 0x80
        byte_at = np.flatnonzero(lead)
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        doc_start = np.zeros(len(data) + 1, bool)
        doc_start[offs[:-1]] = True
        starts = byte_at[pretoken_starts(chars, doc_start[byte_at])]
        ends = np.concatenate([starts[1:], [len(data)]])
        number = self.entries(data, starts, ends)
        per = self.count[number]
        first = np.searchsorted(starts, offs)
        total = np.concatenate([[0], np.cumsum(per, dtype=np.int64)])
        counts = total[first[1:]] - total[first[:-1]]
        ids = self.ids[_expand(self.begin[number], per.astype(np.int64))] if with_ids else None
        if len(odd):
            raw = data.tobytes()
            redone = {i: np.array(self.tokenizer.encode(raw[offs[i] : offs[i + 1]].decode(), add_special_tokens=False).ids, np.uint32) for i in odd}
            if with_ids:
                bounds = np.concatenate([[0], np.cumsum(counts)])
                ids = np.concatenate([redone.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(rows)])
            for i, x in redone.items():
                counts[i] = len(x)
        return counts, ids

    def _holds_special(self, data: np.ndarray, offs: np.ndarray) -> list[int]:
        raw, rows = data.tobytes(), set()
        for s in self.special:
            at = raw.find(s.encode())
            while at >= 0:
                rows.add(int(np.searchsorted(offs, at, side="right")) - 1)
                at = raw.find(s.encode(), at + 1)
        return sorted(rows)


def proven_whole(tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and ids of the vocabulary strings that the library encodes, alone, as exactly that one token."""
    vocab = tokenizer.get_vocab(with_added_tokens=False)
    printable = byte_alphabet()
    texts, ids = [], []
    for piece, i in vocab.items():
        try:
            texts.append(bytes(printable[c] for c in piece).decode())
            ids.append(i)
        except (UnicodeDecodeError, KeyError):
            continue  # a part of a character never stands alone as a pre-token
    found = tokenizer.encode_batch(texts, add_special_tokens=False)
    proven = [(t.encode(), i) for t, i, e in zip(texts, ids, found) if e.ids == [i] and t]
    data = np.frombuffer(b"".join(t for t, _ in proven), np.uint8)
    ends = np.cumsum([len(t) for t, _ in proven])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return span_hashes(data, starts, ends) | np.uint64(1), np.array([i for _, i in proven], np.uint32)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: visible Latin-1 characters for themselves, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


_tables: dict[str, PretokenTable] = {}


def table(path: str) -> PretokenTable:
    """This process's table for a vocabulary file."""
    if path not in _tables:
        from tokenizers import Tokenizer

        _tables[path] = PretokenTable(Tokenizer.from_file(path))
    return _tables[path]
