"""Byte-level BPE encoding and decoding as a tree reduction.

Within a match of the split pattern, bytes are halved recursively; the ids of two halves
are joined by encoding a window around their boundary afresh, and the window grows until
the tokens beside it are compatible with their neighbours inside. A sequence in which all
adjacent tokens are compatible (the two, encoded together, stay those two) is the one
encoding of its bytes, so a joined result equals that of the whole. Decoding maps ids to
bytes and concatenates up the tree. Matches are independent, so a text's encoding is the
concatenation of theirs.

Defined results: null or empty text has no ids and decodes to no bytes; special-token
strings are ordinary text; repeated rows are encoded each for itself; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import KEPT, flat, mix, prefix_sums, release, row_slices, ship, span_hash

#: Bytes of a leaf of the tree, at most, and ids of one when decoding.
LEAF, DECODE_LEAF = 4, 64
#: Pairs of tokens whose fit a worker remembers.
FITS = 300_000
NEVER = 1 << 40
#: Entries of a worker's memo, and ids that one piece may add to it.
MEMO, MEMO_IDS = 1_000_000, 1 << 20
#: Texts coded together, in bytes.
AT_ONCE = 3 << 17
PLAIN = frozenset(".,;:!?")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


class MonoidBPE:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self._fits: dict[int, bool] = {}
        self._pairs: tuple[np.ndarray, np.ndarray] | None = None

    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash table from a pair of ids to the id that it merges to."""
        if self._pairs is None:
            ranks = self.ranks
            pairs = {}
            for whole, i in ranks.items():
                for k in range(1, len(whole)):
                    a, b = ranks.get(whole[:k]), ranks.get(whole[k:])
                    if a is not None and b is not None:
                        pairs[a << 20 | b] = i
            size = 1 << max(10, (3 * len(pairs)).bit_length())
            keys, to = np.full(size, -1, np.int64), np.zeros(size, np.int64)
            left, val = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
            at = _slot(left, size)
            while len(left):  # one free slot takes one key; the others move on
                slot, who = np.unique(at, return_index=True)
                free = keys[slot] == -1
                keys[slot[free]], to[slot[free]] = left[who[free]], val[who[free]]
                rest = np.ones(len(left), bool)
                rest[who[free]] = False
                left, val, at = left[rest], val[rest], (at[rest] + 1) % size
            self._pairs = keys, to
        return self._pairs

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys, to = self._table()
        key = a << 20 | b
        at = _slot(key, len(keys))
        out = np.full(len(key), NEVER, np.int64)
        todo = np.arange(len(key))
        while len(todo):
            got = keys[at]
            hit = got == key
            out[todo[hit]] = to[at[hit]]
            go = ~hit & (got != -1)
            todo, key, at = todo[go], key[go], (at[go] + 1) & (len(keys) - 1)
        return out

    def leaves(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many short byte strings by merging alone, each packed as 32-bit integers:
        in every round each string makes its one next merge."""
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        first = np.array([self.ranks.get(bytes([i]), 0) for i in range(256)], np.int64)
        tok = first[np.frombuffer(b"".join(pieces), np.uint8)]
        word = np.repeat(np.arange(n), size)
        done_tok, done_word = [], []
        while len(tok):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank = np.full(len(tok), NEVER, np.int64)
            same = np.flatnonzero(word[1:] == word[:-1])
            rank[same] = self._merged(tok[same], tok[same + 1])
            low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(tok)]))
            over = low == NEVER
            if over.any():
                done_tok.append(tok[over])
                done_word.append(word[over])
            at = np.flatnonzero((rank == low) & ~over)
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]] if len(at) else at
            tok[at] = rank[at]
            stay = ~over
            stay[at + 1] = False
            tok, word = tok[stay], word[stay]
        tok, word = np.concatenate(done_tok or [tok]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        packed = tok[order].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word, minlength=n)) * 4
        at = [0, *ends.tolist()]
        return [packed[at[i] : at[i + 1]] for i in range(n)]

    def encode_all(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many matches of the pattern, by tree reduction of all at once."""
        out: list[bytes] = [b""] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:  # a match that is a token stays one
                out[i] = whole.to_bytes(4, "little")
            elif p:
                groups.setdefault(1 << max(0, (len(p) - 1) // LEAF).bit_length(), []).append(i)
        for n, own in groups.items():
            for i, x in zip(own, self.reduce([pieces[i] for i in own], n), strict=True):
                out[i] = x
        return out

    def reduce(self, pieces: list[bytes], n: int) -> list[bytes]:
        """Packed ids of pieces of at least ``n`` bytes: each is halved until there are ``n``
        parts, those are encoded, and neighbours are joined level by level."""
        parts = pieces
        while len(parts) < n * len(pieces):
            parts = [h for p in parts for h in (p[: len(p) // 2], p[len(p) // 2 :])]
        leaf = self.leaves(parts)
        tok = np.frombuffer(b"".join(leaf), "<u4").astype(np.int64)
        off = np.r_[0, np.cumsum(np.fromiter(map(len, leaf), np.int64, len(leaf)) // 4)]
        while n > 1:
            tok, off = self.join_all(tok, off)
            n //= 2
        packed, at = tok.astype("<u4").tobytes(), (4 * off).tolist()
        return [packed[at[i] : at[i + 1]] for i in range(len(pieces))]

    def join_all(self, tok: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Join segments 2i and 2i + 1 of the tokens, all i at once. Where the tokens at a
        boundary don't fit, a window around it is encoded afresh, and grows until the tokens
        beside it fit what came out, or it is all there is."""
        lo, mid, hi = off[:-1:2], off[1::2], off[2::2]
        todo = np.flatnonzero(~self.fits(tok[mid - 1], tok[mid]))
        done = []
        size = 1
        while len(todo):
            s, e = np.maximum(lo[todo], mid[todo] - size), np.minimum(hi[todo], mid[todo] + size)
            token = self.token.__getitem__
            flat = tok.tolist()
            new = self.leaves([b"".join(map(token, flat[a:z])) for a, z in zip(s.tolist(), e.tolist(), strict=True)])
            count = np.fromiter(map(len, new), np.int64, len(new)) // 4
            made = np.frombuffer(b"".join(new), "<u4").astype(np.int64)
            last = np.cumsum(count)
            settled = (s == lo[todo]) | self.fits(tok[s - 1], made[last - count])
            settled &= (e == hi[todo]) | self.fits(made[last - 1], tok[np.minimum(e, len(tok) - 1)])
            done.append((todo[settled], s[settled], e[settled], count[settled], made[np.repeat(settled, count)]))
            todo = todo[~settled]
            size *= 2
        if not done:
            return tok, off[::2]
        pair, s, e, count, made = (np.concatenate([d[i] for d in done]) for i in range(5))
        gone = np.zeros(len(tok) + 1, np.int64)
        np.add.at(gone, s, 1)
        np.add.at(gone, e, -1)
        stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
        step = np.arange(len(made)) - np.repeat(np.cumsum(count) - count, count)
        order = np.lexsort((np.r_[np.zeros(len(stay), np.int64), step], np.r_[stay, np.repeat(s, count)]))
        sizes = hi - lo
        sizes[pair] += count - (e - s)
        return np.r_[tok[stay], made][order], np.r_[0, np.cumsum(sizes)]

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens stay as they are where they stand side by side."""
        key, back = np.unique(a << 20 | b, return_inverse=True)
        known, keys = self._fits, key.tolist()
        fresh = [k for k in keys if k not in known]
        if fresh:
            if len(known) + len(fresh) > FITS:
                known.clear()
                fresh = keys
            # tokens of a vocabulary may be long, but are bounded
            pairs = [(k >> 20, k & ((1 << 20) - 1)) for k in fresh]
            got = self.leaves([self.token[x] + self.token[y] for x, y in pairs])
            known.update((k, g == struct.pack("<2I", *p)) for k, p, g in zip(fresh, pairs, got, strict=True))
        return np.fromiter(map(known.__getitem__, keys), bool, len(keys))[back]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenation of what two id lists stand for."""
        if not left or not right:
            return left or right
        return self.join_all(np.array([*left, *right], np.int64), np.array([0, len(left), len(left) + len(right)]))[0].tolist()

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        return np.frombuffer(self.encode_all([piece])[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that ids stand for: those of two halves, one behind the other."""
        if len(ids) <= DECODE_LEAF:
            return b"".join(map(self.token.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


# last and middle bytes of white space beyond ASCII, and its first bytes
_LAST = np.isin(np.arange(256), [0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F])
_MIDDLE = np.isin(np.arange(256), [0xC2, 0x9A, 0x80, 0x81])
_LEAD = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
# letters of ASCII, last bytes of those that begin with 0xC3, and signs but the apostrophe
_LETTER = np.array([chr(c).isalpha() and c < 128 for c in range(256)])
_LATIN = np.array([0x80 <= c <= 0xBF and c not in (0x97, 0xB7) for c in range(256)])
_SIGN = np.array([33 <= c <= 126 and not chr(c).isalnum() and c != 39 for c in range(256)])
_SIGNS = _SIGN.tobytes()


def cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the stretches of some texts: each text's start, every single space between
    two characters that aren't white space, and every sign (but an apostrophe) behind a
    letter. Such a space or sign always begins a match of the pattern, as letters and signs
    only share one where the sign comes first; so coding stretches one by one changes nothing."""
    space = np.flatnonzero(data == 32)
    sign = np.flatnonzero(np.frombuffer(data.tobytes().translate(_SIGNS), bool))
    space = space[(space > 0) & (space < len(data) - 1)]
    before, after = data[space - 1], data[np.minimum(space + 1, len(data) - 1)]
    two = np.where(space > 1, data[space - 2], 32)
    cut = np.zeros(len(data), bool)
    cut[space] = (before > 32) & ~(_LAST[before] & _MIDDLE[two]) & (after > 32) & ~_LEAD[after]
    sign = sign[sign > 0]
    before = data[sign - 1]
    cut[sign] = _LETTER[before] | ((np.where(sign > 1, data[sign - 2], 32) == 0xC3) & _LATIN[before])
    some = np.diff(off) > 0
    cut[off[1:][some] - 1] = False
    cut[off[:-1][some]] = True
    return np.flatnonzero(cut)


#: Bytes that are hashed eight at a time; of longer stretches the rest is hashed by powers.
SHORT = 64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each stretch, the same wherever its bytes stand. Up to eight
    bytes give two that no other such bytes give."""
    size = end - start
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,)).copy()
    h = mix(size.astype(np.uint64))
    other = h + np.uint64(0x9E3779B97F4A7C15)
    left, which, at = size, slice(None), start
    for _ in range(SHORT // 8):
        word = eight[at] & _MASK[np.minimum(left, 8)]
        h[which] = mix(h[which] ^ word)
        x = (other[which] + word) * np.uint64(0xD1342543DE82EF95)
        other[which] = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        which = more if isinstance(which, slice) else which[more]
        left, at = left[more] - 8, at[more] + 8
    long = np.flatnonzero(size > SHORT)
    if len(long):
        parts = [data[a + SHORT : z] for a, z in zip(start[long].tolist(), end[long].tolist(), strict=True)]
        upto = np.r_[0, np.cumsum([len(x) for x in parts])]
        rest = np.concatenate(parts)
        h[long] = mix(h[long] ^ span_hash(prefix_sums(rest), upto[:-1], upto[1:]))
        other[long] = mix(other[long] + span_hash(prefix_sums(rest, 1), upto[:-1], upto[1:], 1))
    return h | np.uint64(1), other


class Stretches:
    """Codes texts by their stretches, with a memo in front. A stretch is known by a
    64-bit hash and the upper bits of another; the memo is a table of them with free slots, and the ids of
    all known stretches stand in one array. A full memo goes on with the stretches that were met
    again since it was last full. ``code`` gives the packed
    ids of strings; ``words`` those of encoded strings that begin with one space and end with
    no white space, of which any row could be coded as one."""

    def __init__(self, code: Callable[[list[str]], list[bytes]], width: int, size: int = MEMO, words: Callable[[list[bytes]], list[bytes]] | None = None):
        self.code, self.width, self.size = code, width, size
        self.words = words or (lambda keys: code([k.decode() for k in keys]))
        self.bits = (4 * size // 3).bit_length()
        self.clear()

    def clear(self) -> None:
        n = 1 << self.bits
        # a slot has the first hash beside the upper bits of the second and the entry
        self.slots, self.low = np.zeros((n, 2), np.uint64), np.uint64(n - 1)
        self.known, self.used = 0, 0
        self.begin, self.count, self.again = np.zeros(1 << 10, np.int32), np.zeros(1 << 10, np.int32), np.zeros(1 << 10, bool)
        self.ids = np.zeros(1 << 12, f"<u{self.width}")

    def find(self, h: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The entry of each stretch, -1 where it isn't known."""
        out = np.full(len(h), -1, np.int64)
        todo, slot = np.arange(len(h)), (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            got = np.take(self.slots, slot, axis=0)
            hit = (got[:, 0] == h) & ((got[:, 1] ^ other) <= self.low)
            out[todo[hit]] = got[hit, 1] & self.low
            go = np.flatnonzero(~hit & (got[:, 0] != 0))
            todo, h, other, slot = todo[go], h[go], other[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def put(self, h: np.ndarray, other: np.ndarray, entry: np.ndarray) -> None:
        """Give slots to distinct stretches that aren't known."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        row = np.column_stack([h, (other & ~self.low) | entry.astype(np.uint64)])
        while len(row):
            at, who = np.unique(slot, return_index=True)
            who = who[self.slots[at, 0] == 0]
            self.slots[slot[who]] = row[who]
            rest = np.ones(len(row), bool)
            rest[who] = False
            row, slot = row[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def add(self, coded: list[bytes]) -> np.ndarray:
        """New entries for packed ids."""
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // self.width
        total, n = int(size.sum()), len(coded)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.known + n > len(self.begin):
            self.begin, self.count, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count, self.again))
        self.ids[self.used : self.used + total] = np.frombuffer(b"".join(coded), self.ids.dtype)
        self.begin[self.known : self.known + n] = self.used + np.cumsum(size) - size
        self.count[self.known : self.known + n] = size
        self.again[self.known : self.known + n] = False
        self.known, self.used = self.known + n, self.used + total
        return np.arange(self.known - n, self.known)

    def renew(self) -> None:
        """Forget what wasn't met again; all, if little would be forgotten."""
        kept = self.slots[self.slots[:, 0] != 0]
        kept = kept[self.again[(kept[:, 1] & self.low).astype(np.int64)]]
        if 4 * len(kept) > 3 * self.size:
            kept = kept[:0]
        entry = (kept[:, 1] & self.low).astype(np.int64)
        begin, count = self.begin[entry].astype(np.int64), self.count[entry].astype(np.int64)
        upto = np.cumsum(count)
        ids = self.ids[np.repeat(begin - upto + count, count) + np.arange(count.sum())]
        self.clear()
        n = len(kept)
        room = max(1 << 10, n)
        self.begin, self.count, self.again = np.zeros(room, np.int32), np.zeros(room, np.int32), np.zeros(room, bool)
        self.begin[:n], self.count[:n] = upto - count, count
        self.ids = ids if len(ids) > len(self.ids) else self.ids
        self.ids[: len(ids)] = ids
        self.known, self.used = n, len(ids)
        self.put(kept[:, 0], kept[:, 1], np.arange(n))

    def coded(self, keys: list[bytes]) -> list[bytes]:
        plain, rest = [], []
        for i, k in enumerate(keys):
            (plain if k[0] == 32 and k[-1] > 32 and (k[-1] < 128 or not k.decode()[-1].isspace()) else rest).append(i)
        out = [b""] * len(keys)
        for i, v in zip(plain, self.words([keys[i] for i in plain]) if plain else (), strict=True):
            out[i] = v
        for i, v in zip(rest, self.code([keys[i].decode() for i in rest]) if rest else (), strict=True):
            out[i] = v
        return out

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, first id of each text and the end)."""
        n = len(off) - 1
        if not len(data):
            return np.zeros(0, f"<u{self.width}"), np.zeros(n + 1, np.int64)
        start = cuts(data, off)
        end = np.r_[start[1:], len(data)]
        begin = np.unique(np.searchsorted(start, np.arange(0, len(data), AT_ONCE)))
        parts = [self._piece(data[start[i] : end[j - 1]], start[i:j] - start[i], end[i:j] - start[i]) for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(start)], strict=True) if j > i]
        total = np.r_[0, np.cumsum(np.concatenate([c for _, c in parts]))]
        return np.concatenate([x for x, _ in parts]), total[np.searchsorted(start, off, side="left")]

    def _piece(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, ids of each stretch) of the stretches of a piece of bytes."""
        h, other = names(data, start, end)
        which = self.find(h, other)
        fresh = np.flatnonzero(which < 0)
        known, used = self.known, self.used
        self.again[which[which >= 0] if len(fresh) else which] = True
        if len(fresh):
            _, first, back = np.unique(h[fresh], return_index=True, return_inverse=True)
            if not np.array_equal(other[fresh[first]][back], other[fresh]):  # tell apart by both
                _, first, back = np.unique(np.column_stack([h, other])[fresh], axis=0, return_index=True, return_inverse=True)
                back = back.reshape(-1)
            at = fresh[first]
            raw = data.tobytes()
            entry = self.add(self.coded([raw[a:z] for a, z in zip(start[at].tolist(), end[at].tolist(), strict=True)]))
            which[fresh] = entry[back]
        count = self.count[which].astype(np.int64)
        upto = np.cumsum(count)
        out = self.ids[np.repeat(self.begin[which] - upto + count, count) + np.arange(upto[-1])]
        if len(fresh):
            if self.known > self.size:
                self.renew()
            elif used + MEMO_IDS < self.used:  # what a single piece may leave behind
                self.known, self.used = known, used
            else:
                self.put(h[at], other[at], entry)
        return out, count


def matches(s: str, split: Callable[[str], list[str]]) -> list[str]:
    """The pattern's matches in a stretch that begins with one space; letters alone are
    one match, and one plain sign behind them another."""
    if s[1:].isalpha() and s[0] == " ":
        return [s]
    if s[-1:] in PLAIN and s[1:-1].isalpha() and s[0] == " ":
        return [s[:-1], s[-1]]
    return split(s)


_coders: dict[tuple[str, str], tuple[MonoidBPE, Stretches]] = {}
KEPT.append(_coders)


def coder(path: str, pattern: str) -> tuple[MonoidBPE, Stretches]:
    """The worker's encoder for a file of ranks, kept between tasks."""
    if (path, pattern) not in _coders:
        bpe = MonoidBPE(load_ranks(path))
        split = regex.compile(pattern).findall

        def code(stretches: list[str]) -> list[bytes]:
            cut = [matches(s, split) for s in stretches]
            distinct = {p: i for i, p in enumerate(dict.fromkeys(p for c in cut for p in c))}
            ids = bpe.encode_all([p.encode() for p in distinct])
            return [ids[distinct[c[0]]] if len(c) == 1 else b"".join([ids[distinct[p]] for p in c]) for c in cut]

        _coders[path, pattern] = bpe, Stretches(code, 4)
    return _coders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded``: ids as little-endian unsigned 32-bit integers, and the
    bytes that those ids decode to."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, memo = coder(path, pattern)
        for b in batches:
            data, off = flat(b.column("text"))
            for lo, hi in row_slices(off, AT_ONCE):
                ids, at = memo.encode(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                parts = [ids[a:z] for a, z in zip(at.tolist(), at[1:].tolist(), strict=False)]
                back = [bpe.decode(x.tolist()) for x in parts]
                keys = b.column("doc_id").slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([keys, pa.array([x.tobytes() for x in parts], pa.binary()), pa.array(back, pa.binary())], ["doc_id", "ids", "decoded"])
        release(keep=True)

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """Count and digests of what ``encode`` returns."""
    return encoded.select(
        "doc_id",
        *more,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
