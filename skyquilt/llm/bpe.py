"""Exact, cached encoding with a public tokenizer file.

A run of texts is cut into pieces at places across which no pre-token reaches: before a space
after a non-space, around a lone newline, and between a letter and a full stop or comma. So the ids
of the pieces, in order, are the ids of the whole text. Pieces are found and looked up by 64-bit
hash with numpy, and every piece is compared byte by byte with the one that is kept under its hash;
the library encodes each piece that a worker has not met yet, many in one call.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from skyquilt.llm.common import BYTE_VALUES, prefix_sums, span_hashes

#: Bytes of pieces that a worker keeps.
RAW_BYTES = 64 << 20
#: A private-use character that no ordinary piece holds.
MARK = ""

SOLID = np.zeros(256, bool)  # ASCII that is no whitespace by any notion
SOLID[0x21:0x7F] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
TWO = np.zeros(256, bool)  # first bytes of two-byte characters from U+00C0 on: no whitespace
TWO[0xC3:0xE0] = True
THREE = np.zeros(256, bool)  # first bytes of three-byte characters without whitespace
THREE[[0xE0, *range(0xE4, 0xEF)]] = True


def cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pieces start, the text starts among them; strictly increasing."""
    n = len(data)
    padded = np.concatenate([np.full(3, 32, np.uint8), data, np.full(1, 32, np.uint8)])
    # solid[i]: byte i - 1 ends a character that is no whitespace
    one, two, three = padded[2 : n + 2], padded[1 : n + 1], padded[:n]
    high = one >= 0x80
    solid = SOLID[one] | (high & (TWO[two] | THREE[three]))
    letter = LETTER[one] | (high & (two == 0xC3) & (one != 0x97) & (one != 0xB7))
    here, following = padded[3 : n + 3], padded[4 : n + 4]
    line = (here == 10) & solid & (SOLID[following] | TWO[following])
    cut = ((here == 32) & solid) | line | (((here == 46) | (here == 44)) & letter)
    cut[1:] |= line[:-1]
    starts = off[:-1]
    cut[starts[starts < n]] = True
    return np.flatnonzero(cut)


class Table:
    """Open-addressing map from 64-bit hashes to piece numbers."""

    def __init__(self, bits: int = 16) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        left, at = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(left):
            there = self.keys[at]
            same = there == keys[left]
            out[left[same]] = self.values[at[same]]
            go = ~same & (there != 0)
            left, at = left[go], (at[go] + 1) & int(self.mask)
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct new keys."""
        left, at = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.keys[at] == 0)
            self.keys[at[free]] = keys[left[free]]
            won = np.zeros(len(left), bool)
            won[free] = self.keys[at[free]] == keys[left[free]]
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & int(self.mask)


class Encoder:
    """``spaces``: whether the tokenizer keeps white space; ``end_id`` closes each text."""

    def __init__(self, file: str, spaces: bool, end_id: int, limit: int = 1_500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; a pool would only cost memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        self.spaces, self.end_id, self.limit = spaces, end_id, limit
        self.separator = "\n" if spaces else f" {MARK} "
        self.mark = np.asarray(self.plain(self.separator), np.uint32)
        self.clear()

    def clear(self) -> None:
        self.table, self.n = Table(), 1
        self.first, self.size = np.zeros(1 << 15, np.int32), np.zeros(1 << 15, np.int32)
        self.pool, self.used = np.zeros(1 << 17, np.uint32), 1
        self.pool[0], self.size[0] = self.end_id, 1  # piece 0 is the end of a text
        self.at, self.length = np.zeros(1 << 15, np.int32), np.zeros(1 << 15, np.int32)
        self.raw, self.kept = np.zeros(1 << 18, np.uint8), 0
        self.others: dict[bytes, int] = {}  # pieces whose hash another piece has

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def joinable(self, piece: str) -> bool:
        """Whether the piece can be told apart from its neighbours after a joint call."""
        if not self.spaces:
            return MARK not in piece
        return "\n" not in piece and not piece[-1:].isspace() and not piece[piece[:1] == " " :][:1].isspace()

    def learn(self, raw: list[bytes]) -> np.ndarray:
        """Numbers of new pieces."""
        pieces = [x.decode() for x in raw]
        mark, n = self.mark, len(self.mark)
        ids: list[np.ndarray | None] = [None] * len(pieces)
        joint = [k for k, p in enumerate(pieces) if self.joinable(p)]
        for i in range(0, len(joint), 2_000):
            part = joint[i : i + 2_000]
            flat = np.asarray(self.plain(self.separator.join([pieces[k] for k in part])), np.uint32)
            found = np.ones(max(len(flat) - n + 1, 0), bool)
            for k, m in enumerate(mark):
                found &= flat[k : k + len(found)] == m
            ends = np.flatnonzero(found)
            if len(ends) == len(part) - 1:  # else a separator came out otherwise than alone
                for k, a, b in zip(part, [0, *(ends + n).tolist()], [*ends.tolist(), len(flat)], strict=True):
                    ids[k] = flat[a:b]
        ids = [np.asarray(self.plain(p), np.uint32) if x is None else x for x, p in zip(ids, pieces, strict=True)]
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(size.sum())
        while self.n + len(ids) > len(self.size):
            self.first, self.size, self.at, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size, self.at, self.length))
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        numbers = np.arange(self.n, self.n + len(ids))
        self.size[numbers], self.first[numbers] = size, self.used + np.cumsum(size) - size
        self.pool[self.used : self.used + total] = np.concatenate(ids)
        length = np.fromiter(map(len, raw), np.int32, len(raw))
        while self.kept + int(length.sum()) > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros_like(self.raw)])
        self.length[numbers], self.at[numbers] = length, self.kept + np.cumsum(length) - length
        self.raw[self.kept : self.kept + int(length.sum())] = np.frombuffer(b"".join(raw), np.uint8)
        self.n, self.used, self.kept = self.n + len(ids), self.used + total, self.kept + int(length.sum())
        return numbers.astype(np.int32)

    def learn_keys(self, keys: np.ndarray, raw: list[bytes]) -> None:
        numbers = self.learn(raw)
        if 2 * self.n > len(self.table.keys):
            old, self.table = self.table, Table(max(16, int(4 * self.n).bit_length()))
            full = old.keys != 0
            self.table.put(old.keys[full], old.values[full])
        self.table.put(keys, numbers)

    def corrected(self, found: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Piece numbers with those put right whose bytes differ from the kept ones."""
        size = end - start
        differs = self.length[found] != size
        at = np.repeat(self.at[found] - start, size) + np.arange(len(data))
        differs |= np.logical_or.reduceat(self.raw[np.minimum(at, len(self.raw) - 1)] != data, start)
        for k in np.flatnonzero(differs).tolist():
            raw = data[start[k] : end[k]].tobytes()
            if raw not in self.others:
                self.others[raw] = int(self.learn([raw])[0])
            found[k] = self.others[raw]
        return found

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each with its end id; number of ids of each text)."""
        if self.n > self.limit or self.kept > RAW_BYTES:
            self.clear()
        start = cuts(data, off) if len(data) else np.zeros(0, np.int64)
        end = np.append(start[1:], len(data)) if len(start) else start
        keys = span_hashes(prefix_sums(BYTE_VALUES[data]), start, end)
        keys[keys == 0] = 1
        found = self.table.get(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, at = np.unique(keys[missing], return_index=True)
            a, b, raw = start[missing[at]].tolist(), end[missing[at]].tolist(), data.tobytes()
            self.learn_keys(new, [raw[i:j] for i, j in zip(a, b, strict=True)])
            found[missing] = self.table.get(keys[missing])
        if len(start):
            found = self.corrected(found, data, start, end)
        # after a text's last piece comes its end
        last = np.searchsorted(start, off[1:])
        pieces = np.insert(found, last, 0)
        size = self.size[pieces]
        stop = np.cumsum(size, dtype=np.int64)
        at = np.repeat(self.first[pieces] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)
        text_end = stop[last + np.arange(len(last))]
        return self.pool[at], np.diff(text_end, prepend=0)


@lru_cache(maxsize=2)
def encoder(file: str, spaces: bool, end_id: int) -> Encoder:
    """One encoder for each Python worker, so that its tasks share what it has learned."""
    return Encoder(file, spaces, end_id)
