"""MD5 of many short messages at once, as numpy arrays: the draws of a bootstrap need one a group and draw."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Messages of one pass: fewer would spend their time on calls, more would leave the cache.
_PASS = 65_536
#: The longest message that one block of MD5 holds.
_LONGEST = 55


def digits(numbers: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, decimal digits as bytes, a row a number) of the non-negative numbers of each length."""
    width = np.ones(len(numbers), dtype=int)
    for w in range(1, 19):
        width += numbers >= 10**w
    out = []
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        out.append((at, (numbers[at][:, None] // 10 ** np.arange(w - 1, -1, -1) % 10 + 48).astype(np.uint8)))
    return out


def _first_words(rows: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of each row's bytes, rows at most _LONGEST long."""
    n, length = rows.shape
    block = np.zeros((n, 64), dtype=np.uint8)
    block[:, :length] = rows
    block[:, length] = 0x80
    block[:, 56:58] = (8 * length & 255, 8 * length >> 8)
    used = length // 4 + 1  # words after these are 0, but for the length
    words = [np.ascontiguousarray(block[:, 4 * k : 4 * k + 4]).view("<u4")[:, 0] for k in range(used)]
    a, b, c, d = (np.full(n, x, dtype=np.uint32) for x in _START)
    f, g = np.empty(n, dtype=np.uint32), np.empty(n, dtype=np.uint32)
    for k in range(64):
        turn = k // 16
        if turn < 2:
            x, y, z = (b, c, d) if turn == 0 else (d, b, c)
            np.bitwise_xor(y, z, out=f)
            np.bitwise_and(f, x, out=f)
            np.bitwise_xor(f, z, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        word = (k, 5 * k + 1, 3 * k + 5, 7 * k)[turn] % 16
        constant = _SINES[k] + (8 * length if word == 14 else 0)
        np.add(f, a, out=f)
        np.add(f, np.uint32(constant & 0xFFFFFFFF), out=f)
        if word < used:
            np.add(f, words[word], out=f)
        left = _TURNS[turn][k % 4]
        np.right_shift(f, np.uint32(32 - left), out=g)
        np.left_shift(f, np.uint32(left), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return (a + np.uint32(_START[0])).byteswap()


def hash32_rows(rows: np.ndarray) -> np.ndarray:
    """scalars.hash32 of each row's bytes, as int64."""
    if rows.shape[1] > _LONGEST:
        return np.array([int.from_bytes(hashlib.md5(r.tobytes()).digest()[:4], "big") for r in rows], dtype=np.int64)
    return np.concatenate([_first_words(rows[k : k + _PASS]) for k in range(0, len(rows), _PASS)] or [np.empty(0)]).astype(np.int64)


#: Messages of one pass of Tails: its arrays stay in a core's own cache.
_TAILS = 16_384


class Tails:
    """Ends of messages, a row each and all as long: the MD5 of any beginning and each of them, without a message being built.

    Words that hold nothing of an end are numbers; steps before the first end's word are taken once for all, and those after the digest's first word is known are left out."""

    def __init__(self, rows: np.ndarray):
        self.rows, self._words, (self._n, self._width) = rows, {}, rows.shape
        self._room = np.empty((5, min(self._n, _TAILS)), dtype=np.uint32)

    def _ends(self, offset: int) -> list[np.ndarray]:
        """The words of the ends and their closing bit, of which the first begins so many bytes before them."""
        if offset not in self._words:
            block = np.zeros((self._n, 4 * ((offset + self._width) // 4 + 1)), dtype=np.uint8)
            block[:, offset : offset + self._width], block[:, offset + self._width] = self.rows, 0x80
            self._words[offset] = [np.ascontiguousarray(block[:, k : k + 4]).view("<u4")[:, 0] for k in range(0, block.shape[1], 4)]
        return self._words[offset]

    def hash32(self, head: bytes) -> np.ndarray:
        """scalars.hash32 of head and each end, as uint32."""
        length = len(head) + self._width
        if length > _LONGEST:
            return np.array([int.from_bytes(hashlib.md5(head + r.tobytes()).digest()[:4], "big") for r in self.rows], dtype=np.uint32)
        fixed = [int.from_bytes((head + bytes(64 - len(head)))[4 * k : 4 * k + 4], "little") for k in range(16)]
        fixed[14] = 8 * length
        first, ends = len(head) // 4, self._ends(len(head) % 4)
        out = np.empty(self._n, dtype=np.uint32)
        for k in range(0, self._n, _TAILS):
            some = [w[k : k + _TAILS] for w in ends]
            self._pass(fixed, {first + j: w for j, w in enumerate(some)}, first, out[k : k + _TAILS])
        return out

    def _pass(self, fixed: list[int], ends: dict[int, np.ndarray], first: int, out: np.ndarray) -> None:
        full = 0xFFFFFFFF
        a, b, c, d = _START
        for k in range(first):  # a head of whole words is shorter than one turn
            f = ((c ^ d) & b ^ d) + a + _SINES[k] + fixed[k] & full
            left = _TURNS[0][k % 4]
            a, b, c, d = d, (f << left | f >> 32 - left) + b & full, b, c
        room = self._room[:, : len(out)]
        for row, x in zip(room, (a, b, c, d), strict=False):
            row.fill(x)
        a, b, c, d, f = room
        xor, both, add = np.bitwise_xor, np.bitwise_and, np.add
        for k in range(first, 61):  # step 60 gives the first word, which steps 61 to 63 move only
            turn = k // 16
            if turn == 0:
                xor(c, d, f)
                both(f, b, f)
                xor(f, d, f)
            elif turn == 1:
                xor(b, c, f)
                both(f, d, f)
                xor(f, c, f)
            elif turn == 2:
                xor(b, c, f)
                xor(f, d, f)
            else:
                np.invert(d, f)
                np.bitwise_or(f, b, f)
                xor(f, c, f)
            word = (k, 5 * k + 1, 3 * k + 5, 7 * k)[turn] % 16
            add(a, f, a)
            add(a, np.uint32(_SINES[k] + fixed[word] & full), a)
            if word in ends:
                add(a, ends[word], a)
            left = _TURNS[turn][k % 4]
            np.right_shift(a, np.uint32(32 - left), f)
            np.left_shift(a, np.uint32(left), a)
            np.bitwise_or(a, f, a)
            add(a, b, a)
            a, b, c, d = d, a, b, c
        np.add(b, np.uint32(_START[0]), out)
        out.byteswap(inplace=True)
