"""Ribbon filters: sets of 64-bit keys as solutions of banded systems of linear equations over bits.

A key gives an equation: a 64-wide band of coefficients from a start position, and a fingerprint that the solution must
give there. The keys are spread over blocks of about KEYS_A_BLOCK keys, each its own small system; the systems of all
blocks are solved side by side with NumPy. A key whose equation contradicts the others is kept apart, exactly
(`bumped`). A present key is always found; an absent one is taken for present with a chance of 2 ** -bits.
"""

from __future__ import annotations

import numpy as np

KEYS_A_BLOCK, COLUMNS, FIRST = 512, 640, 6
_U = np.uint64


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ _U(salt)) * _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


class Ribbon:
    """A sealed set. `keys` must be distinct."""

    def __init__(self, keys: np.ndarray, bits: int) -> None:
        self.bits, self.size = bits, len(keys)
        self.blocks = max(1, -(-len(keys) // KEYS_A_BLOCK))
        block, start, band, print_ = self._equation(keys)
        order = np.lexsort((start, block))
        self._solve(keys[order], block[order], start[order], band[order], print_[order])

    def _equation(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x = _mix(keys, 0x5BD1E995)
        block = (((x >> _U(32)) * _U(self.blocks)) >> _U(32)).astype(np.int64)
        start = (((x & _U(0xFFFFFFFF)) * _U(COLUMNS - 63)) >> _U(32)).astype(np.int64)
        return block, start, _mix(keys, 0x2545F491) | _U(1), _mix(keys, 0x7F4A7C15) >> _U(64 - self.bits)

    def _solve(self, keys: np.ndarray, block: np.ndarray, start: np.ndarray, band: np.ndarray, print_: np.ndarray) -> None:
        """Elimination, each block at its own pace, then back substitution of all blocks column by column."""
        row, right = np.zeros(self.blocks * COLUMNS, _U), np.zeros(self.blocks * COLUMNS, _U)
        at = np.searchsorted(block, np.arange(self.blocks))
        end = np.append(at[1:], len(keys))
        live = np.nonzero(at < end)[0]
        k, ends, base = at[live], end[live], live * COLUMNS
        place, c, f = base + start[k], band[k], print_[k]
        bumped = []
        while len(k):
            there = row[place]
            free = there == 0
            row[place[free]], right[place[free]] = c[free], f[free]
            c = np.where(free, _U(0), c ^ there)
            lost = ~free & (c == 0)
            f ^= np.where(free, _U(0), right[place])
            if lost.any():
                bumped.append(k[lost & (f != 0)])
            ended = c == 0
            move = np.bitwise_count((c & (~c + _U(1))) - _U(1))
            move[ended] = 0
            c >>= move.astype(_U)
            place += move
            i = np.nonzero(ended)[0]
            if len(i):
                k[i] += 1
                on = k < ends
                j = i[on[i]]
                place[j], c[j], f[j] = base[j] + start[k[j]], band[k[j]], print_[k[j]]
                if len(j) < len(i):
                    k, ends, base, place, c, f = k[on], ends[on], base[on], place[on], c[on], f[on]
        self.bumped = np.sort(keys[np.concatenate(bumped)]) if bumped else keys[:0]
        row, right = row.reshape(self.blocks, COLUMNS), right.reshape(self.blocks, COLUMNS)
        shifts = np.arange(self.bits, dtype=_U)
        state = np.zeros((self.blocks, self.bits), _U)
        self.words = np.zeros((self.bits, self.blocks, COLUMNS // 64 + 1), _U)
        for i in range(COLUMNS - 1, -1, -1):
            state <<= _U(1)
            state |= ((right[:, i, None] >> shifts) ^ np.bitwise_count(state & row[:, i, None])) & _U(1)
            if i % 64 == 0:
                self.words[:, :, i // 64] = state.T

    def has(self, keys: np.ndarray) -> np.ndarray:
        """For each key, whether it is (or, rarely, seems) in the set. FIRST bits one by one, as most absent keys fail there, the rest at once."""
        out = np.zeros(len(keys), bool)
        if not self.size or not len(keys):
            return out
        block, start, band, print_ = self._equation(keys)
        left = np.arange(len(keys))
        at = block * (COLUMNS // 64 + 1) + (start >> 6)
        low = (start & 63).astype(_U)
        words = self.words.reshape(self.bits, -1)
        for j in range(min(FIRST, self.bits)):
            w = words[j]
            window = (w[at] >> low) | ((w[at + 1] << _U(1)) << (_U(63) - low))
            same = (np.bitwise_count(window & band) & 1) == ((print_ >> _U(j)) & _U(1))
            left, at, low, band, print_ = left[same], at[same], low[same], band[same], print_[same]
        if len(left) and self.bits > FIRST:
            window = (words[FIRST:, at] >> low) | ((words[FIRST:, at + 1] << _U(1)) << (_U(63) - low))
            bit = (print_ >> np.arange(FIRST, self.bits, dtype=_U)[:, None]) & _U(1)
            left = left[((np.bitwise_count(window & band) & 1) == bit).all(0)]
        out[left] = True
        if len(self.bumped):
            i = np.searchsorted(self.bumped, keys)
            out |= self.bumped[np.minimum(i, len(self.bumped) - 1)] == keys
        return out

    def bytes(self) -> int:
        return self.words.nbytes + self.bumped.nbytes
