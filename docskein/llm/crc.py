"""CRC-32 of any substring of a buffer from running CRCs, as arrays.

The running CRC of a buffer is computed once, many stretches side by side. For a substring between two places the CRC of
the part before it is shifted by the substring's length (multiplied by x^8n over GF(2)) and cancelled from the later one.
"""

from __future__ import annotations

from functools import cache

import numpy as np

# fixed value: reversed polynomial of CRC-32 (ISO 3309)
POLYNOMIAL = 0xEDB88320
_U = np.uint32


@cache
def byte_table() -> np.ndarray:
    c = np.arange(256, dtype=_U)
    for _ in range(8):
        c = np.where(c & _U(1), (c >> _U(1)) ^ _U(POLYNOMIAL), c >> _U(1))
    return c


@cache
def shifter(power: int) -> np.ndarray:
    """Four tables of 256 that together append 2**power zero bytes to a CRC."""
    if power == 0:
        c = np.arange(256, dtype=_U)[None, :] << (_U(8) * np.arange(4, dtype=_U)[:, None])
        return byte_table()[c & _U(255)] ^ (c >> _U(8))
    half = shifter(power - 1)
    return _apply(half, half)


def _apply(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return t[0][c & _U(255)] ^ t[1][(c >> _U(8)) & _U(255)] ^ t[2][(c >> _U(16)) & _U(255)] ^ t[3][c >> _U(24)]


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``crc`` times x^(8 n): what it contributes to the CRC of a text that goes on for ``n`` bytes."""
    out, n = crc.copy(), np.asarray(n)
    power, most = 0, int(n.max(initial=0))
    while most >> power:
        at = np.flatnonzero((n >> power) & 1)
        out[at] = _apply(shifter(power), out[at])
        power += 1
    return out


class Running:
    """Running CRCs of ``buf``; ``at(places)`` gives the CRC of everything before each place."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.length = length = max(int(np.sqrt(n)) // 2, 64)
        lanes = max(-(-n // length), 1)
        padded = np.zeros(lanes * length, dtype=np.uint8)
        padded[:n] = buf
        columns = np.ascontiguousarray(padded.reshape(lanes, length).T)
        table, register = byte_table(), np.full(lanes, 0xFFFFFFFF, dtype=_U)
        self.local = np.zeros((length + 1, lanes), dtype=_U)  # [k]: CRC of the first k bytes of each lane
        for k in range(length):
            register = table[(register ^ columns[k]) & _U(255)] ^ (register >> _U(8))
            np.invert(register, out=self.local[k + 1])
        # lanes one after another: the CRC before a lane is that of the lanes before it, shifted over its own length
        hop = [shifted(np.arange(256, dtype=_U) << _U(8 * b), np.full(256, length)).tolist() for b in range(4)]
        before, c = [], 0
        for last in self.local[length].tolist():
            before.append(c)
            c = hop[0][c & 255] ^ hop[1][c >> 8 & 255] ^ hop[2][c >> 16 & 255] ^ hop[3][c >> 24] ^ last
        self.before = np.array(before, dtype=_U)

    def at(self, places: np.ndarray) -> np.ndarray:
        lane = np.minimum(places // self.length, len(self.before) - 1)
        k = places - lane * self.length
        return shifted(self.before[lane], k) ^ self.local[k, lane]


def substring(before_start: np.ndarray, before_end: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC of the ``length`` bytes between two places with the given running CRCs."""
    return before_end ^ shifted(before_start, length)
