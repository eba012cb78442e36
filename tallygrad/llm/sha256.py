"""SHA-256 of many messages at once, with states that can be kept and resumed.

``hashlib`` has no way to store a half-finished state; here it is a row of eight
32-bit words, so that a table can hold it. A hex digest is 64 bytes, one block
exactly: the state before a child of a tree node is what is left after the
blocks of the children before it.
"""

from __future__ import annotations

import numpy as np


def _first_bits(power: int, n: int) -> list[int]:
    """First 32 bits behind the point of the square (2) or cube (3) roots of the first n primes."""
    primes = [p for p in range(2, 400) if all(p % q for q in range(2, p))][:n]
    found = []
    for p in primes:
        shifted, low, high = p << (32 * power), 0, 1 << 40
        while low < high:  # the largest integer whose power is no larger
            middle = (low + high + 1) // 2
            low, high = (middle, high) if middle**power <= shifted else (low, middle - 1)
        found.append(low & 0xFFFFFFFF)
    return found


_ROUNDS = [np.uint32(x) for x in _first_bits(3, 64)]
START = np.array(_first_bits(2, 8), np.uint32)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """(n, 8) states after one more block each, given as (n, 16) big-endian words."""
    w = list(np.ascontiguousarray(block.T))
    a, b, c, d, e, f, g, h = start = list(np.ascontiguousarray(state.T))
    with np.errstate(over="ignore"):
        for i in range(64):
            if i >= 16:
                x, y = w[i - 15], w[i - 2]
                s0 = _turned(x, 7) ^ _turned(x, 18) ^ (x >> np.uint32(3))
                s1 = _turned(y, 17) ^ _turned(y, 19) ^ (y >> np.uint32(10))
                w.append(w[i - 16] + s0 + w[i - 7] + s1)
            t1 = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + ((e & f) ^ (~e & g)) + _ROUNDS[i] + w[i]
            t2 = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
            a, b, c, d, e, f, g, h = t1 + t2, a, b, c, d + t1, e, f, g
        return np.stack([x + y for x, y in zip(start, (a, b, c, d, e, f, g, h))], axis=1)


def hex_block(digest: np.ndarray) -> np.ndarray:
    """(n, 16) words of the hex text of (n, 32) digest bytes."""
    text = np.empty((len(digest), 64), np.uint8)
    text[:, 0::2] = _HEX[digest >> 4]
    text[:, 1::2] = _HEX[digest & 15]
    return text.view(">u4").astype(np.uint32)


def finished(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """(n, 32) digest bytes of messages that consisted of so many whole blocks."""
    last = np.zeros((len(state), 16), np.uint32)
    last[:, 0] = 0x80000000
    last[:, 15] = np.asarray(blocks).astype(np.uint32) * 512
    return compress(state, last).astype(">u4").view(np.uint8).reshape(-1, 32)


def started(n: int) -> np.ndarray:
    """(n, 8) states before the first block."""
    return np.tile(START, (n, 1))
