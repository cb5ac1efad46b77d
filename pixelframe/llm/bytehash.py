"""Rolling hashes of many byte strings at once, as array arithmetic on 64-bit words."""

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words under which all bits depend on all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done:done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


class Powers:
    """Powers of the base and of its inverse, for texts of up to n bytes; more are found where needed."""

    def __init__(self, n: int):
        self.n, self.base, self.inverse = n, powers(BASE, n + 1), powers(INVERSE, n + 1)

    def upto(self, n: int) -> "Powers":
        return self if n <= self.n else Powers(n)


class Rolling:
    """Hashes of substrings of `data` (uint8) in constant time each."""

    def __init__(self, data: np.ndarray, known: Powers | None = None):
        n = len(data)
        known = known.upto(n) if known else Powers(n)
        letters = mix(np.arange(1, 257, dtype=np.uint64))
        self.inverse = known.inverse
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(letters[data] * known.base[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of data[start[i]:end[i]]. The length enters through the caller's choice only."""
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self, k: int) -> np.ndarray:
        """Of every run of k bytes."""
        return mix((self.sums[k:] - self.sums[:-k]) * self.inverse[:len(self.sums) - k])


def joined(column, gap: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """A binary Arrow column as one byte array, and the offsets of its rows in it (nulls are empty)."""
    parts = [x or b"" for x in column.to_pylist()]
    ends = np.cumsum([len(p) + len(gap) for p in parts], dtype=np.int64) if parts else np.zeros(0, np.int64)
    data = np.frombuffer(gap.join(parts) + gap, np.uint8) if parts else np.zeros(0, np.uint8)
    return data, np.concatenate([[0], ends]).astype(np.int64)
