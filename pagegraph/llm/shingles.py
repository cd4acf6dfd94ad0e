"""Five-word shingles of whole texts as 64-bit hashes, and their MinHash signatures."""

from __future__ import annotations

import numpy as np

WIDTH = 5
#: An odd multiplier that orders the words of a window.
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are hashed at once; a longer text is taken alone, whole.
BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random number for each byte, the same for A-Z and a-z.
_BYTES = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]
_POWERS: dict[str, np.ndarray] = {}


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < size:
        for name, base in (("up", 0x9E3779B97F4A7C15), ("down", pow(0x9E3779B97F4A7C15, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def _windows(texts: list[bytes], width: int) -> list[np.ndarray]:
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    up, down = _powers(len(raw) + 1)
    edge = np.diff(np.concatenate(([True], _SPACE[raw])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * up[: len(raw)])))
    words = mixed((total[ends] - total[starts]) * down[starts])
    stops = np.cumsum([len(t) + 1 for t in texts])
    first = np.searchsorted(starts, np.concatenate(([0], stops)))
    rolled = words.copy()
    for k in range(1, width):
        last = max(0, len(words) - k)
        rolled[:last] = rolled[:last] * STEP + words[k:]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            found = np.sort(rolled[a : b - width + 1])
            out.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        elif b > a:
            h = words[a : a + 1]
            for k in range(a + 1, b):
                h = h * STEP + words[k : k + 1]
            out.append(mixed(h + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word windows.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; a text with fewer words than a window has
    its whole sequence as one; null or wordless texts have none.
    """
    out: list[np.ndarray] = []
    block: list[bytes] = []
    size = 0
    for t in texts:
        t = b"" if t is None else t.encode()
        if block and size + len(t) > BLOCK:
            out += _windows(block, width)
            block, size = [], 0
        block.append(t)
        size += len(t) + 1
    return out + (_windows(block, width) if block else [])


def permutations(size: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, size, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads low bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """MinHash of each non-empty set: len(sets) rows of `size` 32-bit values."""
    a, b = permutations(size)
    flat = mixed(np.concatenate(sets))
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), size), np.uint32)
    for k in range(size):
        h = ((flat * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32)
        out[:, k] = np.minimum.reduceat(h, starts)
    return out
