"""64-bit hashes of the words of many texts at once, and of runs of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MIX = np.random.default_rng(20240229).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WHITE = b" \t\n\x0b\x0c\r"
#: Bytes hashed at once; bounds the memory for very long texts.
SLICE = 4 << 20


def _table(lower: bool) -> np.ndarray:
    table = _MIX.copy()
    if lower:
        table[65:91] = table[97:123]
    table[list(_WHITE)] = 0
    return table


_TABLES = {False: _table(False), True: _table(True)}
_POWERS = [np.ones(1, dtype=np.uint64)]


def powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        more = np.full(max(n, 4096), _STEP, dtype=np.uint64)
        more[0] = 1
        _POWERS[0] = np.multiply.accumulate(more)
    return _POWERS[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Every input bit into every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(data: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and where they start."""
    codes = np.frombuffer(data, dtype=np.uint8)
    values = _TABLES[lower][codes]
    word = values != 0
    starts = np.flatnonzero(word & ~np.concatenate(([False], word[:-1]))) if len(word) else np.zeros(0, dtype=np.int64)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    spread = np.diff(np.append(starts, len(codes)))
    within = np.arange(starts[0], len(codes)) - np.repeat(starts, spread)
    values = values[starts[0] :] * powers(int(spread.max()) + 1)[within]
    return mix(np.add.reduceat(values, starts - starts[0])), starts


def word_hashes(text: bytes, lower: bool = False) -> np.ndarray:
    """One hash for each word (a run of bytes other than ASCII white space); lower folds A-Z."""
    out, at = [], 0
    while len(text) - at > SLICE:
        stop = max(text.rfind(b, at, at + SLICE) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if stop <= at:  # one word longer than a slice
            after = [i for i in (text.find(b, at + SLICE) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if i >= 0]
            stop = min(after, default=len(text))
        out.append(_hash(text[at:stop], lower)[0])
        at = stop
    out.append(_hash(text[at:], lower)[0])
    return np.concatenate(out) if len(out) > 1 else out[0]


def batch_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and how many each text has."""
    out, counts, group, size = [], [], [], 0

    def flush() -> None:
        nonlocal group, size
        if group:
            joined = b"\n".join(group)
            hashes, starts = _hash(joined, lower)
            ends = np.cumsum([len(t) + 1 for t in group])
            out.append(hashes)
            counts.extend(np.diff(np.searchsorted(starts, ends), prepend=0).tolist())
            group, size = [], 0

    for text in texts:
        if len(text) > SLICE:
            flush()
            hashes = word_hashes(text, lower)
            out.append(hashes)
            counts.append(len(hashes))
        else:
            if size + len(text) > SLICE:
                flush()
            group.append(text)
            size += len(text) + 1
    flush()
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), np.array(counts, dtype=np.int64)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n consecutive words."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    total, length = hashes, 1  # total[i]: the first `length` words from i
    block, size = hashes, 1
    rest = n - 1
    p = powers(n + 1)
    while rest:
        if rest & 1:
            total = total[: len(total) - size] + p[length] * block[length : length + len(total) - size]
            length += size
        rest >>= 1
        if rest:
            block = block[: len(block) - size] + p[size] * block[size:]
            size *= 2
    return mix(total[: len(hashes) - n + 1])


def bounded(batches: Iterator, words: int, count) -> Iterator[list]:
    """Batches joined until they hold about so many words."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += count(batch)
        if total >= words:
            yield held
            held, total = [], 0
    if held:
        yield held
