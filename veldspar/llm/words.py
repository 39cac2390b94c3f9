"""Word hashes of many texts at once, and hashes of their runs of words, in NumPy.

Texts come as one UTF-8 buffer with offsets (Arrow's layout); nothing is done by word in Python. A word is a
maximal run of bytes that aren't separators. Its hash is a polynomial over its bytes, mixed; a run's hash is
a polynomial over its words' hashes, mixed. Both depend on content alone, so tasks agree on them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_CHUNK = 1 << 20

#: Byte classes: 0 ends words; any other value is what the byte counts as.
EXACT = np.arange(256, dtype=np.uint64)
EXACT[[9, 10, 11, 12, 13, 32]] = 0
EXACT[0] = 256
#: Lower case ASCII letters, digits and bytes above 127; all else separates.
PLAIN = np.zeros(256, dtype=np.uint64)
for _b in range(256):
    if chr(_b).isalnum() or _b > 127:
        PLAIN[_b] = ord(chr(_b).lower()) if _b < 128 else _b


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2**64."""

    def __init__(self, base: int):
        self.base = base
        self.up = self.down = np.ones(1, dtype=U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                x = np.full(size, U(b))
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


_bytes_powers, _word_powers = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _hash_block(data: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block that no word crosses, and where each begins."""
    value = classes[data]
    inside = np.empty(len(data) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.not_equal(value, 0, out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    up, down = _bytes_powers.to(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(value * up[: len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(U)), begin


def word_hashes(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = EXACT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words in order, and the number of words before each text (one more than texts).

    Works in blocks cut between texts, or inside a long one between words, so memory follows the block and the
    words, whatever a text's length.
    """
    hashes, begins = [], []
    stops = offsets[1:]
    at, end_of_all = int(offsets[0]), int(offsets[-1])
    while at < end_of_all:
        cut = min(at + _CHUNK, end_of_all)
        if cut < end_of_all:
            k = int(np.searchsorted(stops, cut, "right"))
            text_end = int(stops[k - 1]) if k else at
            if text_end > at:
                cut = text_end
            else:  # one long text: cut before a separator, or go on to its end if it has none
                text_end = int(stops[k])
                while cut < text_end and classes[data[cut]] != 0:
                    sep = np.flatnonzero(classes[data[cut : min(cut + _CHUNK, text_end)]] == 0)
                    cut = cut + int(sep[0]) if len(sep) else min(cut + _CHUNK, text_end)
        # texts that touch in the buffer are kept apart by a separator between them
        inner = stops[(stops > at) & (stops < cut)] - at
        block = data[at:cut]
        if len(inner):
            block = np.insert(block, inner, 32)
            h, b = _hash_block(block, classes)
            b = b - np.searchsorted(inner + np.arange(1, len(inner) + 1), b, "right")
        else:
            h, b = _hash_block(block, classes)
        hashes.append(h)
        begins.append(b + at)
        at = cut
    if not hashes:
        return np.zeros(0, dtype=U), np.zeros(len(offsets), dtype=np.int64)
    begin = np.concatenate(begins)
    return np.concatenate(hashes), np.searchsorted(begin, offsets, "left").astype(np.int64)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null texts are empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8), offsets


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the run of ``length`` words at each position where one fits, texts taken as one."""
    n = len(words)
    if n < length:
        return np.zeros(0, dtype=U)
    out = np.empty(n - length + 1, dtype=U)
    step = 1 << 20
    for at in range(0, len(out), step):
        part = words[at : min(at + step + length - 1, n)]
        up, down = _word_powers.to(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=U)
        np.cumsum(part * up[: len(part)], out=total[1:])
        out[at : at + len(part) - length + 1] = mix((total[length:] - total[:-length]) * down[: len(part) - length + 1])
    return out


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) over each run of ``width`` values."""
    done, out = 1, values
    while done * 2 <= width:
        out = best(out[:-done], out[done:])
        done *= 2
    if done < width:
        shift = width - done
        out = best(out[: len(out) - shift], out[shift:])
    return out


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """Whether each value is least among some run of ``width`` of them (which must fit): winnowing."""
    n = len(hashes)
    if n < width:
        return np.zeros(n, dtype=bool)
    least = sliding(hashes, width, np.minimum)
    padded = np.concatenate([np.zeros(width - 1, dtype=U), least, np.zeros(width - 1, dtype=U)])
    return sliding(padded, width, np.maximum) == hashes
