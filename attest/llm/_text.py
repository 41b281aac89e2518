"""Words of whole texts as numbers, many texts at once.

A word is a run of characters other than the six white ones of ASCII. Its number folds its characters
one after another, three at a time: each fold mixes the number so far with the next ones, so places and
orders count in a way that no pattern of letters undoes (a sum of powers modulo 2**64 is the same for
some pairs of long patterns). Equal words get equal numbers anywhere.
"""

import functools
import hashlib

import numpy as np

_WHITE = (9, 10, 11, 12, 13, 32)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads uint64 numbers over all bits (the finalizer of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@functools.lru_cache(1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a white one after each, and where each text starts, with the end."""
    flat = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.zeros(len(texts) + 1, "int64")
    np.cumsum([len(x) + 1 for x in texts], out=starts[1:])
    return flat, starts


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all words, where each text's words start (with the end), and each word's start and end in the joined codes."""
    flat, starts = codes(texts)
    black = np.ones(len(flat) + 2, bool)
    black[0] = black[-1] = False
    inner = black[1:-1]
    for c in _WHITE:
        inner &= flat != c
    edge = np.flatnonzero(black[1:] != black[:-1])
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, "uint64"), np.zeros(len(texts) + 1, "int64"), begin, end
    return numbers(flat, begin, end), np.searchsorted(begin, starts), begin, end


#: Characters of a run that are folded by numpy; the few longer ones take a library hash.
_FOLDED = 96


def numbers(flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each run flat[begin:end] of code points."""
    size = end - begin
    folds = np.where(size > _FOLDED, 0, (size + 2) // 3).astype("uint16")
    order = np.argsort(folds, kind="stable")[::-1]
    folds, at, left = folds[order], begin[order], size[order]
    wide = np.concatenate([flat, np.zeros(3, flat.dtype)]).astype("uint64")
    three = wide[:-2] | (wide[1:-1] << _U(21)) | (wide[2:] << _U(42))
    value = mixed(left.astype("uint64") * _BASE)
    keep = np.array([0, (1 << 21) - 1, (1 << 42) - 1, (1 << 63) - 1], "uint64")
    active = len(folds) - np.searchsorted(folds[::-1], np.arange(1, int(folds[0]) + 1 if len(folds) else 1))
    for k, n in enumerate(active.tolist()):
        value[:n] = mixed(value[:n] ^ (three[at[:n] + 3 * k] & keep[np.minimum(left[:n] - 3 * k, 3)]))
    out = np.empty(len(size), "uint64")
    out[order] = value
    for k in np.flatnonzero(size > _FOLDED).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(flat[begin[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingles(texts: list[str], n: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text: its distinct runs of n words, as sorted numbers, and how often each occurs.

    A text of fewer words has one run of all its words; a text without words has none.
    """
    number, first, _, _ = words(texts)
    total = len(number)
    padded = np.concatenate([number, np.zeros(n, "uint64")])
    run = np.zeros(total, "uint64")
    for k in range(n):
        run = run * _BASE + padded[k : k + total]
    run = mixed(run)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(run[a : b - n + 1], return_counts=True))
        elif b > a:
            with np.errstate(over="ignore"):
                h = _U(b - a)
                for x in number[a:b]:
                    h = h * _BASE + x
            out.append((mixed(np.array([h], "uint64")), np.ones(1, "int64")))
        else:
            out.append((np.zeros(0, "uint64"), np.zeros(0, "int64")))
    return out
