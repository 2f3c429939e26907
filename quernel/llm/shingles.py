"""Sets of hashed word shingles, many texts at a time."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PLACE = mixed(np.arange(1, 33, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x5851F42D4C957F2D)


#: Bytes of a part whose words are hashed at once, about; a part ends at white space.
_PART = 500_000


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some bytes that end in white space, and where they begin."""
    space = _SPACE[data]
    inside = ~space
    starts = np.flatnonzero(inside & np.concatenate([[True], space[:-1]]))
    if not len(starts):
        return np.empty(0, np.uint64), starts
    lengths = np.flatnonzero(space & np.concatenate([[False], inside[:-1]])) - starts
    letters = _LETTER[data[inside]]
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(letters)) - np.repeat(begin, lengths)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()), _BASE)]))
    return mixed(np.add.reduceat(letters * power[place], begin) + lengths.astype(np.uint64)), starts


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, A-Z in lower case, and where each text's words begin (one more entry at the end).
    Long texts are hashed in parts, so memory beside the texts is some 8 bytes a word."""
    raw = [(t or "").encode("utf-8").lower() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends_of_texts = np.cumsum([len(r) + 1 for r in raw])
    hashes, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(data):
        end = min(len(data), at + _PART)
        while end < len(data) and not _SPACE[data[end - 1]]:
            more = np.flatnonzero(_SPACE[data[end : end + _PART]])
            end = end + int(more[0]) + 1 if len(more) else min(len(data), end + _PART)
        h, s = _hashed(data[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), np.concatenate([[0], ends_of_texts]))


def shingle_sets(texts: list[str | None], n: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (int64) of each text: n words each, or all words where there are fewer."""
    words, first = word_hashes(texts)
    whole = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n if len(whole) else 0):
        whole += words[j : j + len(whole)] * _PLACE[j]
    whole = mixed(whole).view(np.int64)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(whole[a : b - n + 1]))
        elif b > a:
            short = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mixed(np.array([short ^ _BASE], np.uint64)).view(np.int64))
        else:
            out.append(np.empty(0, np.int64))
    return out


def slices(texts: list[str | None] | list[int], most: int = 1_000_000) -> list[tuple[int, int]]:
    """Ranges of texts (or of their lengths) of about `most` letters together, at least one text each."""
    out, at, size = [], 0, 0
    for i, t in enumerate(texts):
        size += (t if isinstance(t, int) else len(t or "")) + 1
        if size >= most:
            out.append((at, i + 1))
            at, size = i + 1, 0
    return [*out, (at, len(texts))] if at < len(texts) else out
