"""BPE encoding and decoding by speculation and verification.

A word is first cut greedily into the longest vocabulary entries. Such a cut is what the merges would give exactly when
each piece is reached by merging its own symbols and each adjacent pair of pieces is compatible, that is, when merging
the two pieces' symbols together gives the two pieces back. All adjacent pairs of a batch's new words are tested at
once: their codes are made unique, looked up in a sorted table of known verdicts, and only unknown pairs are merged.
Words with an incompatible pair (or an unreachable piece) alone go through exact merging.

Texts are cut at ASCII white space, which no word reaches across, and a batch's distinct chunks are encoded once; what a text
holds is then taken from them by their numbers, as one range of bytes. Chunks, words and their codes lie in Arrow arrays, so
what a worker remembers takes some tens of bytes each.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import map_rows, tokenizer_file
from .shingles import slices

_FAR = 1 << 60
#: The step of the trie that ends a word, after the 256 bytes.
_END = 256
#: Letters of a part of a batch that is encoded at once, about; those of words that are handled many in step, at most; and of a
#: table of such words, about.
PART, SHORT, TABLE = 3_000_000, 64, 200_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, extra = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


@lru_cache(maxsize=1)
def later_letters() -> str:
    """Ranges of letters and numbers in regex's tables that have no category in Python's, as in a set of a pattern."""
    known = regex.compile(r"[\p{L}\p{N}]+")
    found = [c for run in known.findall("".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))) for c in map(ord, run) if unicodedata.category(chr(c)) == "Cn"]
    out, start = [], None
    for a, b in zip(found, [*found[1:], -1], strict=True):
        start = a if start is None else start
        if b != a + 1:
            out.append(f"\\U{start:08x}-\\U{a:08x}")
            start = None
    return "".join(out)


def binary(offsets: np.ndarray, data: pa.Buffer | bytes) -> pa.Array:
    """Byte strings between neighbouring offsets of the data."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), data if isinstance(data, pa.Buffer) else pa.py_buffer(data)])


def ranges(taken: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """Offsets and data of an array of byte strings that starts at its buffers' start."""
    buffers = taken.buffers()
    return (np.frombuffer(buffers[1], np.int64, len(taken) + 1) if buffers[1] is not None and buffers[1].size else np.zeros(1, np.int64)), buffers[2] if buffers[2] is not None else pa.py_buffer(b"")


class PairTable:
    """Places of distinct codes, found by open addressing, many at once."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(4, int(len(codes) * 4).bit_length())
        self.codes, self.places = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        left, at = np.arange(len(codes)), self.home(codes)
        while len(left):
            first = np.unique(at, return_index=True)[1]
            first = first[self.codes[at[first]] < 0]
            self.codes[at[first]], self.places[at[first]] = codes[left[first]], left[first]
            stays = np.ones(len(left), bool)
            stays[first] = False
            left, at = left[stays], (at[stays] + 1) & (len(self.codes) - 1)

    def home(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The place of each code, -1 for unknown ones."""
        flat = codes.ravel()
        at = self.home(flat)
        met = self.codes[at]
        out = np.where(met == flat, self.places[at], -1)
        left = np.flatnonzero((met != flat) & (met >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.codes) - 1)
            met, asked = self.codes[at[left]], flat[left]
            same = met == asked
            out[left[same]] = self.places[at[left[same]]]
            left = left[~same & (met >= 0)]
        return out.reshape(codes.shape)


class Remembered:
    """Codes and decoded text of texts met before: at most about `most`; a full store keeps what was met again."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys, self.codes, self.words, self.again = pa.array([], pa.string()), binary(np.zeros(1), b""), binary(np.zeros(1), b""), np.zeros(0, bool)

    def of(self, keys: pa.Array, learn) -> tuple[pa.Array, pa.Array]:  # noqa: ANN001
        """Codes and decoded text of distinct keys; learn gives those of the new ones."""
        at = pc.index_in(keys, value_set=self.keys).fill_null(-1).to_numpy().astype(np.int64)
        fresh = at < 0
        self.again[at[~fresh]] = True
        if fresh.any():
            new = keys.filter(pa.array(fresh))
            if len(self.keys) + len(new) > self.most:
                kept = self.again.copy()
                if kept.sum() > self.most // 2:
                    kept[:] = False
                kept[at[~fresh]] = True
                place = np.cumsum(kept) - 1
                at[~fresh] = place[at[~fresh]]
                mask = pa.array(kept)
                self.keys, self.codes, self.words, self.again = self.keys.filter(mask), self.codes.filter(mask), self.words.filter(mask), np.zeros(int(kept.sum()), bool)
            codes, words = learn(new)
            at[fresh] = len(self.keys) + np.arange(len(new))
            self.keys, self.codes, self.words = (pa.concat_arrays(x) for x in ([self.keys, new], [self.codes, codes], [self.words, words]))
            self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
        return self.codes.take(pa.array(at)), self.words.take(pa.array(at))


class WordBPE:
    """A tokenizer file with word ends: NFC, white space, lower case, a split into words, byte letters, merges."""

    #: Chunks and words that are remembered, at most, each, and pairs with a known verdict.
    CACHE, PAIRS = 300_000, 500_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split").replace(r"\s", r"\p{White_Space}")
        self.words, self.lines = regex.compile(pattern), regex.compile(rf"{pattern}|\n")
        # Letters and numbers that the pattern's tables know and Python's do not yet: the library doesn't count them as such.
        later = later_letters()
        self.later = regex.compile(f"[{later}]") if later else None
        older = pattern.replace(r"\p{L}", rf"[\p{{L}}--[{later}]]").replace(r"\p{N}", rf"[\p{{N}}--[{later}]]") if later else pattern
        self.older_words, self.older_lines = regex.compile(older, regex.V1), regex.compile(rf"{older}|\n", regex.V1)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = byte_letters()
        self.bytes_of = {c: b for b, c in enumerate(self.letters)}
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[a], self.vocab[b]] = rank
            self.made.append(self.vocab[a + b])
        plain = len(self.end)
        self.letter_ids = np.array([self.vocab[c] for c in self.letters], np.int64)
        self.last_ids = np.array([self.vocab[c + self.end] for c in self.letters], np.int64)
        self.pairs, self.made_ids = PairTable(np.array([(a << 32) | b for a, b in self.ranks], np.int64)), np.array(self.made, np.int64)
        nodes, accepts = {(0, 0): 0}, [-1]  # (node, byte or _END) -> node; the token that ends at a node
        for token, i in self.vocab.items():
            ends, node = plain and token.endswith(self.end) and len(token) > plain, 0
            for c in [*(self.bytes_of[c] for c in (token[:-plain] if ends else token)), *[_END] * bool(ends)]:
                key, fresh = (node, c + 1), len(accepts)
                node = nodes.setdefault(key, fresh)
                if node == fresh:
                    accepts.append(-1)
            accepts[node] = i
        del nodes[0, 0]
        self.walk = {(n << 9) | (c - 1): to for (n, c), to in nodes.items()}
        self.steps, self.targets, self.accepts = PairTable(np.array(list(self.walk), np.int64)), np.array(list(self.walk.values()), np.int64), np.array(accepts, np.int64)
        size = max(self.names) + 1
        named = [f"{self.names[i]} ".encode() if i in self.names else b"" for i in range(size)]
        self.spelling = binary(np.concatenate([[0], np.cumsum([len(x) for x in named])]), b"".join(named))
        self.reachable, self.checked = np.zeros(size, bool), np.zeros(size, bool)
        self.codes, self.verdicts = np.empty(0, np.int64), np.empty(0, bool)
        self.known, self.cache = Remembered(self.CACHE), Remembered(self.CACHE)

    # -- exact merging ------------------------------------------------------------------------------------------------
    def merge(self, ids: list[int]) -> list[int]:
        """Merge the pair of lowest rank, the leftmost first, until no pair can be merged."""
        if len(ids) < 2:
            return ids
        ids, ranks, made = list(ids), self.ranks, self.made
        near = [ranks.get(p, _FAR) for p in zip(ids, ids[1:], strict=False)]
        if len(ids) <= SHORT:
            while near and (best := min(near)) < _FAR:
                i = near.index(best)
                ids[i : i + 2] = [made[best]]
                del near[i]
                if i < len(near):
                    near[i] = ranks.get((ids[i], ids[i + 1]), _FAR)
                if i:
                    near[i - 1] = ranks.get((ids[i - 1], ids[i]), _FAR)
            return ids
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(near) if r < _FAR]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made[rank], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := ranks.get((ids[left], ids[right]), _FAR)) < _FAR:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [x for x in ids if x >= 0]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at = self.pairs.find((left << 32) | right)
        return np.where(at >= 0, at, _FAR)

    def merge_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of short sequences in step, each a row that ends in -1s: the row and the id of every token left, in
        order within a row."""
        owners, found = [], []
        rows = np.arange(len(ids))
        near = np.where(ids[:, 1:] >= 0, self.rank_of(ids[:, :-1], ids[:, 1:]), _FAR)
        while len(rows):
            best = near.min(axis=1) if near.shape[1] else np.full(len(rows), _FAR)
            go = best < _FAR
            if not go.all():
                done = ids[~go]
                row, col = np.nonzero(done >= 0)
                owners.append(rows[~go][row])
                found.append(done[row, col])
                rows, ids, near, best = rows[go], ids[go], near[go], best[go]
                if not len(rows):
                    break
            i, r = near.argmin(axis=1), np.arange(len(rows))
            ids[r, i] = self.made_ids[best]
            cols = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cols + (cols > i[:, None]), axis=1)
            cols = cols[:-1]
            near = np.take_along_axis(near, cols + (cols >= i[:, None]), axis=1)
            for at in (i - 1, i):
                k = np.flatnonzero((at >= 0) & (at < near.shape[1]))
                a = at[k]
                right = ids[k, a + 1]
                near[k, a] = np.where(right >= 0, self.rank_of(ids[k, a], right), _FAR)
        return np.concatenate([np.empty(0, np.int64), *owners]), np.concatenate([np.empty(0, np.int64), *found])

    def spelled(self, token: int) -> list[int]:
        """Ids of the letters that a token spells."""
        name = self.names[token]
        if self.end and name.endswith(self.end) and name != self.end:
            name = name[: -len(self.end)]
            return [*(self.vocab[c] for c in name[:-1]), self.vocab[name[-1] + self.end]]
        return [self.vocab[c] for c in name]

    # -- speculation and verification ---------------------------------------------------------------------------------
    def propose(self, letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match of many words at once, each a row of bytes: all walk down the vocabulary's trie in step.
        Returns the owner and the id of each proposed piece, in order within a word, and the words with no such cut."""
        rows = np.arange(len(lengths))
        full = np.concatenate([letters.astype(np.int64), np.full((len(rows), 1), _END)], axis=1)
        full[rows, lengths] = _END
        here, node = np.zeros_like(rows), np.zeros_like(rows)
        token, stop = np.full_like(rows, -1), np.zeros_like(rows)
        owners, found, lost = [], [], []
        n = lengths + (1 if self.end else 0)
        while len(rows):
            at = self.steps.find((node << 9) | full[rows, np.minimum(here, n - 1)])
            moves = (at >= 0) & (here < n)
            node = np.where(moves, self.targets[at], 0)
            here = here + moves
            ok = moves & (self.accepts[node] >= 0) & ((here != n - 1) if self.end else True)
            token, stop = np.where(ok, self.accepts[node], token), np.where(ok, here, stop)
            halt = ~moves
            if halt.any():
                bad = halt & (token < 0)
                lost.append(rows[bad])
                good = halt & ~bad
                owners.append(rows[good])
                found.append(token[good])
                here, node, token = np.where(good, stop, here), np.where(good, 0, node), np.where(good, -1, token)
                stays = ~(bad | (good & (stop == n)))
                rows, here, node, token, stop, n = (x[stays] for x in (rows, here, node, token, stop, n))
        owner, piece = np.concatenate([np.empty(0, np.int64), *owners]), np.concatenate([np.empty(0, np.int64), *found])
        order = np.argsort(owner, kind="stable")
        return owner[order], piece[order], np.concatenate([np.empty(0, np.int64), *lost])

    def propose_long(self, word: bytes) -> list[int] | None:
        """The same cut of one long word."""
        full, here, out = [*word, *[_END] * bool(self.end)], 0, []
        while here < len(full):
            node, token, stop = 0, -1, here
            for at in range(here, len(full)):
                if (node := self.walk.get((node << 9) | full[at], -1)) < 0:
                    break
                if self.accepts[node] >= 0 and not (self.end and at + 2 == len(full)):
                    token, stop = int(self.accepts[node]), at + 1
            if token < 0:
                return None
            out.append(token)
            here = stop
        return out

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """A verdict for each code (left << 32 | right); known ones are looked up together, new ones merged once."""
        distinct, back = np.unique(pairs, return_inverse=True)
        if len(self.codes) > self.PAIRS:
            self.codes, self.verdicts = self.codes[:0], self.verdicts[:0]
        at = np.searchsorted(self.codes, distinct)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == distinct[known]
        if not known.all():
            fresh = distinct[~known]
            good, rows = np.zeros(len(fresh), bool), []
            groups: dict[int, list[int]] = {}
            for i, c in enumerate(fresh.tolist()):
                a, b = c >> 32, c & 0xFFFFFFFF
                rows.append([*self.spelled(a), *self.spelled(b)])
                n = len(rows[-1])
                if n > SHORT:
                    good[i] = self.merge(rows[-1]) == [a, b]
                else:
                    groups.setdefault(8 if n <= 8 else 16 if n <= 16 else SHORT, []).append(i)
            for width, members in groups.items():
                owner, ids = self.merge_rows(np.array([rows[i] + [-1] * (width - len(rows[i])) for i in members], np.int64))
                order = np.argsort(owner, kind="stable")
                owner, ids = owner[order], ids[order]
                two = np.bincount(owner, minlength=len(members)) == 2
                first = np.searchsorted(owner, np.flatnonzero(two))
                good[np.array(members)[two]] = (ids[first] << 32 | ids[first + 1]) == fresh[np.array(members)[two]]
            codes = np.concatenate([self.codes, fresh])
            order = np.argsort(codes, kind="stable")
            self.codes, self.verdicts = codes[order], np.concatenate([self.verdicts, good])[order]
            at = np.searchsorted(self.codes, distinct)
        return self.verdicts[at][back]

    def verified(self, owner: np.ndarray, piece: np.ndarray, count: int) -> np.ndarray:
        """Whether each of `count` words (the owners of the pieces, in order) is what merging gives: all its pieces can be
        reached, and all its adjacent pairs are compatible."""
        good = np.ones(count, bool)
        for t in np.unique(piece[~self.checked[piece]]):
            self.reachable[t], self.checked[t] = self.merge(self.spelled(int(t))) == [int(t)], True
        good[owner[~self.reachable[piece]]] = False
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        if len(inner):
            good[owner[inner[~self.compatible((piece[inner] << 32) | piece[inner + 1])]]] = False
        return good

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and where each word's begin (one more entry at the end): proposals that pass
        every test, exact merging for the rest. Words of up to SHORT bytes are proposed for and merged many in step, longer
        ones one by one; all are tested the same way."""
        bounds, data = ranges(words.cast(pa.large_binary()))
        letters, lengths = np.frombuffer(data, np.uint8), np.diff(bounds)
        owners, found = [], []
        done = 0
        for width in (8, 12, 16, 24, SHORT):
            members = np.flatnonzero((lengths > done) & (lengths <= width))
            done = width
            for at in range(0, len(members), TABLE // width):
                part = members[at : at + TABLE // width]
                n = lengths[part]
                cols = np.arange(width)
                inside = cols < n[:, None]
                table = np.where(inside, letters[np.where(inside, bounds[part][:, None] + cols, 0)], 0)
                owner, piece, lost = self.propose(table, n)
                good = self.verified(owner, piece, len(part))
                good[lost] = False
                keep = good[owner]
                owners.append(part[owner[keep]])
                found.append(piece[keep])
                again = np.flatnonzero(~good)
                if len(again):
                    symbols = np.where(inside[again], self.letter_ids[table[again]], -1)
                    symbols[np.arange(len(again)), n[again] - 1] = self.last_ids[table[again, n[again] - 1]]
                    row, ids = self.merge_rows(symbols)
                    owners.append(part[again[row]])
                    found.append(ids)
        for i in np.flatnonzero(lengths > SHORT).tolist():
            word = letters[bounds[i] : bounds[i + 1]]
            ids = self.propose_long(word.tobytes())
            if ids is None or not self.verified(np.zeros(len(ids), np.int64), np.array(ids, np.int64), 1)[0]:
                ids = self.merge([*self.letter_ids[word[:-1]].tolist(), int(self.last_ids[word[-1]])])
            owners.append(np.full(len(ids), i))
            found.append(np.array(ids, np.int64))
        owner, ids = np.concatenate([np.empty(0, np.int64), *owners]), np.concatenate([np.empty(0, np.int64), *found])
        order = np.argsort(owner, kind="stable")
        return ids[order], np.searchsorted(owner[order], np.arange(len(words) + 1))

    # -- texts --------------------------------------------------------------------------------------------------------
    def pieces(self, text: str) -> list[str]:
        """The words of a text, special tokens as they stand."""
        out: list[str] = []
        for part in self.split_special.split(text) if self.split_special and "<|" in text else [text]:
            if part in self.special:
                out.append(part)
            elif part:
                out += self.cut(part, False)
        return out

    def cut(self, text: str, lines: bool) -> list[str]:
        """The words of a text without special tokens, with line ends among them where `lines` is set."""
        text = unicodedata.normalize("NFC", text)
        low = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        if self.later and not low.isascii() and self.later.search(low):
            return (self.older_lines if lines else self.older_words).findall(low)
        return (self.lines if lines else self.words).findall(low)

    def learn_words(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Ids (as little-endian bytes) and decoded text (each token with a space after it) of each word; a line end has none."""
        ids, first = self.encode_words(pc.if_else(pc.equal(words, "\n"), "", words))
        for token, i in self.special.items():
            if (at := pc.index(words, token).as_py()) >= 0:
                ids, first = np.concatenate([ids[: first[at]], [i], ids[first[at + 1] :]]), np.concatenate([first[: at + 1], first[at + 1 :] + 1 - (first[at + 1] - first[at])])
        bounds, data = ranges(self.spelling.take(pa.array(ids)))
        return binary(4 * first, ids.astype("<u4").tobytes()), binary(bounds[first], data)

    def learn_chunks(self, chunks: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The same of chunks between white space. All are cut into words in one pass, a line for each; those with special
        tokens are cut on their own."""
        rows = chunks.to_pylist()
        odd = {i: self.pieces(c) for i, c in enumerate(rows) if "<|" in c}
        words = self.cut("\n".join([c if i not in odd else "" for i, c in enumerate(rows)] if odd else rows) + "\n", True)
        if odd:
            ends = [k for k, w in enumerate(words) if w == "\n"]
            for i in sorted(odd, reverse=True):
                words[ends[i] : ends[i]] = odd[i]
        coded = pa.array(words, pa.string()).dictionary_encode()
        line = pc.index(coded.dictionary, "\n").as_py()
        ends = np.flatnonzero(coded.indices.to_numpy() == line)
        out = []
        for x in self.known.of(coded.dictionary, self.learn_words):
            bounds, data = ranges(x.take(coded.indices))
            out.append(binary(np.concatenate([[0], bounds[ends]]), data))
        return out[0], out[1]

    def encode_texts(self, texts: pa.Array) -> list[tuple[bytes, bytes]]:
        """Ids (as little-endian bytes) and decoded text (in UTF-8) of each text."""
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        first = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        (a, codes), (b, words) = (ranges(x.take(coded.indices)) for x in self.cache.of(coded.dictionary, self.learn_chunks))
        return [(codes[i:j].to_pybytes(), words[k : max(k, m - 1)].to_pybytes()) for i, j, k, m in zip(a[first[:-1]].tolist(), a[first[1:]].tolist(), b[first[:-1]].tolist(), b[first[1:]].tolist(), strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so the tokens are joined by one space; unknown ids are left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_texts(pa.array([text], pa.string()))[0][0], "<u4").tolist()


@lru_cache(maxsize=1)
def loaded(path: str) -> WordBPE:
    return WordBPE(path)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, and with ids=True the ids themselves.

    A null text counts as empty: no tokens and the digests of no bytes. Repeated rows give repeated results; other
    columns are ignored; an empty table gives an empty result. One row's text is held whole, however long; what a worker
    remembers of words is bounded.
    """
    path = path or tokenizer_file()

    def run(batch: pa.RecordBatch) -> dict:
        bpe, texts = loaded(path), batch.column(1)
        counts, id_sums, text_sums, raw = [], [], [], []
        for a, b in slices(pc.binary_length(texts).fill_null(0).to_pylist(), PART):
            for code, words in bpe.encode_texts(texts.slice(a, b - a)):
                counts.append(len(code) // 4)
                id_sums.append(hashlib.sha256(code).hexdigest())
                text_sums.append(hashlib.sha256(words).hexdigest())
                if ids:
                    raw.append(np.frombuffer(code, "<u4").astype(np.int32))
        out = {"doc_id": batch.column(0), "n": counts, "i": id_sums, "d": text_sums}
        return out | {"ids": raw} if ids else out

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return map_rows(docs.select(docs["doc_id"].cast("bigint"), docs[text].cast("string")), run, schema)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """The rows (doc_id, ids) with the decoded text; null ids give an empty text."""
    path = path or tokenizer_file()

    def run(batch: pa.RecordBatch) -> dict:
        bpe = loaded(path)
        return {"doc_id": batch.column(0), "text": [bpe.decode(x or []) for x in batch.column(1).to_pylist()]}

    return map_rows(rows.select("doc_id", "ids"), run, "doc_id bigint, text string")
