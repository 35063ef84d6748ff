"""Byte-level BPE ids for batches of texts, counted the same as by the tokenizers library.

A text is cut into pre-tokens (a word with its leading space, digits, symbols, white
space), and BPE never crosses them. Whole chunks of texts are cut at once on their array
of code points, distinct pre-tokens are looked up in a cache of this worker, and only new
ones are encoded, so that each word is merged once and not at every place it stands.

Texts with a code point that this cutting does not know for certain (outside Latin, Greek
and Cyrillic, or an apostrophe, which starts contractions) or with a special token go to
the tokenizer as they are. Either way gives the same ids.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np

#: Code points worked on at once; longer texts are cut where no pre-token can cross.
CHUNK = 400_000
#: Pre-tokens kept by a worker before it starts anew.
CACHE = 1_000_000
KNOWN = 0x530
LETTER, NUMBER, SYMBOL, WHITE, ODD = range(5)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BEFORE_SPACE = re.compile(r"\S(?=[ \n])")


def _classes() -> np.ndarray:
    table = np.full(KNOWN + 1, ODD, np.uint8)
    for cp in range(KNOWN):
        kind = unicodedata.category(chr(cp))
        if kind[0] == "L":
            table[cp] = LETTER
        elif kind[0] == "N":
            table[cp] = NUMBER
        elif chr(cp) in " \t\n\r\x0b\x0c":
            table[cp] = WHITE
        elif kind[0] in "PSM" and chr(cp) != "'":
            table[cp] = SYMBOL
    return table


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Encoder:
    """Ids of whole texts by the tokenizer file `path`, special tokens not added."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        # The byte alphabet: printable bytes stand for themselves, the others for the
        # characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()
                 if token not in self.special}
        self.words = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks,
                                       special_tokens={})._core_bpe
        self.classes = _classes()
        inverse = np.uint64(pow(int(_BASE), -1, 2 ** 64))
        self.up, self.down = _powers(_BASE, CHUNK + 1), _powers(inverse, CHUNK + 1)
        self._forget()

    @functools.cached_property
    def tokenizer(self):
        """Loaded when the first odd text comes."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _forget(self) -> None:
        self.keys = np.empty(0, np.uint64)      # sorted
        self.starts = np.empty(0, np.int64)
        self.lens = np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    def _slots(self, keys: np.ndarray, pieces_of) -> np.ndarray:
        """Places in the cache of sorted distinct `keys`; new ones are encoded."""
        at = np.searchsorted(self.keys, keys)
        at_safe = np.minimum(at, max(0, len(self.keys) - 1))
        new = np.ones(len(keys), bool) if not len(self.keys) else self.keys[at_safe] != keys
        if new.any():
            encode = self.words.encode_single_piece
            found = [encode(piece.encode()) for piece in pieces_of(np.flatnonzero(new))]
            lens = np.fromiter(map(len, found), np.int64, len(found))
            starts = len(self.flat) + np.cumsum(lens) - lens
            self.flat = np.concatenate(
                [self.flat, np.fromiter(chain.from_iterable(found), np.uint32, int(lens.sum()))])
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.starts = np.insert(self.starts, at[new], starts)
            self.lens = np.insert(self.lens, at[new], lens)
            at = np.searchsorted(self.keys, keys)
        return at

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts of known code points, CHUNK code points at most in all."""
        whole = "".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        n = len(cp)
        kind = self.classes[cp]
        first = np.zeros(n + 1, bool)
        first[0] = True
        first[ends] = True
        first = first[:n]
        last = np.append(first[1:], True)
        white = kind == WHITE
        # A space before a visible character belongs to it.
        lead = np.zeros(n, bool)
        lead[1:] = (cp[:-1] == 32) & ~first[1:]
        same = np.zeros(n, bool)
        same[1:] = (kind[1:] == kind[:-1]) & ~first[1:]
        next_visible = np.append(~white[1:], False) & ~last
        start = np.where(white, first | ~same | next_visible, ~(same | lead))
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], n)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((cp + np.uint32(1)).astype(np.uint64) * self.up[:n], out=sums[1:])
            keys = (sums[end] - sums[begin]) * self.down[begin]
        distinct, place, back = np.unique(keys, return_index=True, return_inverse=True)
        at = self._slots(distinct, lambda new: [
            whole[b:e] for b, e in zip(begin[place[new]].tolist(), end[place[new]].tolist())])
        lens, starts = self.lens[at][back], self.starts[at][back]
        upto = np.cumsum(lens)
        total = int(upto[-1])
        ids = self.flat[np.repeat(starts - (upto - lens), lens) + np.arange(total)]
        if len(self.keys) > CACHE:
            self._forget()
        # Tokens before the end of each text.
        cuts = np.concatenate([[0], upto])[np.searchsorted(begin, ends)]
        return np.split(ids, cuts[:-1])

    def _odd(self, texts: list[str]) -> np.ndarray:
        """Which of the non-empty `texts` hold something the cutting does not know."""
        whole = "".join(texts)
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kind = self.classes[np.minimum(cp, KNOWN)]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        odd = np.maximum.reduceat(kind, np.cumsum(sizes) - sizes) == ODD
        if any(s in whole for s in self.special):
            odd |= np.array([any(s in t for s in self.special) for t in texts])
        return odd | (sizes > CHUNK)

    def _segments(self, texts: list[str]) -> Iterator[tuple[int, str]]:
        for i, text in enumerate(texts):
            at = 0
            while len(text) - at > CHUNK:
                cut = max((m.end() for m in _BEFORE_SPACE.finditer(
                    text, at + CHUNK - 10_000, at + CHUNK + 1)), default=0)
                if cut <= at:  # no white space near: the rest of the text in one
                    break
                yield i, text[at:cut]
                at = cut
            yield i, text[at:]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids (uint32) of each text, in order."""
        group: list[tuple[int, str]] = []
        size = 0
        done, parts = 0, []

        def flush() -> Iterator[tuple[int, np.ndarray]]:
            filled = [s for _, s in group if s]
            odd = self._odd(filled) if filled else np.empty(0, bool)
            plain = [s for s, o in zip(filled, odd) if not o]
            fast, odds = iter(self._plain(plain) if plain else []), iter(odd)
            for i, s in group:
                if not s:
                    yield i, np.empty(0, np.uint32)
                elif next(odds):
                    yield i, np.array(
                        self.tokenizer.encode(s, add_special_tokens=False).ids, np.uint32)
                else:
                    yield i, next(fast)
            group.clear()

        def ready(found: Iterator[tuple[int, np.ndarray]]) -> Iterator[np.ndarray]:
            nonlocal done, parts
            for i, ids in found:
                while done < i:
                    yield parts[0] if len(parts) == 1 else np.concatenate(parts)
                    done, parts = done + 1, []
                parts.append(ids)

        for i, segment in self._segments(texts):
            if group and size + len(segment) > CHUNK:
                yield from ready(flush())
                size = 0
            group.append((i, segment))
            size += len(segment)
        yield from ready(flush())
        if texts:
            yield parts[0] if len(parts) == 1 else np.concatenate(parts)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
