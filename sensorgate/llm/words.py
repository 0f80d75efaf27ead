"""Encode texts through a bounded cache of their pieces.

Both vocabularies split a text before merging, and never across the boundaries used here: white space for the word
vocabulary, which drops it, and the place before a lone space between two other characters for the byte vocabulary,
whose pieces carry the space in front. So the ids of a text are the ids of its pieces in order, and a piece that was
seen before costs one dictionary lookup.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache
from unicodedata import is_normalized

os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism

from tokenizers import Tokenizer  # noqa: E402

#: White space as Unicode has it; str.split() also splits at the four separators U+001C to U+001F.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_UNEVEN = re.compile(r" \s|\s ")
#: Letters whose lower case depends on the library or on what stands around them.
_CASES = frozenset("İΣ")
_BOUNDARY = re.compile(r"(?<=\S)(?= \S)")


def space_pieces(text: str) -> list[str]:
    if _SEPARATORS.search(text):
        return [p for p in _SPACE.split(text) if p]
    return text.split()


def byte_pieces(text: str) -> list[str]:
    """The first piece as it is, all others without the one space in front of each."""
    if _UNEVEN.search(text):
        first, *rest = _BOUNDARY.split(text)
        return [first, *(p[1:] for p in rest)]
    return text.split(" ")


SHORT = 64  # characters of a piece that is worth keeping


class PieceCache:
    """Values of pieces; a batch's missing pieces are made together, and the cache is emptied when it is full."""

    def __init__(self, make: Callable[[list[str]], Iterable], most: int = 400_000):
        gc.set_threshold(200_000, 50, 100)  # the cached values hold no cycles; walking them often costs more than making them
        self.make, self.most, self.known = make, most, {}
        self.passing: list[str] = []  # long pieces are held for one batch only: the bound is a number of pieces

    def __call__(self, pieces: Iterable[list[str]]) -> dict:
        known = self.known
        for p in self.passing:
            known.pop(p, None)
        missing = list(set().union(*pieces).difference(known))
        if len(known) + len(missing) > self.most:  # what this batch uses stays
            self.known = known = {p: known[p] for p in set().union(*pieces) if p in known}
        for at in range(0, len(missing), 20_000):
            part = missing[at : at + 20_000]
            known.update(zip(part, self.make(part), strict=True))
        self.passing = [p for p in missing if len(p) > SHORT]
        return known


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Encoder:
    """Whole texts to little-endian id bytes with the tokenizers library.

    Most pieces are one run of letters with at most a full stop or comma after it: those go to the library's merge model
    directly, all others through its whole chain.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.symbols = self.tokenizer.model, byte_symbols()
        self.kind = "H" if max(self.tokenizer.get_vocab().values()) < 1 << 16 else "I"
        self.width = f"<u{array(self.kind).itemsize}"
        self.lower = self.tokenizer.normalizer is not None
        self.split = space_pieces if self.lower else byte_pieces
        self.cache = PieceCache(self._ids)
        self.cores: dict[str, bytes] = {}
        self.signs = frozenset(".,")
        self.ends = {c: self._whole([c])[0] for c in ".,\n"}

    def _whole(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [array(self.kind, e.ids).tobytes() for e in found]

    def _letters(self, core: str, spaced: bool) -> bytes:
        """Ids of a run of letters, with the space in front if ``spaced``."""
        key = core if spaced or self.lower else "\n" + core
        ids = self.cores.get(key)
        if ids is None:
            coded = core if core.isascii() else "".join([self.symbols[b] for b in core.encode()])
            if spaced and not self.lower:
                coded = self.symbols[32] + coded
            ids = array(self.kind, [t.id for t in self.model.tokenize(coded)]).tobytes()
            if len(core) <= SHORT:
                self.cores[key] = ids
        return ids

    def _simple(self, piece: str, spaced: bool) -> bytes | None:
        """Ids of a run of letters with at most one sign after it; None if the piece is anything else."""
        end = piece[-1:] if piece[-1:] in self.signs else ""
        core = piece[:-1] if end else piece
        if not core.isalpha():
            return None
        if self.lower:
            if not core.isascii() and not (_CASES.isdisjoint(core) and is_normalized("NFC", core)):
                return None
            core = core.lower()
        ids = self._letters(core, spaced)
        return ids + self.ends[end] if end else ids

    def _lines(self, piece: str) -> bytes | None:
        """The same for simple pieces with single line breaks between them (byte vocabulary)."""
        first, *rest = piece.split("\n")
        parts = [self._simple(first, True), *(self._simple(p, False) for p in rest)]
        return None if None in parts else self.ends["\n"].join(parts)

    def _ids(self, pieces: list[str]) -> list[bytes]:
        if len(self.cores) > self.cache.most:
            self.cores.clear()
        simple, lines = self._simple, not self.lower
        out = [self._lines(p) if lines and "\n" in p else simple(p, True) for p in pieces]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._whole([pieces[i] if self.lower else " " + pieces[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        pieces = [self.split(t) for t in texts]
        if self.lower:
            known = self.cache(pieces)
            return [b"".join(map(known.__getitem__, p)) for p in pieces]
        firsts = self._whole([p.pop(0) for p in pieces])
        known = self.cache(pieces)
        return [f + b"".join(map(known.__getitem__, p)) for f, p in zip(firsts, pieces, strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(path)


def slices(texts: list[str], most: int = 4_000_000):
    """Ranges of a batch of at most so many characters, a longer text alone."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)
