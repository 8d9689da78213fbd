"""Token ids from the tokenizers library, word by word through a bounded cache.

Byte-level BPE never merges across the border before a space or around a lone line
break, so a text's ids are its words' ids in a row. Real corpora repeat their words:
each task asks the library for a word's ids once and joins byte strings after that.
A text in which white space meets white space takes the library whole, since runs
of white space are tokens of their own.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterable, Iterator

import numpy as np

from lectern.llm.common import tokenizer_file

BYTE_BPE = "byte_bpe_50k.json"
# Words in a generation of a task's cache. A full generation becomes the old one, from
# which words that come again are taken over; the one before it goes.
CACHE_WORDS = 200_000
# Texts encoded together: until they have so many characters, and so many at most.
GROUP_CHARS = 40_000
GROUP_TEXTS = 256
_MARKS = string.punctuation
_SPACE_RUN = re.compile(r"\s\s")
# How the vocabulary file writes a space.
_SPACE = "\u0120"
_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


class WordEncoder:
    """Encodes texts to little-endian ids of ``width`` bytes each."""

    def __init__(self, path: str, width: int = 4, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._dtype = np.dtype(f"<u{width}")
        size = self._tokenizer.get_vocab_size()
        if size > 256**width:
            raise ValueError(f"ids of this vocabulary do not fit {width} bytes")
        # Which ids stand for text that begins with a space.
        self._opens = np.array(
            [(self._tokenizer.id_to_token(i) or "").startswith(_SPACE) for i in range(size)]
        )
        self._cache_words = cache_words
        self._newline = int(self._ids("\n")[0])
        # A word with the space or the line break before it; "" is a space alone.
        self._always = {"": self._whole(" "), "\n": self._whole("\n")}
        self._known, self._old = dict(self._always), {}
        self._tails: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        found = self._tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found[0].ids, self._dtype)

    def _whole(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _batch(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(one.ids, self._dtype).tobytes() for one in found]

    def _learn(self, words: set[str]) -> None:
        """Encode unknown words together: where each begins shows in the ids."""
        new = words.difference(self._known)
        if len(self._known) + len(new) > self._cache_words:
            self._old, self._known = self._known, dict(self._always)
            new = words.difference(self._known)
        again = self._old.keys() & new
        self._known.update((w, self._old[w]) for w in again)
        new -= again
        # Letters and the marks after them are encoded apart; marked words share their letters.
        marked = [(w, h) for w in new if (h := w.rstrip(_MARKS)) != w and h[-1:].isalpha()]
        if marked:
            new.difference_update(w for w, _ in marked)
            self._learn({h for _, h in marked})
            tails = {w[len(h) :] for w, h in marked}.difference(self._tails)
            if len(self._tails) + len(tails) > self._cache_words:
                self._tails.clear()
                tails = {w[len(h) :] for w, h in marked}
            self._tails.update(zip(tails, self._batch(list(tails)), strict=True))
            self._known.update((w, self._known[h] + self._tails[w[len(h) :]]) for w, h in marked)
        spaced = [w for w in new if w[0] != "\n"]
        broken = [w for w in new if w[0] == "\n"]
        if spaced:
            ids = self._ids(" " + " ".join(spaced))
            self._keep(spaced, ids, self._opens[ids], " ")
        if broken:
            ids = self._ids("".join(broken))
            self._keep(broken, ids, ids == self._newline, "")
        # Learning the letters may have begun a generation.
        self._known.update((w, self._old[w]) for w in words.difference(self._known))

    def _keep(self, words: list[str], ids: np.ndarray, opens: np.ndarray, before: str) -> None:
        starts = np.flatnonzero(opens)
        if len(starts) != len(words):
            self._known.update(zip(words, self._batch([before + w for w in words]), strict=True))
            return
        raw, width = ids.tobytes(), self._dtype.itemsize
        cuts = [*(starts * width).tolist(), len(raw)]
        self._known.update(zip(words, map(raw.__getitem__, map(slice, cuts, cuts[1:])), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text; words that are new to the cache are learnt together."""
        plain = [not _SPACE_RUN.search(t) and t[:1] not in ("", " ", "\n") for t in texts]
        words = [t.replace("\n", " \n").split(" ") for t, p in zip(texts, plain, strict=True) if p]
        # A text's first word has no space before it; texts that are not cut are encoded whole.
        firsts = [own.pop(0) for own in words]
        whole = [t for t, p in zip(texts, plain, strict=True) if not p]
        opening = self._batch(firsts)
        self._learn(set().union(*words))
        known = self._known.__getitem__
        cut = (first + b"".join(map(known, own)) for first, own in zip(opening, words, strict=True))
        rest = iter(self._batch(whole))
        return [next(cut if p else rest) for p in plain]


def encoder(path: str, width: int = 4) -> WordEncoder:
    """The worker's encoder for a vocabulary file; it lives as long as the worker."""
    key = (path, width)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, width)
    return _ENCODERS[key]


def encode_all(texts: Iterable[str | None], path: str | None, width: int = 4) -> Iterator[bytes]:
    """Ids of each text as bytes; a null text has none."""
    words = encoder(path or tokenizer_file(BYTE_BPE), width)
    group: list[str] = []
    held = 0
    for text in texts:
        group.append(text or "")
        held += len(group[-1])
        if held >= GROUP_CHARS or len(group) >= GROUP_TEXTS:
            yield from words.encode(group)
            group, held = [], 0
    if group:
        yield from words.encode(group)
