"""Token ids of many texts with a word cache; the ids are exactly those of the tokenizer."""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

#: Words kept; beyond it the cache starts anew, which changes the time and nothing else.
CACHED_WORDS = 350_000
#: New words go to the tokenizer so many at a time, as one text with spaces between.
AT_ONCE = 2000
_LOW = [chr(i) for i in range(0x300)]


def _of(kind: str) -> str:
    return "".join(re.escape(c) for c in _LOW if unicodedata.category(c)[0] == kind)


def _pattern() -> re.Pattern:
    letters, numbers = _of("L"), _of("N")
    space = "\t\n\x0b\x0c\r \x85\xa0"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")


class WordTokenizer:
    """Ids as little-endian 32-bit bytes. For a tokenizer that works on one word at a time, lower case.

    Texts with code points from U+0300 on, or with what could be a special token, go through the tokenizer as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole, self.words, self.cache = Tokenizer.from_file(path), _pattern().findall, {}
        self.high = re.compile("[^\x00-˿]").search
        # a word's last token, and no other, ends so
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _pack(self, ids: list[int]) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        split: dict[int, list[str]] = {}
        for i, text in enumerate(texts):
            if "<|" in text or not text.isascii() and self.high(text):
                out[i] = self._pack(self.whole.encode(text, add_special_tokens=False).ids)
            else:
                split[i] = self.words(text.lower())
        if len(self.cache) > CACHED_WORDS:
            self.cache = {}
        cache = self.cache
        new = list(set().union(*split.values()).difference(cache)) if split else []
        for a in range(0, len(new), AT_ONCE):
            part = new[a : a + AT_ONCE]
            ids = np.array(self.whole.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) == len(part):
                packed, begin = ids.tobytes(), 0
                for word, stop in zip(part, stops, strict=True):
                    cache[word] = packed[begin:stop]
                    begin = stop
            else:  # some word has a token of another kind
                for word, found in zip(part, self.whole.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    cache[word] = self._pack(found.ids)
        get = cache.__getitem__
        for i, ws in split.items():
            out[i] = b"".join(map(get, ws))
        return out


_open: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process and path."""
    if path not in _open:
        _open[path] = WordTokenizer(path)
    return _open[path]
