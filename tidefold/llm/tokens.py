"""Token ids of texts by a word-level tokenizer file, each distinct part of a word encoded once.

Holds for tokenizers that never look across white space: a text's ids are those
of its words (maximal runs of bytes other than ASCII white space) one after
another. Texts of plain letters, digits and signs are cut as the file's own
pattern cuts them and the parts go straight to the model; the words of all other
texts go through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from array import array

CACHE = 150_000
_PLAIN = re.compile("[\x20-\x7e\t\n\x0b\x0c\r\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
_PARTS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff \t\n\x0b\x0c\r]+")
#: The pattern and the normalisers of the files for which the short cut holds.
_OWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_OWN_NORMALIZERS = ["NFC", "Replace", "Lowercase"]


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a letter: visible Latin-1 as itself, the rest from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


def _ids(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class _Cache(dict):
    """A bounded table of results: when full, what was not used since the last time goes."""

    def __init__(self, make, limit: int = CACHE):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        if (found := self.old.get(key)) is None:
            found = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Encoder:
    """text (UTF-8) -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        cut = [s["pattern"].get("Regex") for s in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if s["type"] == "Split"]
        kinds = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.short_cut = cut == [_OWN_PATTERN] and kinds == _OWN_NORMALIZERS
        self.model, self.letters = self.whole.model, _byte_letters()
        self.parts, self.words = _Cache(self._part), _Cache(self._word)

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() else "".join(self.letters[b] for b in part.encode())
        return _ids([t.id for t in self.model.tokenize(shown)])

    def _word(self, word: bytes) -> bytes:
        return _ids(self.whole.encode(word.decode(errors="replace"), add_special_tokens=False).ids)

    def forget(self) -> None:
        """Empty the tables, so that a worker's later stages have their memory."""
        for table in (self.parts, self.words):
            table.clear()
            table.old = {}

    def encode(self, text: bytes) -> bytes:
        if self.short_cut and b"<|" not in text:
            plain = text.decode(errors="replace")
            if _PLAIN.fullmatch(plain):
                return b"".join(map(self.parts.__getitem__, _PARTS.findall(plain.lower())))
        return b"".join(map(self.words.__getitem__, text.split()))


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
