"""Token ids by a public tokenizer, made per distinct stretch between spaces and remembered.

Both vocabularies cut a text before they merge bytes, and no cut depends on what is beyond a single space between two
other characters. So a text is parted there, and where that's exact a part again: a word and the mark after it, the sides
of a line break. Each distinct unit is encoded once by the library, words by its model and others by the whole of it. The
memory is bounded: of two generations of ``REMEMBER`` units each (some 250 bytes a unit) the older goes when the younger
is full, and what's met again becomes young.

Strings of special tokens in a text become those tokens, as the library does by default: they have no white space, so
each lies in one part. Shortcuts are taken for ASCII digits and marks, and for letters whose class is the same in all
versions of Unicode and whose lower case is one letter (Latin, Greek and Cyrillic, without the dotted capital I); the
library has the rest.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

REMEMBER = 300_000

_ADJACENT = re.compile(r"\s\s")
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
# Without the capital sigma, whose lower case depends on its place in Python alone.
_LETTERS = "".join(c for c in map(chr, range(0x41, 0x530)) if c.isalpha() and c != "\u03a3" and len(c.lower()) == 1 and unicodedata.is_normalized("NFC", c))
#: A word or an ASCII number, and marks after it: two units whatever the marks are, as none of them is a letter.
_ENDED = re.compile(f"(?:([{_LETTERS}]+)|([0-9]+))([!-/:-@\\[-`{{-~]*)")


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones as themselves, others as the letters from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    return {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in plain)}


_BYTES = _byte_letters()
_SPACE = _BYTES[0x20]
#: How byte-level vocabularies write the letters that shortcuts are taken for, beyond ASCII.
_WIDE = {ord(c): c.encode().decode("latin-1").translate(_BYTES) for c in set(_LETTERS + _LETTERS.lower()) if not c.isascii()}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A space between parts belongs to the part after it, unless the tokenizer drops white space.
        self.space = "" if self.tokenizer.normalizer is not None else " "
        self.known: dict[str, bytes] = {}  # units with the space before them
        self.first: dict[str, bytes] = {} if self.space else self.known  # units without
        self.known_before: dict[str, bytes] = {}
        self.first_before: dict[str, bytes] = {} if self.space else self.known_before
        self.codes = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.merge = self.tokenizer.model.tokenize

    def _merged(self, unit: str) -> bytes:
        codes = self.codes
        return b"".join([codes[t.id] for t in self.merge(unit)])

    def _word(self, unit: str, spaced: bool) -> bytes | None:
        """Ids of letters or digits alone, and of marks after them, which the library's model merges; None for other units."""
        marks = ""
        if not (unit.isascii() and unit.isalpha()):
            found = _ENDED.fullmatch(unit)
            if not found:
                return None
            unit, digits, marks = found.groups()
            if digits:
                ids = self._merged(_SPACE + digits if spaced else digits) if self.space else b"".join([self._merged(d) for d in digits])
                return ids + self._ids(marks, False) if marks else ids
        if not self.space:
            unit = unit.lower()
        if not unit.isascii():
            unit = unit.translate(_WIDE)
        ids = self._merged(_SPACE + unit if spaced and self.space else unit)
        return ids + self._ids(marks, False) if marks else ids

    def _ids(self, part: str, spaced: bool) -> bytes:
        """Ids of a part, or of a unit; true for those with the space before."""
        memory, before = (self.known, self.known_before) if spaced else (self.first, self.first_before)
        ids = memory.get(part)
        if ids is not None:
            return ids
        ids = before.get(part) or self._word(part, spaced)
        if ids is None:
            left, line, right = part.partition("\n")
            if line and left and right and not left[-1].isspace() and not right[0].isspace():
                return self._ids(left, spaced) + (self._ids("\n", False) if self.space else b"") + self._ids(right, False)
            got = self.tokenizer.encode_batch_fast([self.space + part if spaced else part], add_special_tokens=False)
            ids = np.array(got[0].ids, "<u4").tobytes()
        self._keep(memory, before, part, ids)
        return ids

    @staticmethod
    def _keep(memory: dict[str, bytes], before: dict[str, bytes], part: str, ids: bytes) -> None:
        if len(memory) >= REMEMBER:
            before.clear()
            before.update(memory)
            memory.clear()
        memory[part] = ids

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.space:
            text = text.replace("\n", " ")  # white space of any kind is dropped
        if self.space and _ADJACENT.search(text):
            head, *parts = _SINGLE.split(text)
        else:
            head, *parts = text.split(" ")
        first = self._ids(head, False)
        known, before, merge, codes, space = self.known, self.known_before, self.merge, self.codes, self.space
        found = list(map(known.get, parts))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    part = parts[k]
                    if part.isalpha() and part.isascii():  # most new parts: ``_ids`` in short
                        ids = before.get(part) or b"".join([codes[t.id] for t in merge(_SPACE + part if space else part.lower())])
                        self._keep(known, before, part, ids)
                        found[k] = ids
                    else:
                        found[k] = self._ids(part, True)
        return first + b"".join(found)


_MADE: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python process and file."""
    if path not in _MADE:
        _MADE[path] = Encoder(path)
    return _MADE[path]


def vocabulary(name: str) -> str:
    """The file of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)
