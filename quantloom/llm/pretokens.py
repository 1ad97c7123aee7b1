"""Pre-tokens of texts for the public tokenizers, exactly as their library makes them, at dictionary speed.

Texts of common Latin characters are split by a plain regular expression whose classes come from the Unicode database;
any other text, and one with a special string, goes to the library itself. Both give the same pieces.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import public_tokenizers
from tokenizers import Tokenizer


def _class(kinds: str) -> str:
    """The characters up to U+024F whose general category starts with one of the letters."""
    return "".join(re.escape(chr(i)) for i in range(0x250) if unicodedata.category(chr(i))[0] in kinds)


LETTERS, NUMBERS = _class("L"), _class("N")
#: Printable characters for which library and regular expression agree (the tests hold them against each other).
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ɏ]*").fullmatch
#: The two splitting patterns of the public vocabularies.
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+").findall
SPACED = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+").findall


@functools.cache
def byte_characters() -> str:
    """The printable character that stands for each byte in byte-level vocabularies: its own, or the next from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in own else chr(next(spare)) for b in range(256))


@functools.cache
def tokenizer(name: str) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(name))


@functools.cache
def specials(name: str) -> re.Pattern:
    found = [t.content for t in tokenizer(name).get_added_tokens_decoder().values()]
    return re.compile("|".join(map(re.escape, found)))


def words_of(text: str, name: str) -> list[str]:
    """The lower-cased pre-tokens; a special string is one pre-token of its own."""
    if PLAIN(text) and "<|" not in text:
        return WORDS(text.lower())
    t, found, at = tokenizer(name), [], 0
    cuts = [*specials(name).finditer(text), None]
    for cut in cuts:
        part = t.normalizer.normalize_str(text[at : cut.start() if cut else len(text)])
        found += [part[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(part)]
        if cut:
            found.append(cut[0])
            at = cut.end()
    return found


class SpacedIds(dict):
    """Pre-token of the byte-level vocabulary to its ids, as little-endian 32-bit bytes; filled as it is asked."""

    def __init__(self, name: str, most: int = 400_000):
        self.of, self.most = tokenizer(name), most
        self.model, self.characters = self.of.model, byte_characters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        pieces = self.model.tokenize(word.encode().decode("latin-1").translate(self.characters))
        out = self[word] = b"".join([p.id.to_bytes(4, "little") for p in pieces])
        return out

    def ids(self, text: str) -> bytes:
        if PLAIN(text) and "<|" not in text:
            return b"".join(map(self.__getitem__, SPACED(text)))
        return b"".join(i.to_bytes(4, "little") for i in self.of.encode(text, add_special_tokens=False).ids)
