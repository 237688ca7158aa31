"""Encoding with a public tokenizer file, remembering what words encode to.

Both tokenizers used here split a text into pre-tokens and run byte-pair
merges on each alone, so a pre-token always encodes alike.  Remembering
pre-tokens gives the library's ids at three times its speed; merges are always
the library's.  Splitting is repeated here for plain texts only: those of tabs,
line ends and the printable characters up to U+024F that neither composing nor
lower-casing leads out of that range, without ``<|``.  Any other text goes to
the library whole.  Control strings in a text are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from itertools import islice

from .common import WORKER_MEMORY

#: Pre-tokens that one Python worker remembers, about 200 bytes each.
REMEMBERED = 600_000
#: The pattern by which a lower-casing tokenizer must split; a byte tokenizer names its own by its kind.  Fixed value.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _is_plain(c: str) -> bool:
    printable = c in "\t\n\r" or " " <= c <= "~" or "\xa1" <= c <= "\u024f"
    return printable and unicodedata.normalize("NFC", c) == c and all(x <= "\u024f" for x in c.lower())


_CHARACTERS = [c for c in map(chr, range(0x250)) if _is_plain(c)]
_PLAIN = re.compile(f"[{re.escape(''.join(_CHARACTERS))}]*")


def _class(kinds: str) -> str:
    return re.escape("".join(c for c in _CHARACTERS if unicodedata.category(c)[0] in kinds))


def _splitter(lower: bool):
    """What the tokenizer's pattern finds in plain texts, for the faster library.

    Letters, digits and signs exclude each other, so letters may be tried first.
    """
    letter, digit, sign, short = f"[{_class('L')}]", f"[{_class('N')}]", rf"[^\s{_class('LN')}]", "'s|'t|'re|'ve|'m|'ll|'d"
    if lower:
        return re.compile(rf"{letter}+|{digit}|{short}|{sign}+").findall
    return re.compile(rf" ?{letter}+| ?{digit}+|{short}| ?{sign}+|\s+(?!\S)|\s+").findall


def _byte_letters() -> dict[int, str]:
    """The character by which a byte-level vocabulary spells each byte.

    Printable Latin-1 bytes stand for themselves, the others in order for the
    characters from U+0100.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(others)}


class _Recent(dict):
    """A dictionary that finds what it lacks and keeps at most ``bound`` entries, the newest."""

    def __init__(self, bound: int, find):
        super().__init__()
        self.bound, self.find = bound, find

    def __missing__(self, key):
        self[key] = found = self.find(key)
        return found

    def trim(self) -> None:
        if len(self) > self.bound:
            for key in list(islice(self, len(self) // 3)):
                del self[key]


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        pre, norm = (json.loads(x.__getstate__()) if x else None for x in (self.library.pre_tokenizer, self.library.normalizer))
        pre = pre or {}
        norms = [x["type"] for x in norm.get("normalizers", [norm])] if norm else []
        inner = pre.get("pretokenizers") or []
        self.lower = norms == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in inner] == ["Split", "ByteLevel"] and inner[0]["invert"] and not inner[1]["use_regex"] and not inner[1]["add_prefix_space"] and inner[0]["pattern"] == {"Regex": WORD_PATTERN}
        self.byte = not norms and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.split = _splitter(self.lower)
        self.letters = _byte_letters()
        self.library.model._resize_cache(0)  # what it would remember is remembered here
        self.tokenize = self.library.model.tokenize
        self.known = _Recent(remembered, self._merge)

    def _merge(self, pretoken: str) -> bytes:
        if pretoken.isascii() and pretoken.isprintable():
            spelled = pretoken.replace(" ", self.letters[0x20])
        else:
            spelled = pretoken.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(spelled)]).tobytes()

    def _cut(self, text: str) -> list[str] | None:
        if not (self.lower or self.byte) or _PLAIN.fullmatch(text) is None or "<|" in text:
            return None
        return self.split(text.lower() if self.lower else text)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for text in texts:
            cut = self._cut(text)
            if cut is None:
                out.append(array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes())
            else:
                known = self.known
                out.append(b"".join(map(known.__getitem__, cut)))
                known.trim()
        return out


_ENCODERS: dict[str, Encoder] = {}
WORKER_MEMORY.append(_ENCODERS)


def encoder(path: str) -> Encoder:
    """One encoder for each worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def public(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
