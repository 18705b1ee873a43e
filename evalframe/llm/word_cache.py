"""Tokenizing whole texts through a bounded cache of their words.

A text is cut only where its tokenizer provably starts anew, so the ids of the
text are the ids of the cut words one after another.  Words repeat far more
often than texts do, so a worker keeps the ids of the words it met last.
"""

from __future__ import annotations

import contextlib
import gc
import os
import re
import struct
from collections.abc import Callable, Iterator

# Words of a generation (about 200 bytes each); a worker keeps two of them.
CACHE_WORDS = 600_000


@contextlib.contextmanager
def no_cycle_collection() -> Iterator[None]:
    """Caches of millions of small objects make the cycle collector costly and
    hold no cycles; reference counting frees all that is freed here."""
    was_on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was_on:
            gc.enable()


class WordIds(dict):
    """Word -> its ids as little-endian unsigned 32-bit integers.  A word not
    held yet is encoded; a full generation becomes the old one, from which
    words that are met again come back, and the one before it is dropped."""

    def __init__(self, encode: Callable[[str], bytes], limit: int = CACHE_WORDS):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.pop(word, None)
        if ids is None:
            ids = self.encode(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class TextEncoder:
    """``split(text)`` cuts a text into words for ``encode``, or gives
    ``None`` for a text that must be encoded whole."""

    def __init__(self, split: Callable[[str], list[str] | None], encode: Callable[[str], bytes],
                 encode_whole: Callable[[str], bytes], limit: int = CACHE_WORDS):
        self.split, self.encode_whole, self.words = split, encode_whole, WordIds(encode, limit)

    def ids(self, text: str) -> bytes:
        words = self.split(text) if text else []
        if words is None:
            return self.encode_whole(text)
        return b"".join(map(self.words.__getitem__, words))


# A byte-level BPE cuts a text before white space, and a space goes with the
# word after it.  Text whose only white space is " " and "\n" can therefore be
# cut after any other character that precedes one of these.
_BYTE_LEVEL_WORD = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_OTHER_ASCII_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_FIRST = "\r"


def split_byte_level(text: str) -> list[str] | None:
    """Words with the white space before them; of a word after one space, only
    the word; a word that begins the text is marked with ``_FIRST``."""
    if any(c in text for c in _OTHER_ASCII_SPACE) if text.isascii() else _OTHER_SPACE.search(text):
        return None
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text.endswith((" ", "\n")):
        words = _BYTE_LEVEL_WORD.findall(text)
    else:
        words = text.replace("\n", " \n").split(" ")
        if not words[0]:
            return words[1:]
    if words[0][0] not in " \n":
        words[0] = _FIRST + words[0]
    return words


def byte_level_text(word: str) -> str:
    """The part of the text that a word of ``split_byte_level`` stands for."""
    return word[1:] if word[0] == _FIRST else word if word[0] in " \n" else " " + word


# Python's white space less these four is the white space of the tokenizer.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def split_word_level(text: str) -> list[str] | None:
    """For tokenizers that drop white space altogether."""
    return None if _SEPARATORS.search(text) else text.split()


# Perhaps a line break, letters, then marks other than the apostrophe (which
# may begin a contraction): the library's pre-tokenizers cut such a word
# between these and nowhere else.
_PLAIN_WORD = re.compile(r"(\n?)( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level models write for the characters up to
    U+00FF: printable bytes stand for themselves, others follow from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    letter = {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


def _library_encoder(path: str, lower: bool) -> Callable[[str], bytes]:
    """Encodes a text that the tokenizer cuts at most as a plain word is cut
    by its parts, any other by the library's pre-tokenizer."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, letters = tokenizer.model, _byte_letters()
    space, line = letters[ord(" ")], letters[ord("\n")]

    def encode(word: str) -> bytes:
        plain = _PLAIN_WORD.fullmatch(word)
        if plain is None:
            ids = tokenizer.encode(word, add_special_tokens=False).ids
        else:
            ids = []
            for part in plain.groups():
                if part:
                    part = part.lower() if lower else part
                    part = part.replace(" ", space).replace("\n", line) if part.isascii() else part.translate(letters)
                    ids += [t.id for t in model.tokenize(part)]
        return struct.pack(f"<{len(ids)}I", *ids)

    return encode


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def library_encoder(path: str, kind: str) -> TextEncoder:
    """This worker's encoder for a tokenizer file of the ``tokenizers``
    library; ``kind``: ``byte`` (byte-level BPE) or ``word`` (lower case,
    white space dropped)."""
    if (path, kind) not in _ENCODERS:
        encode = _library_encoder(path, kind == "word")
        _ENCODERS[path, kind] = {
            "byte": lambda: TextEncoder(split_byte_level, lambda word: encode(byte_level_text(word)), encode),
            "word": lambda: TextEncoder(split_word_level, encode, encode),
        }[kind]()
    return _ENCODERS[path, kind]
