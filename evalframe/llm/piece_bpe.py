"""SentencePiece BPE encoding by a prefix table, and decoding.

For every prefix of a word the table holds one token: the last token of that
prefix's encoding.  It is unique, and found without merging anything: an
Aho-Corasick automaton lists the pieces that end at the place, and the one
that belongs there is the one *compatible* with the token that ends where it
begins.  Two tokens are compatible if encoding their joined text gives just
these two; that is decided once for each pair and remembered.  The ids are
then recovered from the end of the word backwards.

This rests on pieces of distinct scores.  Runs of the white-space mark share
one score in common models, so a word that begins with several of them is
merged pair by pair instead, best score first, leftmost first.  No piece holds
the mark after another character, so texts are cut into words before marks.

Only the normalizer and the list of pieces are taken from the model file; the
tests hold ids and decoded text against the library's.

Defined results: a null or empty text has the begin and end ids only; a
character without a piece becomes the ids of its UTF-8 bytes; repeated rows
are encoded each for itself; an empty table gives no rows; columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evalframe.llm.common import text_list
from evalframe.llm.word_cache import TextEncoder, no_cycle_collection

SPACE = "▁"
# Remembered pairs of tokens in one worker; a pair is one number.
PAIR_LIMIT, PAIR = 2_000_000, 1 << 32

_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceModel:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, size = self.library, self.library.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.control = {i for i in range(size) if sp.is_control(i)}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        ordinary = [i for i in range(size)
                    if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i) or sp.is_unknown(i))]
        self.id_of = {self.pieces[i]: i for i in ordinary}
        self.score = {self.pieces[i]: sp.get_score(i) for i in ordinary}
        self.lengths = list(map(len, self.pieces))
        if any(SPACE in p[1:] and p.strip(SPACE) for p in self.score):
            raise ValueError("a piece holds the white-space mark after another character: texts cannot be cut into words")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            # a piece that merging its own characters does not give is never a token
            if (set(p) != {SPACE} or p == SPACE) and self.merged(p) == [p]:
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.encoder = TextEncoder(self.words, self.word_ids, self.word_ids)
        # what decoding writes for an id, with white space restored
        self.written = [b"" if i in self.control else bytes([self.byte_of[i]]) if i in self.byte_of
                        else " ⁇ ".encode() if i == self.unk else p.replace(SPACE, " ").encode()
                        for i, p in enumerate(self.pieces)]

    # ------------------------------------------------------------- encoding

    def words(self, text: str) -> list[str]:
        return _WORD.findall(self.library.normalize(text))

    def merged(self, text: str) -> list[str]:
        """Pairwise merging: of all neighbours whose joined text is a piece,
        the best score first, then the leftmost."""
        symbols = list(text)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        score, heap = self.score, []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n:
                s = score.get(symbols[i] + symbols[j])
                if s is not None:
                    heapq.heappush(heap, (-s, i, symbols[i], symbols[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if symbols[i] else n
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = left + right, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [s for s in symbols if s]

    def _text(self, token: int) -> str:
        """Tokens are piece ids, or ``~code point`` of a character without a piece."""
        return self.pieces[token] if token >= 0 else chr(~token)

    def compatible(self, first: int, second: int) -> bool:
        a, b = self._text(first), self._text(second)
        if len(self.pairs) >= PAIR_LIMIT:
            self.pairs.clear()
        found = self.pairs[first * PAIR + second] = self.merged(a + b) == [a, b]
        return found

    def prefix_table(self, word: str) -> list[int]:
        """Entry ``i``: the last token of the encoding of ``word[:i]``."""
        last: list[int | None] = [None] * (len(word) + 1)
        known, compatible = self.pairs.get, self.compatible
        for end, (length, token) in self.automaton.iter(word):
            end += 1
            if last[end] is None:  # longer pieces come first
                start = end - length
                if not start:
                    last[end] = token
                    continue
                previous = last[start]
                if previous is None:  # no piece ends there: a character without one
                    previous = last[start] = ~ord(word[start - 1])
                fits = known(previous * PAIR + token)
                if fits or fits is None and compatible(previous, token):
                    last[end] = token
        return [~ord(word[i - 1]) if i and t is None else t for i, t in enumerate(last)] if None in last[1:] else last

    def word_ids(self, word: str) -> bytes:
        if word.startswith(SPACE + SPACE):
            tokens = [self.id_of.get(s, ~ord(s[0])) for s in self.merged(word)]
        else:
            last, i, tokens, lengths = self.prefix_table(word), len(word), [], self.lengths
            while i > 0:
                t = last[i]
                tokens.append(t)
                i -= lengths[t] if t >= 0 else 1
            tokens.reverse()
        if min(tokens) >= 0:
            return struct.pack(f"<{len(tokens)}I", *tokens)
        ids: list[int] = []
        for t in tokens:
            if t >= 0:
                ids.append(t)
            elif self.bytes:
                ids += [self.bytes[b] for b in chr(~t).encode()]
            else:
                ids.append(self.unk)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Begin id, ids of the whole text, end id: little-endian unsigned
        32-bit integers."""
        return b"".join((struct.pack("<I", self.bos), self.encoder.ids(text), struct.pack("<I", self.eos)))

    # ------------------------------------------------------------- decoding

    def decode(self, ids: bytes) -> str:
        """The text of ids: control ids write nothing, byte ids are joined to
        UTF-8, and the space put before every text is taken off again."""
        array = np.frombuffer(ids, dtype="<u4")
        listed = array.tolist()
        first = next((i for i, t in enumerate(listed) if t not in self.control), len(listed))
        text = b"".join(map(self.written.__getitem__, listed))
        if first < len(listed) and self.pieces[listed[first]].startswith(SPACE):
            text = text[1:]
        if np.isin(array[1:-1], list(self.control)).any():  # they part byte ids
            return self._in_order(listed, first)
        try:
            return text.decode()
        except UnicodeDecodeError:
            return self._in_order(listed, first)

    def _in_order(self, listed: list[int], first: int) -> str:
        """As ``decode``, id by id: each byte id that is not part of a valid
        character becomes U+FFFD."""
        out: list[str] = []
        i = first
        while i < len(listed):
            if listed[i] not in self.byte_of:
                piece = self.written[listed[i]].decode()
                out.append(piece[1:] if i == first and self.pieces[listed[i]].startswith(SPACE) else piece)
                i += 1
                continue
            j = i
            while j < len(listed) and listed[j] in self.byte_of:
                j += 1
            run = bytes(self.byte_of[t] for t in listed[i:j])
            k = 0
            while k < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[k:k + n].decode())
                        k += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    k += 1
            i = j
        return "".join(out)


_MODELS: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """This worker's model of a file."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str, with_text: bool = False) -> DataFrame:
    """Each text's ids and the text decoded from them, as digests (and whole
    on request): ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``
    [, ``ids``, ``decoded``].  A map over the documents: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        with no_cycle_collection():
            for b in batches:
                rows: list[list] = [[] for _ in out]
                for text in text_list(b.column(1)):
                    ids = model.encode(text)
                    decoded = model.decode(ids)
                    row = [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                    for column, value in zip(rows, chain(row, [np.frombuffer(ids, "<u4").tolist(), decoded] if with_text else ())):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(rows, types))], ["doc_id", *out])

    out = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_text
    types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string()]
    schema = ("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
              + ", ids array<long>, decoded string" * with_text)
    return docs.select("doc_id", "text").mapInArrow(run, schema)
