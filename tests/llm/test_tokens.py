"""SentencePiece encoding, token-id files, packing: against the libraries."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from evalframe.llm import packing, piece_bpe, queries, token_files
from evalframe.llm.word_cache import WordIds, library_encoder
from tests.conftest import SF_SMALL

PIECES, BYTES, WORDS = (queries.tokenizer_path(n) for n in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = list(" \n\t  ab'sdré́ÅÀ1²٣!?\x1c\x85​　漢字😀İΣς﻿_-▁") + [
    "<|endoftext|>", "<|startoftext|>", "'ll", "  ", "\n\n", "\r\n", "\xa0", "<s>", "\x00"]


def odd_texts(n: int, seed: int = 1) -> list[str]:
    r = random.Random(seed)
    return ["", " ", "\n", "a" * 300, " " * 300, "▁▁", "ab " * 99, "\n\nx", "x\n\n", "x \n y"] + [
        "".join(r.choice(ODD) for _ in range(r.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("path,kind", [(BYTES, "byte"), (WORDS, "word")])
def test_word_cache_equals_library(path, kind, small_docs):
    encoder, library = library_encoder(path, kind), Tokenizer.from_file(path)
    texts = [*small_docs.text, *odd_texts(8000)]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(encoder.ids(t), "<u4").tolist() == e.ids, ascii(t)


def test_word_cache_generations():
    asked = []
    words = WordIds(lambda w: asked.append(w) or w.encode(), limit=3)
    for w in "a b c d a e f g a h i j k l m n".split():
        assert words[w] == w.encode()
    assert len(words) <= 3 and len(words.old) <= 3 and asked.count("a") == 1


def test_pieces_equal_library(small_docs):
    model, library = piece_bpe.piece_model(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(2)
    texts = [*small_docs.text, *odd_texts(6000), *("".join(r.choice("aabbe sth") for _ in range(r.randint(0, 60))) for _ in range(3000)),
             *(" " * k + w for k in range(40) for w in ("", "x", "the"))]
    for t in texts:
        want = [library.bos_id(), *library.encode(t), library.eos_id()]
        got = model.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == want, ascii(t)
        assert model.decode(got) == library.decode(want), ascii(t)


def test_decoding_of_any_ids():
    model = piece_bpe.piece_model(PIECES)
    r = random.Random(3)
    for _ in range(4000):
        ids = [r.choice([0, 1, 2, 198, 172, 258, r.randint(3, 258), r.randint(259, 31999), 29871, 259]) for _ in range(r.randint(0, 8))]
        assert model.decode(np.array(ids, "<u4").tobytes()) == model.library.decode(ids), ids


def test_prefix_table_holds_last_tokens():
    """Entry i of a word's table is the last token of the encoding of its first i characters."""
    model = piece_bpe.piece_model(PIECES)
    for word in ("▁internationalisation", "▁hetiohadzüß"):
        table = model.prefix_table(word)
        for i in range(1, len(word) + 1):
            assert model._text(table[i]) == model.merged(word[:i])[-1]


def test_op1_rows(spark, small_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r["doc_id"]: r for r in queries.op1_piece_bpe(spark, SF_SMALL).collect()}
    assert len(got) == len(small_docs)
    for i, t in zip(small_docs.doc_id, small_docs.text):
        ids = np.array([1, *library.encode(t or ""), 2], "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (
            len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(library.decode(ids.tolist()).encode()).hexdigest())


def test_op1_odd_rows(spark, odd_docs, no_docs):
    rows = piece_bpe.encode(odd_docs, PIECES, with_text=True).collect()
    assert len(rows) == odd_docs.count()
    assert {tuple(r["ids"]) for r in rows if r["doc_id"] in (2, 3)} == {(1, 2)}
    assert {r["decoded"] for r in rows if r["doc_id"] == 8} == {"漢字 😀 emoji \x00 <s>  "}
    assert piece_bpe.encode(no_docs, PIECES).count() == 0


# ------------------------------------------------------------------- files

def test_op6_rows(spark, small_docs):
    got = sorted(queries.op6_token_files(spark, SF_SMALL).collect(), key=lambda r: r["doc_id"])
    start = 0
    for r, i, e in zip(got, small_docs.doc_id, Tokenizer.from_file(BYTES).encode_batch(list(small_docs.text), add_special_tokens=False)):
        ids = np.array([*e.ids, 0], "<u4")
        assert tuple(r)[:4] == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(small_docs)


def test_files_odd_rows_and_single_documents(spark, odd_docs, no_docs, tmp_dir):
    tokens = token_files.Tokens(BYTES)
    token_files.write(odd_docs, tmp_dir + "/t", tokens)
    rows = sorted(token_files.read(spark, tmp_dir + "/t", with_ids=True).collect(), key=lambda r: r["start"])
    assert len(rows) == odd_docs.count()
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in odd_docs.collect()), key=lambda i: -1 if i is None else i)
    starts = np.cumsum([0] + [r["n_tokens"] for r in rows]).tolist()
    assert [r["start"] for r in rows] == starts[:-1] and all(r["n_tokens"] == len(r["ids"]) for r in rows)
    assert token_files.ids_of(spark, tmp_dir + "/t", 2) == [[0]] and len(token_files.ids_of(spark, tmp_dir + "/t", 5)) == 3
    assert token_files.ids_of(spark, tmp_dir + "/t", 99) == []
    token_files.write(no_docs, tmp_dir + "/none", tokens)
    assert token_files.read(spark, tmp_dir + "/none").count() == 0


def test_files_know_their_dictionary(spark, tmp_dir):
    path = tmp_dir + "/t"
    token_files.write(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), path, token_files.Tokens(BYTES))
    row = spark.read.parquet(path + "/dictionary").first()
    assert len(row["dictionary"]) > 1024 and hashlib.sha256(bytes(row["dictionary"])).hexdigest() == row["dictionary_hash"]
    spark.createDataFrame([("wrong", bytearray(row["dictionary"]), row["width"], row["tokenizer"])],
                          "dictionary_hash string, dictionary binary, width int, tokenizer string").write.mode("overwrite").parquet(path + "/dictionary")
    with pytest.raises(ValueError):
        token_files.read(spark, path)


# ----------------------------------------------------------------- packing

def placed(plan: list[packing.Run], capacity: int) -> dict[int, list[tuple[int, int]]]:
    """Sequence -> (offset, length), all checks of a plan on the way."""
    following: dict[int, int] = {}
    sequences: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(plan, key=lambda r: (r.length, r.first)):
        assert r.first == following.get(r.length, 0)
        following[r.length] = r.first + r.count
        for i in range(r.count):
            sequences.setdefault(r.sequence + i // r.each, []).append((r.offset + i % r.each * r.length, r.length))
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= capacity
    return sequences


@pytest.mark.parametrize("seed", range(60))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(1, 80))
    histogram = Counter(rng.integers(1, capacity + 1, int(rng.integers(0, 120))).tolist())
    sequences = placed(packing.pack_plan(histogram, capacity), capacity)
    assert Counter(n for s in sequences.values() for _, n in s) == histogram


def best_fit_decreasing(lengths: list[int], capacity: int) -> int:
    import bisect

    spaces, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(spaces, x)
        free = spaces.pop(i) if i < len(spaces) else capacity
        n += free == capacity
        bisect.insort(spaces, free - x)
    return n


@pytest.mark.parametrize("low,high", [(1, 4096), (1000, 2100), (1, 600), (300, 3000)])
def test_plan_needs_few_sequences(low, high):
    lengths = np.random.default_rng(low).integers(low, high, 6000).tolist()
    n = len(placed(packing.pack_plan(Counter(lengths), 4096), 4096))
    assert n <= 1.01 * best_fit_decreasing(lengths, 4096) + 1


def check_packed(rows, texts: list[tuple], library: Tokenizer, capacity: int = 4096) -> int:
    want = Counter()
    for doc_id, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, i in enumerate(range(0, len(ids), capacity)):
            part = ids[i:i + capacity]
            want[doc_id, k, i, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        ends = np.cumsum([n for _, n in sorted(s)])
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1].tolist()] and ends[-1] <= capacity
    return len(sequences)


def test_op10_rows(spark, small_docs):
    rows = queries.op10_packing(spark, SF_SMALL).collect()
    n = check_packed(rows, list(zip(small_docs.doc_id, small_docs.text)), Tokenizer.from_file(WORDS))
    assert n <= best_fit_decreasing([r["length"] for r in rows], 4096) + 1


def test_pack_odd_rows(spark, odd_docs, no_docs):
    rows = packing.pack(odd_docs, WORDS, capacity=64).collect()
    check_packed(rows, [(r["doc_id"], r["text"]) for r in odd_docs.collect()], Tokenizer.from_file(WORDS), 64)
    assert packing.pack(no_docs, WORDS).count() == 0


def test_ids_are_as_wide_as_the_vocabulary_needs(monkeypatch):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    assert token_files.Tokens(path).width == 2 and token_files.Tokens(path, end_id=1 << 16).width == 4
    assert token_files.width_of(65_535) == 2 and token_files.width_of(65_536) == 4
    monkeypatch.setattr(token_files, "greatest_id", lambda _: 70_000)
    wide = token_files.Tokens(path)
    assert wide.width == 4 and len(wide.serialized("a b")) % 4 == 0 and token_files.Tokens(path, width=2).width == 2
