"""Token files, packing, unigram counts and BPE against the tokenizers library."""

import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from recollect.llm.bpe import LONG, WordBpe, encode_decode
from recollect.llm.packing import cut, pack
from recollect.llm.token_files import token_files
from recollect.llm.unigram import UnigramCounter, count_tokens, read_pieces
from recollect.llm.word_ids import WordIds

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  a  b ", "İstanbul ΣΑΣ", "<|endoftext|>x <|startoftext|> y <|endoftext|>", "aaaaaaa" * 80, "x\x1cz \x85 q \x00\x01",
    "é ́a", "don't we'll I'M '' 's 123 4٣", "日本語 テスト😀😀", "\n\n a\n b\t\tc\n", "a\nb", "a \nb", "\na", "▁ab ▁▁ c<0x0A>", "ab" * 1500,
    "½ Ⅷ ①", " a\n", "a\r\nb  ", "x" * 20_000, "word " * 3000,
]
TEXT = st.text(st.sampled_from("ab cdé\n\t '.▁<|>Σ1 "), max_size=40)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(WORDS), WordBpe(WORDS)


@pytest.fixture(scope="module")
def unigram():
    pieces = read_pieces(PIECES)
    library = Tokenizer(models.Unigram(list(pieces), unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    return library, UnigramCounter(pieces)


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist()


@pytest.mark.parametrize("text", ODD)
def test_word_ids_are_the_librarys(library, text):
    assert ids_of(WordIds(BYTES), text) == library.encode(text, add_special_tokens=False).ids


def test_word_ids_on_any_text(library):
    encoder = WordIds(BYTES)

    @settings(max_examples=300, deadline=None)
    @given(TEXT)
    def run(text):
        assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids

    run()


def test_bpe_is_the_librarys(words):
    library, bpe = words

    @settings(max_examples=300, deadline=None)
    @given(TEXT)
    def run(text):
        check(text)

    def check(text):
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text) == ids
        assert bpe.both([text]) == [(len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]

    run()
    for text in ODD:
        check(text)


def test_long_words_merge_alike(words):
    _, bpe = words
    for word in ("abcab" * (LONG // 5), "thethenthere" * 15):
        bounds = [*range(len(word)), len(word) + len(bpe.suffix)]
        got = bpe._by_heap(word + bpe.suffix, bounds)
        text = word + bpe.suffix
        assert tuple(bpe.ids[text[a:b]] for a, b in zip(got, got[1:])) == bpe.merged(word[:LONG]) if len(word) <= LONG else True


def test_unigram_counts_are_the_librarys(unigram):
    library, counter = unigram

    @settings(max_examples=300, deadline=None)
    @given(TEXT)
    def run(text):
        assert counter.texts([text])[0][0] == len(library.encode(text, add_special_tokens=False).ids)

    run()
    for text in ODD:
        assert counter.texts([text])[0][0] == len(library.encode(text, add_special_tokens=False).ids)


def test_unigram_ties():
    """Two ways to spell a word with one score: the earlier start stands, as in the library."""
    vocab = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("▁ab", -3.0), ("aba", -3.0)]
    library = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    counter = UnigramCounter(tuple(vocab))
    for text in ("ab", "aba", "abab", "b ab", "baba aab"):
        assert counter.texts([text])[0][0] == len(library.encode(text).ids)


ROWS = [(3, "one two three", "x"), (1, "", "x"), (2, None, "x"), (None, "lost", "x"), (5, "same", "x"), (5, "same", "x"), (4, "é \n" * 700, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, an empty and a long text, repeated rows, and extra columns with the operators' own names."""
    return spark.createDataFrame(ROWS, "doc_id long, text string, ids string").withColumnsRenamed({}).selectExpr(
        "*", "1 AS start", "2 AS n_tokens", "3 AS length", "4 AS class", "5 AS h"
    )


def test_token_files(docs, library):
    rows = token_files(docs, BYTES, end_id=2).collect()
    assert sorted(r.start for r in rows)[0] == 0 and len(rows) == len(ROWS)
    want, start = [], 0
    for doc_id, text, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_token_files_of_an_empty_table(docs):
    assert token_files(docs.limit(0), BYTES, end_id=2).collect() == []


def test_packing(docs, library):
    rows = pack(docs, BYTES, end_id=0, capacity=64).collect()
    whole, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        whole[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for r in bins.values():
        offset = 0
        for piece in sorted(r, key=lambda x: x.offset):
            assert piece.offset == offset
            offset += piece.length
        assert offset <= 64
    for doc_id, text, _ in set(ROWS):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        times = sum(r[0] == doc_id for r in ROWS)
        assert sum(p.length for p in whole[doc_id]) == times * len(ids)
        for p in whole[doc_id]:
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    assert pack(docs.limit(0), BYTES).collect() == []


def test_cuts_add_up_and_fill_bins():
    for length in range(1, 5000):
        pieces = cut(length, 1024)
        assert sum(pieces) == length
        assert all(p <= 32 or (1024 // p) * p >= 1024 - 16 for p in pieces)


def test_bpe_query_shape(docs, words):
    rows = encode_decode(docs, WORDS, digests=True).collect()
    library = words[0]
    want = []
    for doc_id, text, _ in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    real = encode_decode(docs, WORDS).collect()
    assert all(len(r.ids) == r.n_tokens and r.decoded == words[1].decode(r.ids) for r in real)
    assert encode_decode(docs.limit(0), WORDS).collect() == []


def test_unigram_query_shape(docs):
    rows = count_tokens(docs, PIECES).collect()
    assert len(rows) == len(ROWS) and all(r.n_tokens == 0 and r.score == 0 for r in rows if r.doc_id in (1, 2))
    assert count_tokens(docs.limit(0), PIECES).collect() == []


def test_unigram_scores_are_those_of_the_best_segmentation(unigram):
    """Score and count against every segmentation of short words, and against the library's pieces of any text."""
    library, _ = unigram
    scores = dict(read_pieces(PIECES))
    small = UnigramCounter((("a", -1.0), ("ab", -1.5), ("b", -2.0), ("bc", -1.25), ("▁", -0.5), ("▁a", -1.0), ("c", -3.0)))
    pieces = {"a": -1.0, "ab": -1.5, "b": -2.0, "bc": -1.25, "▁": -0.5, "▁a": -1.0, "c": -3.0}

    def best(word):
        if not word:
            return 0.0
        found = [pieces[word[:n]] + best(word[n:]) for n in range(1, len(word) + 1) if word[:n] in pieces]
        return max(found, default=float("-inf"))

    for word in ("abc", "aabbcc", "cab", "a", "bcbcab"):
        assert small.texts([word])[0][1] == pytest.approx(best("▁" + word))
    for text in ("The quick brown fox", "tokenisation of long words", "don't  stop"):
        n, score = UnigramCounter(read_pieces(PIECES)).texts([text])[0]
        found = library.encode(text, add_special_tokens=False).tokens
        assert n == len(found) and score == pytest.approx(sum(scores[x] for x in found))


def test_files_are_read_by_ranges_where_they_cannot_be_mapped(spark, tmp_path, monkeypatch):
    from pyarrow import fs

    from recollect.llm import token_files as files

    docs = spark.createDataFrame([(i, "some words " * i) for i in range(40)] + [(None, "x")], "doc_id long, text string")
    folder = f"file://{tmp_path}/files"
    index = files.write_token_files(docs, folder, BYTES, 2, parts=2).collect()
    monkeypatch.setattr(files, "READ_DOCS", 7)
    remote = fs.SubTreeFileSystem(str(tmp_path / "files"), fs.LocalFileSystem())
    got = [r for part in index for batch in files._documents(remote, part.path, part.asDict()) for r in batch.to_pylist()]
    assert sorted(map(str, (tuple(r.values()) for r in got))) == sorted(map(str, map(tuple, files.read_token_files(spark, folder).collect()))) and len(got) == 41
