from __future__ import annotations

import bisect
import zlib

import numpy as np
import pytest
from edges import edge_docs, edge_rows, empty_docs, multiset, pairs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftmark.llm.packing import best_fit_runs, pack_documents
from weftmark.llm.queries import QUERIES, tokenizer_file
from weftmark.llm.token_files import BLOCK_TOKENS, id_width, pack, read_tokens, token_digests, unpack, unpack_range, write_token_files
from weftmark.llm.tokenizing import PieceEncoder
from weftmark.session import workspace


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(tokenizer_file())
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def crc(ids):
    return zlib.crc32(ids.tobytes())


@given(st.lists(st.text(alphabet="ab \n\t.,'Ä1 \x1f <|endoftext|>", max_size=40), max_size=6), st.integers(0, 3))
@settings(max_examples=150, deadline=None)
def test_pieces_give_the_ids_of_whole_texts(texts, memo):
    coder = PieceEncoder(tokenizer_file(), memo=memo)
    for _ in range(2):
        ids, counts = coder.encode(texts)
        want = [coder.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert ids.tolist() == [x for w in want for x in w]
        assert counts.tolist() == list(map(len, want))


@pytest.mark.parametrize("texts", [["a \0b"], ["\0a b"], ["\0"], ["a \0b", "b", "\0b c", "a b"], ["a\0b \0", "x\n\0y"]])
def test_nul_is_no_mark_of_a_first_piece(plain, texts):
    coder = PieceEncoder(tokenizer_file())
    for _ in range(2):
        ids, counts = coder.encode(texts)
        want = [plain(t).tolist() for t in texts]
        assert ids.tolist() == [x for w in want for x in w]
        assert counts.tolist() == list(map(len, want))


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=70))
@settings(deadline=None)
def test_packing_bits_is_undone(width, values):
    ids = np.array(values, np.uint32) & np.uint32((1 << width) - 1)
    data = pack(ids, width)
    assert len(data) == -(-len(ids) * width // 8)
    assert unpack(data, width, len(ids)).tolist() == ids.tolist()


@pytest.mark.parametrize("width", [11, 16, 17])
def test_single_blocks_are_unpacked(width):
    ids = np.random.default_rng(1).integers(0, 1 << width, 5 * BLOCK_TOKENS + 77).astype(np.uint32)
    data = pack(ids, width)
    offsets = list(range(0, len(data), BLOCK_TOKENS * width // 8))
    for start, count in ((0, 1), (1000, 60), (BLOCK_TOKENS, BLOCK_TOKENS), (4000, 1197), (17, 0)):
        assert unpack_range(data, offsets, width, start, count).tolist() == ids[start : start + count].tolist()


def test_width_is_the_fewest_bits():
    assert [id_width(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_token_files_of_edge_documents(spark, plain):
    path = workspace(spark, "test-tokens")
    write_token_files(edge_docs(spark), path, tokenizer_file())
    want, start = [], 0
    for doc, text in pairs(edge_rows()):
        ids = plain(text)
        want.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert multiset(tuple(r) for r in token_digests(spark, path).collect()) == multiset(want)
    some = read_tokens(spark, path, [6, 10, 99]).collect()
    rows = {r["doc_id"]: r["ids"] for r in some}
    assert set(rows) == {6, 10}
    for doc, text in pairs(edge_rows()):
        if doc in rows:
            assert rows[doc] == plain(text).tolist()
    assert read_tokens(spark, path, []).count() == 0
    assert read_tokens(spark, path).count() == len(edge_rows())


def test_token_files_of_no_documents(spark):
    path = workspace(spark, "test-tokens")
    write_token_files(empty_docs(spark), path, tokenizer_file())
    assert token_digests(spark, path).count() == 0
    assert pack_documents(empty_docs(spark), tokenizer_file()).count() == 0


def test_op1_equals_encoding_one_by_one(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want, start = [], 0
    for doc, text in docs:
        ids = plain(text)
        want.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    got = QUERIES["op1_token_files"](spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == want


def best_fit_decreasing(lengths, capacity):
    """Rooms of all sequences, piece after piece."""
    rooms = []
    full = 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, length)
        room = rooms.pop(at) if at < len(rooms) else capacity
        if room > length:
            bisect.insort(rooms, room - length)
        else:
            full += 1
    return sorted(rooms + [0] * full)


@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
@settings(max_examples=300, deadline=None)
def test_runs_are_best_fit_decreasing(case):
    capacity, lengths = case
    counts = {n: lengths.count(n) for n in set(lengths)}
    filled: dict[int, int] = {}
    runs = best_fit_runs(counts, capacity)
    for i, (length, first, sequence, offset, each) in enumerate(runs):
        # the runs of a length follow each other
        last = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == length else counts[length]
        for k in range(last - first):
            at = sequence + k // each
            assert filled.get(at, 0) == offset + k % each * length
            filled[at] = filled.get(at, 0) + length
    assert sum(filled.values()) == sum(lengths)
    assert sorted(capacity - f for f in filled.values()) == best_fit_decreasing(lengths, capacity)


def check_packed(rows, docs, plain, capacity=1024):
    """Pieces tile their documents, sequences are gapless, and there are as many as best fit decreasing makes."""
    by_sequence: dict[int, list] = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    want = []
    for doc, text in docs:
        ids = plain(text)
        n = len(ids)
        cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
        want += [(doc, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert multiset(got) == multiset(want)
    assert len(by_sequence) == len(best_fit_decreasing([w[3] for w in want], capacity))


def test_edge_documents_are_packed(spark, plain):
    check_packed(pack_documents(edge_docs(spark), tokenizer_file()).collect(), pairs(edge_rows()), plain)


def test_op10_is_best_fit_decreasing(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check_packed(QUERIES["op10_best_fit_packing"](spark, sf_dir).collect(), docs, plain)
