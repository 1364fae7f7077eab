"""Files of token ids: exact round trips, random access, and the encoder against the tokenizer."""

import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pneumaspark.llm import token_files
from pneumaspark.llm.token_files import ByteEncoder, FileReader, FileWriter, decode_block, encode_block

SF = "/root/testdata/sf0.001"
ids_of_any_size = st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**32 - 1), st.integers(2**59, 2**64 - 1)), max_size=300)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.integers(0, 2), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), st.sampled_from([1, 1, 2, 60, 61, 130])), max_size=40))
def test_blocks_come_back(runs):
    ids = np.array([v for v, n in runs for _ in range(n)], np.uint64)
    words, escapes = encode_block(ids)
    assert np.array_equal(decode_block(words, escapes, len(ids)), ids)
    assert len(words) <= max(1, len(ids)) and len(escapes) == (ids >= 2**60).sum()


def test_words_are_full():
    assert len(encode_block(np.full(120, 40_000, np.uint64))[0]) == 1  # a run
    assert len(encode_block(np.arange(40_000, 40_120, dtype=np.uint64))[0]) == 40  # three of twenty bits
    assert len(encode_block(np.tile(np.arange(2, dtype=np.uint64), 60))[0]) == 2  # sixty of one bit
    narrow_then_wide = np.array([1] * 15 + [30_000] * 4, np.uint64)
    assert len(encode_block(narrow_then_wide)[0]) == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(ids_of_any_size, max_size=12), st.sampled_from([1, 7, 64]), st.data())
def test_files_give_any_range(docs, block, data):
    out = pa.BufferOutputStream()
    writer = FileWriter(out, block)
    for k, d in enumerate(docs):
        writer.add([None if k % 3 == 2 else k], [np.array(d, np.uint64)])
    writer.close()
    file = FileReader(pa.BufferReader(out.getvalue()))
    flat = list(itertools.chain(*docs))
    a = data.draw(st.integers(0, len(flat)))
    b = data.draw(st.integers(a, len(flat)))
    assert file.ids(a, b).tolist() == flat[a:b] and file.n_ids == len(flat)
    assert file.docs["n"].tolist() == [len(d) for d in docs] and file.docs["known"].tolist() == [k % 3 != 2 for k in range(len(docs))]


def test_a_file_cut_short_is_refused():
    out = pa.BufferOutputStream()
    writer = FileWriter(out)
    writer.add([1], [np.arange(100, dtype=np.uint64)])
    writer.close()
    with pytest.raises(ValueError):
        FileReader(pa.BufferReader(out.getvalue().to_pybytes()[:-8]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "Zé", " ", " ", "\n", "\n", "\t", "\r", "\xa0", "　", "\x1c", " ", "日", "don't", "'s", "12", ".", ",", "<|endoftext|>", "\x00", "²", "ß", "ŉ", "​", "️", "🙂"]), max_size=14).map("".join))
def test_pieces_give_the_tokenizers_ids(text):
    encoder = ByteEncoder.of()
    want = np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert encoder.encode(text.encode()) == want == encoder.encode(text.encode()) and encoder.encode(None) == b""


def test_words_before_punctuation_are_tokenized_once():
    import public_tokenizers

    encoder = ByteEncoder(public_tokenizers.path(token_files.TOKENIZER))
    asked, tokenize = [], encoder.tokenize
    encoder.tokenize = lambda item: asked.append(item) or tokenize(item)
    for text in (b"A mending mending, mending. mending!!", "né né. né,%% don't. don't, x'. 9. €. . 你好. \"né\"".encode()):
        assert encoder.encode(text) == encoder.whole(text)
    assert asked.count("\u0120mending") == 1
    assert asked.count("\u0120n\u00c3\u00a9") == 1


def brute(rows):
    encoder = ByteEncoder.of()
    out, start = [], 0
    for i, text in rows:
        ids = [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def report(df):
    return sorted((tuple(r) for r in token_files.token_report(df).collect()), key=lambda r: r[1])


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
def test_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert report(df.repartition(7)) == brute(sorted((r.doc_id, r.text) for r in df.collect()))


def test_odd_rows(spark):
    rows = [(None, "lost"), (1, None), (2, ""), (3, " \n\t "), (4, "x " * 200_000 + "end"), (5, "a <|endoftext|> b"), *[(9, "same")] * 40, (8, "É é\n\nz")]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, start int, ids string").repartition(6)
    assert report(df) == brute(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert report(df.limit(0)) == []


def test_small_tasks_and_leftovers_of_failed_attempts(spark, tmp_path):
    rows = [(k, f"text of {k} " * (k % 5)) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = f"file://{tmp_path}/ids"
    token_files.write_tokens(df, path, block=64)
    (tmp_path / "ids" / "part-000000-leftover.ids").write_bytes(b"half a file")
    got = token_files.read_tokens(spark, path, task_ids=100)
    assert got.rdd.getNumPartitions() > 10
    back = sorted((r.start, r.doc_id, len(r.ids) // 4, zlib.crc32(r.ids)) for r in got.collect())
    assert [(i, s, n, c) for s, i, n, c in back] == brute(rows)
