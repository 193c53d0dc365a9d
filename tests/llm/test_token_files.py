import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import public_tokenizers
import pytest
from cases import LONG, ROWS, SF_DIR, empty, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.queries import QUERIES
from tidemark.llm.token_files import Encoder, SequenceFile, filesystem, read_documents, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [1]


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for doc, text in order:
        ids = ids_of(text)
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def result(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[1])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85\xa0'sdt́e가<|>")), max_size=60))
def test_words_encode_as_the_whole(text):
    encoder = Encoder(PATH, by_word=True)
    assert encoder.encode([text.encode()])[0] == WHOLE.encode(text, add_special_tokens=False).ids


def test_special_tokens_and_memo():
    texts = ["<|endoftext|> a<|startoftext|>b", "Don't we'll x'S", "a a b"]
    encoder = Encoder(PATH, by_word=True)
    for _ in range(2):
        assert encoder.encode([t.encode() for t in texts]) == [ids_of(t)[:-1] for t in texts]


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op4_token_files"](spark, SF_DIR)) == brute(rows)


@pytest.mark.parametrize("by_word", [False, True])
def test_cases(spark, by_word):
    docs = frame(spark, clash=("shard", "start", "n_tokens", "tie"))
    files = write_token_files(docs, PATH, end_id=1, by_word=by_word, vocabulary=49_408, length=64, batch_rows=3)
    got = result(read_documents(spark, files))
    # Rows of one id follow each other in the order of their texts' hashes.
    want = brute(ROWS)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sorted((r[0] or -1, r[2], r[3]) for r in got) == sorted((r[0] or -1, r[2], r[3]) for r in want)
    sizes = [r[2] for r in got]
    assert [r[1] for r in got] == [sum(sizes[:k]) for k in range(len(sizes))]


def test_many_steps_in_a_batch(spark):
    rows = [(i, LONG) for i in range(40)]
    files = write_token_files(frame(spark, rows).coalesce(1), PATH, end_id=1, by_word=True, vocabulary=49_408)
    got = result(read_documents(spark, files))
    size = len(ids_of(LONG))
    assert [(r[0], r[1], r[2]) for r in got] == [(i, i * size, size) for i in range(40)]


def test_empty(spark):
    files = write_token_files(empty(spark), PATH, end_id=1)
    assert files.manifest.count() == 0
    assert read_documents(spark, files).count() == 0


@pytest.mark.parametrize(("vocabulary", "kind"), [(49_408, np.uint16), (1 << 20, np.uint32)])
def test_random_access(spark, vocabulary, kind):
    rows = [(i, "word " * (i % 40)) for i in range(200)]
    docs = frame(spark, rows).coalesce(1)
    files = write_token_files(docs, PATH, end_id=1, vocabulary=vocabulary, length=32, batch_rows=5)
    fs, root = filesystem(files.folder)
    for shard in files.manifest.collect():
        want = [i for doc, text in rows for i in ids_of(text)]
        path = f"{root}/tokens-{shard['shard']:06d}.arrow"
        file = SequenceFile(fs, path)
        start = shard["start"]
        for k in range(shard["n_sequences"]):
            ids, mask = file.sequence(k)
            real = min(32, shard["n_tokens"] - 32 * k)
            assert ids.dtype == kind and len(ids) == 32 and not ids.flags.owndata
            assert mask.to_pylist() == [True] * real + [False] * (32 - real)
            assert ids[:real].tolist() == want[start + 32 * k : start + 32 * k + real]
        assert file.tokens(7, 400).tolist() == want[start + 7 : start + 407]
        before = pa.total_allocated_bytes()
        view, _ = file.sequence(3)
        assert pa.total_allocated_bytes() == before  # read in place
        assert isinstance(fs, pafs.LocalFileSystem)
