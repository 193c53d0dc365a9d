import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from cases import ROWS, SF_DIR, empty, frame
from tokenizers import Tokenizer

from tidemark.llm.bpe import Encoder, SuffixAutomaton, decode, encode
from tidemark.llm.queries import token_ids

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def bpe():
    return Encoder(open(PATH, encoding="utf-8").read())


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


LETTERS = ["a", "b", "ab", "the", "é", "é", "́", "İ", "Σ", "ς", " ", "　", "\xa0", "\x1c", "\x85", "\n", "\t", "\x00", "漢", "1", "²"]
LETTERS += ["'s", "'LL", "'", "--", "_", "###", "<|endoftext|>", "<|startoftext|>", "<|End", "Å", "ﬁ", "\U0001f600", "​", "ǅ", "ß"]


def test_random_texts(bpe, library):
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(20)))
        assert ids_of(bpe.encode(text.encode())) == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("letters", ["ab", "a", "thein", "aeiou-"])
def test_long_words(bpe, library, letters):
    rng = random.Random(2)
    for length in (1, 2, 3, 7, 100, 5001):
        text = "".join(rng.choice(letters) for _ in range(length))
        assert ids_of(bpe.encode(text.encode())) == library.encode(text, add_special_tokens=False).ids


def test_last_token_of_every_prefix(bpe):
    """Brute force over the merges: a word is merged pair by pair, the oldest merge and the leftmost first."""
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choice("thearing") for _ in range(rng.randrange(1, 14)))
        parts = [*word[:-1], word[-1] + "</w>"]
        while len(parts) > 1:
            ranks = [(bpe.rank.get((bpe.vocab[a], bpe.vocab[b]), 1 << 40), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, k = min(ranks)
            if rank == 1 << 40:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert bpe.encode_word(word) == [bpe.vocab[p] for p in parts]


def test_automaton():
    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(60)} | {"a", "b", "c"}
    numbered = {w: k for k, w in enumerate(sorted(words))}
    auto = SuffixAutomaton(numbered)
    for word in words:
        state = 0
        for letter in word:
            state = auto.next[state][letter]
        found = {n for size, n in auto.ends(state) if size <= len(word)}
        assert found == {n for w, n in numbered.items() if word.endswith(w)}


def test_cases(spark, library):
    docs = frame(spark, clash=("ids", "decoded"))
    encoded = encode(docs, PATH)
    assert encoded.columns == ["doc_id", "text", "ids", "decoded", "_ids", "n_tokens"]
    got = decode(encoded, PATH, ids="_ids").collect()
    assert len(got) == len(ROWS)
    for row, (doc, text) in zip(got, ROWS):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert (row["doc_id"], row["ids"], row["decoded"]) == (doc, "own", "own")
        assert (ids_of(row["_ids"]), row["n_tokens"]) == (want, len(want))
        assert row["_decoded"] == library.decode(want, skip_special_tokens=False)
    assert decode(encode(empty(spark), PATH), PATH).count() == 0


def test_refused():
    content = open(PATH, encoding="utf-8").read()
    with pytest.raises(ValueError):
        Encoder(content.replace('"dropout":null', '"dropout":0.5').replace('"dropout": null', '"dropout": 0.5'))


def test_query(spark, library):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    want = set()
    for row in docs:
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        texts = (np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False).encode())
        want.add((row["doc_id"], len(ids), *(hashlib.sha256(t).hexdigest() for t in texts)))
    got = token_ids(spark, SF_DIR)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert set(map(tuple, got.collect())) == want
