"""Byte-pair encoding by the last token of every prefix, and decoding.

A word of ``n`` symbols has a table of ``n`` entries: the last token of the encoding of
each prefix.  That token is unique, and an encoding without its last token is the
encoding of the shorter prefix.  So the entry of a prefix is the one vocabulary token
that ends there and fits behind the entry of what is before it.  Which tokens end at a
symbol comes from a suffix automaton of the vocabulary; whether two tokens fit is a test
on the two alone.  Back-pointers from the whole word give the ids.

Texts are cut at ASCII white space first; normalising and splitting into words, which
are settings of the tokenizer file and no part of the encoding, are asked of the
``tokenizers`` library for each piece that is not plain Latin letters and punctuation.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.rows import appended, fresh, schema_with, steps

#: Pieces and token pairs that a worker remembers; beyond, it starts anew.
MEMO = 1 << 19
#: Bytes of the longest piece that is remembered.
MEMO_BYTES = 64
#: A word's last symbol is told apart from the same letter inside a word.
_FINAL = 0x10000
NEVER = 1 << 40
#: Latin letters whose small letter is one letter, then ASCII punctuation (no quotes, which may bind letters): two words.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!#$%&()*+,\-./:;=?@\[\\\]^_{|}~]*)")

#: How the word tokenizer cuts words (a fixed value of its file).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class SuffixAutomaton:
    """Every substring of the given words; ``ends`` tells which words end a read text."""

    def __init__(self, words: dict[str, int]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = array("i", [-1]), array("i", [0])
        at: dict[int, list[tuple[int, int]]] = {}
        for word, number in words.items():
            state = 0
            for letter in word:
                state = self._extend(state, letter)
        # A state may be split by later words, so words are looked up at the end.
        for word, number in words.items():
            state = 0
            for letter in word:
                state = self.next[state][letter]
            at.setdefault(state, []).append((len(word), number))
        self._own = {state: tuple(sorted(found, reverse=True)) for state, found in at.items()}
        self._ends: dict[int, tuple[tuple[int, int], ...]] = {0: ()}

    def _state(self, edges: dict[str, int], link: int, size: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.size.append(size)
        return len(self.next) - 1

    def _split(self, parent: int, letter: str) -> int:
        """The target of ``letter``, as a state whose longest text is the parent's and ``letter``."""
        target = self.next[parent][letter]
        if self.size[target] == self.size[parent] + 1:
            return target
        copy = self._state(dict(self.next[target]), self.link[target], self.size[parent] + 1)
        self.link[target] = copy
        while parent >= 0 and self.next[parent].get(letter) == target:
            self.next[parent][letter] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, letter: str) -> int:
        if letter in self.next[last]:
            return self._split(last, letter)
        new, parent = self._state({}, 0, self.size[last] + 1), last
        while parent >= 0 and letter not in self.next[parent]:
            self.next[parent][letter] = new
            parent = self.link[parent]
        if parent >= 0:
            self.link[new] = self._split(parent, letter)
        return new

    def ends(self, state: int) -> tuple[tuple[int, int], ...]:
        """``(length, word)`` of all words that end the longest text of a state, longest first."""
        path = []
        while state not in self._ends:
            path.append(state)
            state = self.link[state]
        found = self._ends[state]
        for state in reversed(path):
            found = self._own.get(state, ()) + found
            self._ends[state] = found
        return found


class Encoder:
    """One tokenizer file (a BPE model with byte letters); ``encode`` gives what the library gives.

    Not supported, and refused: dropout, unknown tokens, continuing prefixes, byte fallback, special
    tokens that match normalised text or take blanks along, and merges older than their parts.
    """

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_str(content)
        self._library.no_truncation()
        self._library.no_padding()
        setting = json.loads(content)
        model = setting["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("this BPE model has settings that are not supported")
        self.special = {t["content"]: t["id"] for t in setting["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in setting["added_tokens"]):
            raise ValueError("special tokens must match raw text as it is")
        parts = sorted(self.special, key=len, reverse=True)
        self._cut = re.compile("(" + "|".join(map(re.escape, parts)) + ")") if parts else None
        # Plain pieces are split here only under the settings that this was written for.
        kinds = [n["type"] for n in (setting["normalizer"] or {}).get("normalizers", [])]
        end = model.get("end_of_word_suffix") or ""
        split = ((setting["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        words = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
        self._plain = kinds == ["NFC", "Replace", "Lowercase"] and split == words
        self.end = end
        vocab: dict[str, int] = model["vocab"]
        self.vocab = vocab
        self.tokens: list[str] = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for table in (vocab, self.special):
            for token, number in table.items():
                self.tokens[number] = token
        self._merges(model["merges"])
        symbols = {self.symbols(t): i for t, i in vocab.items() if i in self.made}
        self.automaton = SuffixAutomaton({s: i for s, i in symbols.items() if s and self._reached(i)})
        self._fits: dict[int, bool] = {}
        #: Ids of pieces (bytes) and of words in byte letters (text).
        self.memo: dict[bytes | str, bytes] = {}

    def symbols(self, token: str) -> str:
        """A token as one letter for each symbol: the end mark and the letter before it are one."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return body[:-1] + chr(ord(body[-1]) + _FINAL)
        return token

    def _merges(self, merges: list) -> None:
        self.rank: dict[tuple[int, int], int] = {}
        #: When a token is made; single symbols are there from the start.
        self.made = {i: -1 for t, i in self.vocab.items() if len(self.symbols(t)) == 1}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = (self.vocab[left], self.vocab[right])
            whole = self.vocab[left + right]
            if whole in self.made or not all(p in self.made for p in pair):
                raise ValueError("a merge is older than its parts or makes a token twice")
            self.rank[pair], self.made[whole], self.halves[whole] = rank, rank, pair

    def _border(self, left: int, right: int) -> tuple[int, int]:
        """The first two tokens that merge across the border of two texts, or the texts' own tokens.

        Walks in the order of merges: the pieces next to the border grow into ``left`` and ``right``.
        """
        before, after = [left], [right]
        while before[-1] in self.halves:
            before.append(self.halves[before[-1]][1])
        while after[-1] in self.halves:
            after.append(self.halves[after[-1]][0])
        while True:
            a, b = before[-1], after[-1]
            grows = self.made[before[-2]] if len(before) > 1 else NEVER
            taken = self.made[after[-2]] if len(after) > 1 else NEVER
            rank = self.rank.get((a, b), NEVER)
            # Of equal pairs the left one merges first, so the border wins against the right only.
            if rank < grows and rank <= taken:
                return a, b
            if grows == taken == NEVER:
                return left, right
            (before if grows <= taken else after).pop()

    def _reached(self, token: int) -> bool:
        """A token whose own text is encoded as that token."""
        return token not in self.halves or self._border(*self.halves[token]) == self.halves[token]

    def fits(self, left: int, right: int) -> bool:
        """The texts of two tokens, one behind the other, are encoded as these two tokens."""
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= MEMO:
                self._fits.clear()
            # What merges across the border at last must not be the two themselves either.
            known = self._fits[key] = self._border(left, right) == (left, right) and (left, right) not in self.rank
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word in byte letters."""
        if not word:
            return []
        symbols = word[:-1] + chr(ord(word[-1]) + _FINAL) if self.end else word
        auto, fits, fitting = self.automaton, self.fits, self._fits
        edges, links, sizes, known = auto.next, auto.link, auto.size, auto._ends
        last, back = [0] * (len(symbols) + 1), [0] * (len(symbols) + 1)
        state = length = 0
        for i, symbol in enumerate(symbols, 1):
            while state and symbol not in edges[state]:
                state = links[state]
                length = sizes[state]
            state = edges[state][symbol]
            length += 1
            for size, token in known.get(state) or auto.ends(state):
                if size > length:
                    continue
                if size < i:
                    fit = fitting.get(last[i - size] << 32 | token)
                    if not (fits(last[i - size], token) if fit is None else fit):
                        continue
                last[i], back[i] = token, size
                break
        out, at = [], len(symbols)
        while at:
            out.append(last[at])
            at -= back[at]
        return out[::-1]

    def encode_piece(self, piece: bytes) -> bytes:
        """Ids (little-endian, 32 bits) of a text without ASCII white space."""
        known = self.memo.get(piece)
        if known is not None:
            return known
        text = piece.decode()
        plain = PLAIN.fullmatch(text) if self._plain else None
        if plain is None:
            out = b"".join(self._parts(text))
        elif plain[2]:
            out = self.encode_piece(plain[1].lower().encode()) + self.encode_piece(plain[2].encode())
        elif text != (small := text.lower()):
            out = self.encode_piece(small.encode())
        else:
            return self._word(piece, piece.decode("latin-1").translate(_BYTE_LETTERS))
        return self._remember(piece, out)

    def _remember(self, key: bytes | str, ids: bytes) -> bytes:
        if len(key) <= MEMO_BYTES:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[key] = ids
        return ids

    def _word(self, key: bytes | str, word: str) -> bytes:
        known = self.memo.get(key)
        return self._remember(key, np.array(self.encode_word(word), "<u4").tobytes()) if known is None else known

    def _parts(self, text: str) -> Iterator[bytes]:
        for k, part in enumerate(self._cut.split(text) if self._cut else [text]):
            if k % 2:
                yield self.special[part].to_bytes(4, "little")
            elif part:
                normal = self._library.normalizer.normalize_str(part) if self._library.normalizer else part
                for word, _ in self._library.pre_tokenizer.pre_tokenize_str(normal):
                    yield self._word(word, word)

    def encode(self, text: bytes) -> bytes:
        """Ids (little-endian, 32 bits) of a whole UTF-8 text."""
        pieces = text.split()
        known = list(map(self.memo.get, pieces))
        if None in known:
            known = [self.encode_piece(p) if k is None else k for p, k in zip(pieces, known)]
        return b"".join(known)


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: visible Latin-1 for itself, the others from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return {b: b if b in visible else next(hidden) for b in range(256)}


_BYTE_LETTERS = _byte_letters()


_held: dict[str, Encoder] = {}


def encoder_of(content: str) -> Encoder:
    """The encoder of a tokenizer file, made once in each Python worker."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _held:
        _held.clear()
        _held[key] = Encoder(content)
    return _held[key]


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """``docs`` with each whole text's token ids (little-endian unsigned 32-bit integers) and their number.

    ``tokenizer`` is a file of the ``tokenizers`` library, read by the driver and broadcast (its size
    does not depend on the data).  Ids are those of the library without added special tokens; special tokens written in a
    text are tokens.  A null, empty or blank text has no ids; repeated rows are encoded alike; an
    empty table gives none.  The two new columns come last, with underscores in front of names that
    ``docs`` has already.
    """
    ids, n_tokens = fresh(docs, ids), fresh(docs, n_tokens)
    content = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder_of(content.value)
        for batch in steps(batches, text):
            column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
            found = [bpe.encode(t.as_py() or b"") for t in column]
            counts = pa.array([len(f) // 4 for f in found], pa.int64())
            yield appended(batch, **{ids: pa.array(found, pa.binary()), n_tokens: counts})

    return docs.mapInArrow(run, schema_with(docs, (ids, T.BinaryType()), (n_tokens, T.LongType())))


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with the text that the library's ``decode`` makes of the ids, special tokens included.

    For tokenizers without a decoder: the tokens, joined by one space.  No ids (or null) give an empty text;
    an id that the tokenizer lacks fails.  The new column comes last, with underscores in front of a name in use.
    """
    content = Path(tokenizer).read_text(encoding="utf-8")
    if json.loads(content)["decoder"] is not None:
        raise ValueError("only tokenizers without a decoder are decoded")
    shared = encoded.sparkSession.sparkContext.broadcast(content)
    name = fresh(encoded, decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(encoder_of(shared.value).tokens, pa.string())
        for batch in steps(batches, ids, 1 << 20):
            column = batch.column(batch.schema.get_field_index(ids)).fill_null(b"")
            numbers = np.frombuffer(b"".join(column.to_pylist()), "<u4")
            edges = np.concatenate(([0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False) // 4)))
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), tokens.take(pa.array(numbers)))
            yield appended(batch, **{name: pc.binary_join(lists, " ")})

    return encoded.mapInArrow(run, schema_with(encoded, (name, T.StringType())))
