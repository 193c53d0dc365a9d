"""Token ids as Arrow files of equal-length sequences that are read in place.

Documents are encoded in id order and laid end to end.  A file holds record
batches of two fixed-size lists: ``ids`` (16 bits where the vocabulary allows,
else 32) and ``mask``, false behind the last id.  All batches but the last have
the same number of rows, so sequence ``i`` is row ``i % rows`` of batch
``i // rows``: a memory-mapped file gives it without a copy.  Beside each file
lies the list of its documents.

Each task writes under a name of its own and renames at its end, so a lost or
repeated task leaves no half file under the final name.
"""

from __future__ import annotations

import os
import re
import string
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.rows import steps, text_buffer
from tidemark.plans.durable import cut, ensure_checkpoint_dir

#: Ids of a sequence, and sequences of a record batch.
LENGTH, BATCH_ROWS = 2048, 256
#: Words whose ids a Python worker remembers (twice as many just before it forgets; a step may add its own), and words
#: encoded in one text.
MEMO, WORDS = 1 << 19, 256
#: Latin letters that stay letters in lower case (one, U+0130, does not).
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]"


class TokenFiles(NamedTuple):
    """Where files lie, and ``manifest``: ``shard, n_docs, n_tokens, n_sequences, start`` of each."""

    folder: str
    manifest: DataFrame


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder that all tasks share."""
    if folder.startswith("file:"):
        folder = "/" + folder[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(folder)


class Encoder:
    """Whole texts to ids.

    ``by_word`` remembers the ids of single words.  It is right for tokenizers that
    drop white space and split first at it, and between Latin letters and ASCII
    punctuation other than an apostrophe, so that no token, and no step before the
    split, reaches over these places.  Words not met yet lose such punctuation at
    their end, which is looked up on its own, and are encoded many at a time.
    Words in use stay remembered: of a full memo those asked for again are carried over.
    """

    def __init__(self, path: str, by_word: bool, wide: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.kind = np.dtype("<u4" if wide else "<u2")
        self.memo: dict[bytes, bytes] = {}
        self.former: dict[bytes, bytes] = {}
        if by_word:
            # A special token is matched before anything is split, so its characters end no word.
            special = set("".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values()))
            tail = "".join(c for c in string.punctuation if c not in special and c != "'")
            self.tailed = re.compile(f"({LETTERS}+)([{re.escape(tail)}]+)" if tail else "(?!)")
            self.letters = re.compile(f"{LETTERS}+")
            suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True

    def _encode_letters(self, words: list[str]) -> Iterator[bytes]:
        """Words of letters: each has an end mark at least, so as many marks as words are one for each."""
        groups = [words[k : k + WORDS] for k in range(0, len(words), WORDS)]
        found = self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, encoded in zip(groups, found):
            ids = np.array(encoded.ids, self.kind)
            edges = np.flatnonzero(self.ends[ids]) + 1
            if len(edges) != len(group) or edges[-1] != len(ids):
                yield from self._encode_words(group)
                continue
            raw, edges = ids.tobytes(), (edges * self.kind.itemsize).tolist()
            yield from (raw[a:b] for a, b in zip([0, *edges], edges))

    def _encode_words(self, words: list[str]) -> Iterator[bytes]:
        """Any words; the place where a token begins tells its word."""
        groups = [words[k : k + WORDS] for k in range(0, len(words), WORDS)]
        found = self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)
        for group, encoded in zip(groups, found):
            starts = np.cumsum([0, *(len(w) + 1 for w in group)])
            begins = np.fromiter((begin for begin, _ in encoded.offsets), np.int64, len(encoded))
            raw = np.array(encoded.ids, self.kind).tobytes()
            edges = (np.searchsorted(begins, starts) * self.kind.itemsize).tolist()
            yield from (raw[a:b] for a, b in zip(edges, edges[1:]))

    def pack(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as little-endian integers laid end to end."""
        if not self.by_word:
            found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            return [np.array(f.ids, self.kind).tobytes() for f in found]
        if len(self.memo) > MEMO:
            self.memo, self.former = {}, self.memo
        words = [t.split() for t in texts]  # bytes split at ASCII white space only
        new = self._unknown(set(chain.from_iterable(words)))
        split = {w: m.groups() for w in new if (m := self.tailed.fullmatch(w.decode()))}
        pieces = self._unknown({p.encode() for pair in split.values() for p in pair} | new.difference(split))
        plain, other = [], []
        for piece in map(bytes.decode, pieces):
            (plain if self.letters.fullmatch(piece) else other).append(piece)
        for encode, part in ((self._encode_letters, plain), (self._encode_words, other)):
            for k in range(0, len(part), 64 * WORDS):
                some = part[k : k + 64 * WORDS]
                self.memo.update(zip(map(str.encode, some), encode(some)))
        for word, (first, last) in split.items():
            self.memo[word] = self.memo[first.encode()] + self.memo[last.encode()]
        return [b"".join(map(self.memo.__getitem__, w)) for w in words]

    def _unknown(self, words: set[bytes]) -> set[bytes]:
        """The words to encode; those that only the former memo has come back."""
        new = words.difference(self.memo)
        known = {w: self.former[w] for w in new if w in self.former}
        self.memo.update(known)
        return new.difference(known)

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        return [np.frombuffer(ids, self.kind).tolist() for ids in self.pack(texts)]


@cache
def shared_encoder(path: str, by_word: bool, wide: bool) -> Encoder:
    """One encoder for all tasks that a Python worker runs, one after the other."""
    return Encoder(path, by_word, wide)


class _Writer:
    """Ids in, record batches out."""

    def __init__(self, sink, length: int, rows: int, wide: bool):
        self.length, self.rows = length, rows
        self.kind = pa.uint32() if wide else pa.uint16()
        self.schema = pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        if self.n_held >= self.length * self.rows:
            self.flush(last=False)

    def flush(self, last: bool) -> None:
        flat, size = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32), self.length * self.rows
        whole = len(flat) // size * size
        for k in range(0, whole, size):
            self._write(flat[k : k + size], size)
        rest = flat[whole:]
        self.held, self.n_held = [rest], len(rest)
        if last and len(rest):
            padded = np.zeros(-(-len(rest) // self.length) * self.length, flat.dtype)
            padded[: len(rest)] = rest
            self._write(padded, len(rest))

    def _write(self, ids: np.ndarray, real: int) -> None:
        values = pa.array(ids.astype(self.kind.to_pandas_dtype()))
        mask = pa.array(np.arange(len(ids)) < real)
        columns = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (values, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))


class SequenceFile:
    """Random access to a written file: sequences, and runs of ids."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view of the file's bytes) and mask of sequence ``i``."""
        batch = self.file.get_batch(i // self.rows)
        at = i % self.rows * self.length
        ids = batch.column(0).values.to_numpy(zero_copy_only=True)
        return ids[at : at + self.length], batch.column(1).values.slice(at, self.length)

    def tokens(self, start: int, count: int) -> np.ndarray:
        """Ids ``start:start + count`` of the file; a view where they lie in one batch."""
        size, parts = self.rows * self.length, []
        while count > 0:
            ids = self.file.get_batch(start // size).column(0).values.to_numpy(zero_copy_only=True)
            part = ids[start % size : start % size + count]
            parts.append(part)
            start, count = start + len(part), count - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint32), *parts])


def _path(root: str, kind: str, shard: int) -> str:
    return f"{root}/{kind}-{shard:06d}.arrow"


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    by_word: bool = False,
    vocabulary: int = 1 << 32,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    batch_rows: int = BATCH_ROWS,
    folder: str | None = None,
) -> TokenFiles:
    """Encode every whole text, append ``end_id`` to each and write the files in ascending id order.

    Null ids come first; rows of one id follow each other by their text; a null or
    empty text has the end id only; equal rows are all written; an empty table
    gives an empty manifest and no files; other columns are not read.  ``tokenizer``
    is the path of a vocabulary file that every machine has.
    """
    spark = docs.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    wide = vocabulary > 1 << 16

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = steps(batches, "text")
        first = next(parts, None)
        if first is None:
            return
        shard, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, root = filesystem(folder)
        encoder = shared_encoder(tokenizer, by_word, wide)
        end = np.array([end_id], encoder.kind).tobytes()
        names = {kind: f"{root}/.{own}-{kind}" for kind in ("tokens", "docs")}
        index_schema = pa.schema([("doc_id", first.schema.field("doc_id").type), ("n_tokens", pa.int64())])
        n_docs = 0
        with fs.open_output_stream(names["tokens"]) as sink, fs.open_output_stream(names["docs"]) as side:
            writer, index = _Writer(sink, length, batch_rows, wide), pa.ipc.new_file(side, index_schema)
            for batch in chain([first], parts):
                data, offsets = text_buffer(batch.column("text"))
                raw, edges = data.tobytes(), offsets.tolist()
                found = encoder.pack([raw[a:b] for a, b in zip(edges, edges[1:])])
                writer.add(np.frombuffer(end.join([*found, b""]), encoder.kind))
                sizes = pa.array([len(ids) // encoder.kind.itemsize + 1 for ids in found], pa.int64())
                index.write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes], schema=index_schema))
                n_docs += batch.num_rows
            writer.flush(last=True)
            writer.file.close()
            index.close()
        for kind, name in names.items():
            fs.move(name, _path(root, kind, shard))
        values = (shard, n_docs, writer.n_tokens, -(-writer.n_tokens // length))
        columns = ["shard", "n_docs", "n_tokens", "n_sequences"]
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in values], names=columns)

    written = cut(ordered.mapInArrow(write, "shard long, n_docs long, n_tokens long, n_sequences long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    manifest = written.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return TokenFiles(folder, cut(manifest))


def read_documents(spark: SparkSession, files: TokenFiles, doc_type: str = "bigint") -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document, from the files alone.

    ``start`` counts the ids of all documents before it; the checksum is over its
    ids as little-endian unsigned 32-bit integers.
    """
    folder = files.folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            for shard, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist()):
                tokens, at = SequenceFile(fs, _path(root, "tokens", shard)), 0
                with fs.open_input_file(_path(root, "docs", shard)) as source:
                    index = pa.ipc.open_file(source)
                    for k in range(index.num_record_batches):
                        part = index.get_batch(k)
                        sizes = part.column("n_tokens").to_numpy()
                        starts = at + np.cumsum(sizes) - sizes
                        sums = [
                            zlib.crc32(tokens.tokens(a, n).astype("<u4").tobytes())
                            for a, n in zip(starts.tolist(), sizes.tolist())
                        ]
                        at += int(sizes.sum())
                        columns = [part.column("doc_id"), start + starts, sizes, np.array(sums, np.int64)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                        )

    shards = max(1, files.manifest.count())
    schema = f"doc_id {doc_type}, start long, n_tokens long, ids_crc32 long"
    return files.manifest.select("shard", "start").repartition(shards).mapInArrow(read, schema)
