r"""Token ids in seekable binary files: independent zstandard frames, a trailing seek table, checksums.

A file holds documents in ascending doc_id order, one zstandard frame for each document, then the table:

    file    := frame* table
    table   := entry* width:u8 count:u64 ids:u64 magic            (little endian)
    entry   := doc_id:i64 size:u64 n_tokens:u64 crc32:u32         size: bytes of the frame
    magic   := "FSTOKENS"

width is 2 or 4 bytes an id, by the vocabulary's size. crc32 is that of the document's ids as unsigned
32-bit integers and is checked on reading. A reader fetches the tail, sums the sizes and so knows where each
document's frame is; it decompresses only the documents asked for. A null doc_id is the smallest i64.

Rows are dealt by ranges of (doc_id, hash of the text), so that repeated ids do not gather in one task,
and sorted within a task, which writes one file under a name of its own attempt and renames it when it is
whole: a task that is run again leaves nothing half-written, and the manifest names one file for each task.
Files go to the shared folder by pyarrow's file systems, so to hdfs, s3, gs or a mounted folder alike.

Tokenising: the tokenizers library splits a text into words, which do not influence each other. Texts in
Latin-1 are normalised and split here by the same rules, in runs of 65,536 characters that end at white space, and
words that come again are encoded by the library once for each Python worker (a bounded memory of words); all other texts, texts with a special token's mark,
and all texts where the vocabulary's file names other rules than these, are encoded whole by the library. Both give the same ids.

Defined cases: null or empty text is a document with the end id alone. Ties and repeated rows are each
written, in an order that depends on the text only. An empty table gives no file and no row. Only
doc_id and text are read.
"""

from __future__ import annotations

import array
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, scratch, shuffle_partitions, table, text_slices, tidy

MAGIC = b"FSTOKENS"
ENTRY = np.dtype([("doc_id", "<i8"), ("size", "<u8"), ("n_tokens", "<u8"), ("crc32", "<u4")])
TAIL = "<BQQ8s"
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Tokens:
    """vocabulary: path of a tokenizer file (None: the public word_bpe_49k.json). end_id: appended to each document. level: of zstandard. words: distinct words a Python worker remembers."""

    vocabulary: str | None = None
    end_id: int = 1
    level: int = 1
    words: int = 1 << 17

    def path(self) -> str:
        if self.vocabulary:
            return self.vocabulary
        import public_tokenizers

        return str(public_tokenizers.path("word_bpe_49k.json"))


class Encoder:
    """Whole texts to ids, as Tokenizer.encode(text, add_special_tokens=False) gives them."""

    # The splitting rule below, for lower-cased Latin-1.
    LETTER, NUMBER, SPACE = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc\xbd\xbe", "\\x09-\\x0d\\x20\x85\xa0"
    SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
    WHITE = re.compile(f"[{SPACE}]")
    #: The rules of a vocabulary whose words are encoded one by one, as its file names them (fixed values).
    NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    SPLITTER = {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    }

    def __init__(self, tokens: Tokens):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokens.path())
        self.bare = Tokenizer(self.tokenizer.model)  # of one word, normalised and split already, its bytes written as the vocabulary writes them
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        self.letters = {b: 256 + k for k, b in enumerate(sorted({*range(256)}.difference(shown)))}
        with open(tokens.path(), encoding="utf-8") as file:
            rules = json.load(file)
        self.by_words = rules.get("normalizer") == self.NORMALISER and rules.get("pre_tokenizer") == self.SPLITTER and not rules.get("truncation")
        self.by_words &= rules.get("model", {}).get("type") == "BPE" and not rules["model"].get("dropout") and all(t["content"].startswith("<|") for t in rules.get("added_tokens", []))
        self.known: dict[str, bytes] = {}
        self.again: set[str] = set()  # known words that a second run of text has
        self.tokens = tokens
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 and tokens.end_id < 1 << 16 else 4

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _runs(self, text: str, most: int = 1 << 16) -> Iterator[str]:
        """The text in runs of about `most` characters that end before white space."""
        at = 0
        while at < len(text):
            found = self.WHITE.search(text, at + most)
            end = found.start() if found else len(text)
            yield text if not at and end == len(text) else text[at:end]
            at = end

    def _learn(self, distinct: set[str]) -> None:
        """Makes all these words known."""
        new = [w for w in distinct if w not in self.known]
        if len(self.known) + len(new) > self.tokens.words:  # words that came again stay, half of the room at most
            kept = self.again.union(distinct) if 2 * len(self.again) <= self.tokens.words else distinct
            self.known = {w: self.known[w] for w in kept if w in self.known}
            self.again = set()
        self.again.update(distinct.difference(new))
        spelled = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.letters) for w in new]
        for w, e in zip(new, self.bare.encode_batch_fast(spelled, add_special_tokens=False), strict=True):
            self.known[w] = array.array("I", e.ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, the end id included."""
        end = struct.pack("<I", self.tokens.end_id)
        parts: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            self._learn(set().union(*(words for _, words in held)))
            for at, words in held:
                parts[at].append(b"".join(map(self.known.__getitem__, words)))
            held.clear()

        for k, text in enumerate(texts):
            text = text or ""
            plain = self.by_words and "<|" not in text
            if plain and not text.isascii():
                try:
                    text.encode("latin-1")
                except UnicodeEncodeError:
                    plain = False
            if not plain:
                parts[k].append(self._whole(text))
                continue
            for run in self._runs(text):
                held.append((k, self.SPLIT.findall(run.lower())))
                size += len(run)
                if size >= BLOCK_BYTES:
                    flush()
                    size = 0
        flush()
        return [b"".join(p) + end for p in parts]


_ENCODERS: dict[Tokens, Encoder] = {}


def encoder_of(tokens: Tokens) -> Encoder:
    """This Python worker's encoder: later tasks of the worker find its words known."""
    if tokens not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[tokens] = Encoder(tokens)
    return _ENCODERS[tokens]


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def pack(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes()


def unpack(data: bytes, width: int) -> bytes:
    return data if width == 4 else np.frombuffer(data, dtype="<u2").astype("<u4").tobytes()


def write_files(docs: DataFrame, folder: str, tokens: Tokens = Tokens()) -> DataFrame:
    """Writes docs(doc_id, text) into files under folder; the manifest (part, file, docs, ids), ordered as the documents are."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(shuffle_partitions(spark), F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, press = encoder_of(tokens), zstandard.ZstdCompressor(level=tokens.level, write_checksum=True)
        target, sink, entries, name = None, None, [], f"tokens-{part:06d}-{uuid.uuid4().hex[:8]}.fst"
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, texts in text_slices(batch.column(1)):
                for doc_id, data in zip(ids[a : a + len(texts)], encoder.encode(texts), strict=True):
                    if sink is None:
                        target, path = file_system(folder)
                        target.create_dir(path, recursive=True)
                        sink = target.open_output_stream(f"{path}/_{name}")
                    frame = press.compress(pack(data, encoder.width))
                    sink.write(frame)
                    entries.append((NO_ID if doc_id is None else doc_id, len(frame), len(data) // 4, zlib.crc32(data)))
        if sink is not None:
            entry = np.array(entries, dtype=ENTRY)
            total = int(entry["n_tokens"].sum())
            sink.write(entry.tobytes())
            sink.write(struct.pack(TAIL, encoder.width, len(entry), total, MAGIC))
            sink.close()
            target.move(f"{path}/_{name}", f"{path}/{name}")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "docs": pa.array([len(entry)], pa.int64()), "ids": pa.array([total], pa.int64())})

    manifest = f"{folder}/manifest"
    rows.select("doc_id", "text").mapInArrow(tidy(write), "part int, file string, docs long, ids long").write.parquet(manifest)
    return spark.read.schema("part int, file string, docs long, ids long").parquet(manifest)


def read_table(source) -> tuple[np.ndarray, np.ndarray, int]:
    """(entries, offsets of their frames, bytes an id) of an open file."""
    size = source.size()
    source.seek(size - struct.calcsize(TAIL))
    width, count, total, magic = struct.unpack(TAIL, source.read(struct.calcsize(TAIL)))
    if magic != MAGIC:
        raise ValueError("not a token file")
    source.seek(size - struct.calcsize(TAIL) - count * ENTRY.itemsize)
    entries = np.frombuffer(source.read(count * ENTRY.itemsize), dtype=ENTRY)
    if int(entries["n_tokens"].sum()) != total:
        raise ValueError("the seek table is damaged")
    return entries, np.cumsum(entries["size"]) - entries["size"], width


def read_documents(uri: str, wanted: set[int] | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(doc_id, ids before it in the file, its ids as unsigned 32-bit integers) of the documents wanted (None: all); frames of others are neither read nor decompressed."""
    import zstandard

    system, path = file_system(uri)
    unpress = zstandard.ZstdDecompressor()
    with system.open_input_file(path) as source:
        entries, offsets, width = read_table(source)
        before = np.cumsum(entries["n_tokens"]) - entries["n_tokens"]
        for k, e in enumerate(entries):
            if wanted is None or int(e["doc_id"]) in wanted:
                source.seek(int(offsets[k]))
                ids = unpack(unpress.decompress(source.read(int(e["size"])), max_output_size=int(e["n_tokens"]) * width), width)
                if zlib.crc32(ids) != e["crc32"] or len(ids) != 4 * e["n_tokens"]:
                    raise ValueError(f"checksum of document {e['doc_id']} in {uri}")
                yield int(e["doc_id"]), int(before[k]), ids


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    spark = manifest.sparkSession
    parts = sorted((r["part"], r["file"], r["ids"]) for r in manifest.collect())  # one short row for each file
    starts, at = [], 0
    for _, file, ids in parts:
        starts.append((file, at))
        at += ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(None if i == NO_ID else i, start + before, len(ids) // 4, zlib.crc32(ids)) for i, before, ids in read_documents(f"{folder}/{file}")]
                yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(("doc_id", "start", "n_tokens", "ids_crc32"))})

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not starts:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame(starts, "file string, start long").repartition(min(len(starts), shuffle_partitions(spark)), "file")
    return files.mapInArrow(tidy(read), schema)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(table(spark, sf_dir, "documents"))


def tokenised(docs: DataFrame, tokens: Tokens = Tokens()) -> DataFrame:
    folder = scratch(docs.sparkSession, "tokens")
    return read_files(write_files(docs, folder, tokens), folder)
