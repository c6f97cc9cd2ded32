"""Token ids in seekable binary files of independent zstandard frames.

File format (all integers little-endian)::

    magic  b"QSTK0001"
    frames, one after another, each an independent zstandard frame of uint32 ids
           of whole documents, holding a content checksum of its own
    table  per document: doc_id int64, id_is_null uint8, frame uint32,
           first id within the frame uint64, number of ids uint64
    seek   per frame: offset uint64, compressed bytes uint64, ids uint64, crc32 of the ids uint32
    footer documents uint64, frames uint64, offset of the table uint64,
           crc32 of table and seek uint32, magic

A reader takes the footer, the tables and then only the frames of the documents asked for.
A document of any length lies in one frame; a frame is closed once it holds FRAME_IDS ids.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Lexicon, give_back, joined, own_folder, pick, slices, small_batches, split_words, use_cache, written

MAGIC = b"QSTK0001"
FRAME_IDS = 1 << 18
#: Bytes of text from which a file is closed.
FILE_BYTES = 32 << 20
#: Ranges of files whose starts are added up together.
FILES_TOGETHER = 1_000
LEVEL = 1
#: Bytes of remembered pieces in a Python worker: most of the time goes into pieces that were forgotten.
MEMORY = 64 << 20
TABLE = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("first", "<u8"), ("n", "<u8")])
SEEK = np.dtype([("offset", "<u8"), ("size", "<u8"), ("n", "<u8"), ("crc", "<u4")])
FOOTER = struct.Struct("<QQQI8s")
_RE2 = re.compile(r"[^\w ]")


class Encoder:
    """Encodes as the tokenizers library does (add_special_tokens=False), remembering the ids of space-delimited pieces.

    The byte-level pre-tokenizer always cuts before a space that stands between two
    characters that are no white space, between a Latin letter or digit and a stop that ends a
    word, and on both sides of a line end between two such words, so these pieces encode by
    themselves. Texts with other spaces, or with the string of an added token, go to the library whole.
    """

    #: Stands before pieces that have no space before them; texts that hold it go to the library whole.
    JOINED = "\uffff"
    WORD = "([A-Za-z0-9À-ÖØ-öø-ɏ])([.,])"

    #: White space as the tokenizer and Python know it.
    BLANK = "[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.odd = "|".join([f"{self.BLANK} | {self.BLANK}|^ | $|{self.JOINED}", *(_RE2.sub(r"\\\g<0>", t.content) for t in added)])
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # the byte-level alphabet has one character for each byte
        self.width = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self.pieces = Lexicon(self._pieces, MEMORY)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, words: list[str]) -> list[bytes]:
        """The ids of each piece. Pieces are encoded many in a string and told apart by their bytes.

        Pieces with a space before them follow each other; others follow a line end, whose id is dropped.
        """
        out: list[bytes] = [b""] * len(words)
        spaced, lined, alone = [], [], []
        for k, w in enumerate(words):
            (alone if w[-1].isspace() else spaced if w[0] == " " else alone if w[1:2].isspace() else lined).append(k)
        bare = [words[k][1:] for k in alone]  # without the mark, but with a space
        bare = [words[k] if words[k][0] == " " else t for k, t in zip(alone, bare, strict=True)]
        for k, ids in zip(alone, self._whole(bare), strict=True):
            out[k] = ids.tobytes()
        for places, texts, skip in ((spaced, [words[k] for k in spaced], 0), (lined, ["\n" + words[k][1:] for k in lined], 1)):
            if not places:
                continue
            ids = np.concatenate(self._whole(["".join(texts[at : at + 64]) for at in range(0, len(texts), 64)]))
            ends = np.cumsum(self.width[ids])
            past = np.cumsum(pc.binary_length(pa.array(texts)).to_numpy().astype(np.int64))
            cut = np.searchsorted(ends, past) + 1
            first = np.concatenate([[0], cut[:-1]])
            if (ends[cut - 1] != past).any() or (skip and (self.width[ids[first]] != 1).any()):
                raise ValueError("a token of this tokenizer crosses a space or a line end")
            raw = ids.tobytes()
            for k, start, end in zip(places, (4 * (first + skip)).tolist(), (4 * cut).tolist(), strict=True):
                out[k] = raw[start:end]
        return out

    def encode(self, texts: pa.Array) -> list[bytes | memoryview]:
        """The ids of each whole text as little-endian uint32; a null or empty text has none."""
        out: list[bytes | memoryview] = [b""] * len(texts)
        full = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
        odd = pc.fill_null(pc.match_substring_regex(texts, self.odd), False)
        whole = np.flatnonzero(pc.and_(full, odd).to_numpy(zero_copy_only=False)).tolist()
        for k, ids in zip(whole, self._whole([texts[k].as_py() for k in whole]), strict=True):
            out[k] = ids.tobytes()
        plain = np.flatnonzero(pc.and_not(full, odd).to_numpy(zero_copy_only=False))
        if len(plain):
            parted = pc.replace_substring_regex(texts.take(pa.array(plain)), rf"{self.WORD} ", rf"\1 {self.JOINED}\2 ")
            parted = pc.replace_substring_regex(parted, f"{self.WORD}\n([^{self.BLANK[1:]})", f"\\1 {self.JOINED}\\2 {self.JOINED}\n {self.JOINED}\\3")
            # the first piece of a text has no space before it
            distinct, codes, bounds = split_words(pc.binary_join_element_wise(self.JOINED, parted, ""))
            marked = pc.starts_with(distinct, self.JOINED)
            words = pc.if_else(marked, distinct, pc.binary_join_element_wise(" ", distinct, ""))
            values = self.pieces(words.to_pylist())
            for k, ids in zip(plain.tolist(), joined(values, codes, bounds), strict=True):
                out[k] = ids
        return out


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core; threads of our own would only wait for each other
    return Encoder(path)


def encoder(path: str) -> Encoder:
    use_cache("tokens", _encoder.cache_clear)
    return _encoder(path)


def write_tokens(sink: io.RawIOBase | pa.NativeFile, documents: Iterable[tuple[int | None, bytes]], frame_ids: int = FRAME_IDS) -> tuple[int, int]:
    """Writes (doc_id, ids) pairs in their order; returns the numbers of documents and ids."""
    compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True).compress
    sink.write(MAGIC)
    offset, total, held = len(MAGIC), 0, 0
    parts: list[bytes] = []
    table: list[tuple] = []
    seek: list[tuple] = []

    def close() -> None:
        nonlocal offset, held
        if parts:
            raw = b"".join(parts)
            packed = compress(raw)
            sink.write(packed)
            seek.append((offset, len(packed), len(raw) // 4, zlib.crc32(raw)))
            offset += len(packed)
            parts.clear()
            held = 0

    for doc_id, ids in documents:
        n = len(ids) // 4
        table.append((doc_id or 0, doc_id is None, len(seek), held, n))
        parts.append(ids)
        held += n
        total += n
        if held >= frame_ids:
            close()
    if not held and parts:  # documents without ids need no frame
        parts.clear()
    close()
    tail = np.array(table, TABLE).tobytes() + np.array(seek, SEEK).tobytes()
    sink.write(tail)
    sink.write(FOOTER.pack(len(table), len(seek), offset, zlib.crc32(tail), MAGIC))
    return len(table), total


class TokenReader:
    """Random access to a token file: only the frames asked for are read and decompressed."""

    def __init__(self, source: io.RawIOBase | pa.NativeFile) -> None:
        self.source = source
        end = source.seek(0, 2)
        end = source.tell() if end is None else end
        source.seek(end - FOOTER.size)
        n_docs, n_frames, offset, crc, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(offset)
        tail = source.read(end - FOOTER.size - offset)
        if zlib.crc32(tail) != crc:
            raise ValueError("the tables of the token file are damaged")
        self.table = np.frombuffer(tail, TABLE, n_docs)
        self.seek = np.frombuffer(tail, SEEK, n_frames, n_docs * TABLE.itemsize)
        self.frame_no, self.frame_ids = -1, np.empty(0, "<u4")
        self.frames_read = 0

    def frame(self, number: int) -> np.ndarray:
        if number != self.frame_no:
            entry = self.seek[number]
            self.source.seek(int(entry["offset"]))
            raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(entry["size"])))
            if zlib.crc32(raw) != entry["crc"] or len(raw) != 4 * entry["n"]:
                raise ValueError(f"frame {number} of the token file is damaged")
            self.frame_no, self.frame_ids = number, np.frombuffer(raw, "<u4")
            self.frames_read += 1
        return self.frame_ids

    def document(self, place: int) -> np.ndarray:
        """The ids of the document at this place of the table."""
        row = self.table[place]
        if not row["n"]:
            return np.empty(0, "<u4")
        first = int(row["first"])
        return self.frame(int(row["frame"]))[first : first + int(row["n"])]


def write_token_files(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int | None = 2, folder: str | None = None, file_bytes: int = FILE_BYTES) -> tuple[str, DataFrame]:
    """Encodes every whole text, appends end_id and writes token files in ascending order of doc_id.

    Rows are sorted into ranges of doc_id; a range is written as one file or, closed at
    file_bytes of text, as several, so files are bounded by bytes and only a text longer
    than that makes a larger one. Returns the folder and a table of the files: part and file
    (together they ascend with doc_id), path, n_docs, n_ids, start (the ids in all files
    before). A file is written under a name of its own attempt and then moved, so a task that
    runs again leaves no half file. Null and empty texts hold only the end id; null ids come
    first; rows that repeat an id, or have none, are ordered by a hash of the text and the
    text, so that many of them may lie in several ranges. An empty table writes no file.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or f"{own_folder(spark)}/tokens-{uuid.uuid4().hex}"
    base = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("h", F.xxhash64("text"))
    n_bytes = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // file_bytes))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc_nulls_first()]
    dealt = base.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").select(F.spark_partition_id().alias("part"), "doc_id", "text")
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [0]  # bytes of text by file, the last one open

        def encoded() -> Iterator[tuple[int, int, int | None, bytes]]:
            tool = encoder(tokenizer_path)
            for batch in batches:
                for part in slices(batch):
                    length = pc.fill_null(pc.binary_length(part["text"]), 0).to_pylist()
                    for number, doc_id, size, ids in zip(part["part"].to_pylist(), part["doc_id"].to_pylist(), length, tool.encode(part["text"]), strict=True):
                        if sizes[-1] and sizes[-1] + size > file_bytes:
                            sizes.append(0)
                        sizes[-1] += size
                        yield number, len(sizes) - 1, doc_id, b"".join((ids, tail))

        rows = encoded()
        row = next(rows, None)
        if row is None:
            return
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        while row is not None:
            part, file = row[:2]

            def own() -> Iterator[tuple[int | None, bytes]]:
                nonlocal row
                while row is not None and row[1] == file:  # noqa: B023
                    yield row[2:]
                    row = next(rows, None)

            name = f"part-{part:07d}-{file:05d}.qstk"
            trial = f"{root}/.{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(trial, compression=None) as sink:
                n_docs, n_ids = write_tokens(sink, own())
            store.move(trial, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([file], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})
        give_back()

    files = written(dealt.mapInArrow(write, "part int, file int, path string, n_docs long, n_ids long"), "files")
    # prefix sums in two steps: within groups of parts, and over the groups
    files = files.withColumn("group", F.floor(F.col("part") / FILES_TOGETHER))
    groups = files.groupBy("group").agg(F.sum("n_ids").alias("n")).withColumn("of_group", F.coalesce(F.sum("n").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy("group").orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return folder, files.withColumn("before", before).join(groups, "group").select("part", "file", "path", "n_docs", "n_ids", (F.col("of_group") + F.col("before")).alias("start"))


def read_token_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Every document back from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Spark's binaryFile source reads the files, from any store that Spark reads.
    """
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    schema = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.qstk").load(folder)
    number = lambda k: F.regexp_extract("path", r"part-(\d+)-(\d+)\.qstk$", k).cast("int")
    raw = raw.select(number(1).alias("part"), number(2).alias("file"), "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file, content in zip(batch["part"].to_pylist(), batch["file"].to_pylist(), batch["content"], strict=True):
                reader = TokenReader(pa.BufferReader(content.as_buffer()))
                table = reader.table
                n, size = table["n"].astype(np.int64), len(table)
                crc = [zlib.crc32(reader.document(i)) for i in range(size)]
                numbers = [pa.array(np.full(size, x, np.int32)) for x in (part, file)]
                yield pa.RecordBatch.from_arrays([*numbers, pa.array(table["doc_id"], pa.int64(), mask=table["null"].astype(bool)), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], schema=schema)

    found = raw.mapInArrow(read, "part int, file int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(files.select("part", "file", F.col("start").alias("base")), ["part", "file"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
