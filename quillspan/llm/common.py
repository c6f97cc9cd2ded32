"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id wherever ids are ordered in numpy: after every real id.
NULL_ID = np.iinfo(np.int64).max
#: Cached words per Python worker; the cache is emptied beyond it.
CACHE_WORDS = 300_000
#: Bytes that a cache of words and their values may hold, and those of an entry besides its contents.
CACHE_BYTES, ENTRY_BYTES = 40 << 20, 200
#: Rows of an Arrow batch of whole texts.
BATCH_ROWS = 2_000
#: Rows and bytes of text of an Arrow batch that are worked on together.
SLICE_ROWS, SLICE_BYTES = 2_000, 4 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine (tests) a folder of our own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file:///tmp/quillspan-shared"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """Where this application keeps what its operators write."""
    return f"{shared_folder(spark)}/quillspan/{spark.sparkContext.applicationId}"


def discard(spark: SparkSession) -> None:
    """Deletes everything that the operators of this application wrote; results that are still to be computed need it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage ends here and survives lost executors. options: of the writer."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Hands at most BATCH_ROWS rows to Python at once, in this session from now on: whole texts are large, and an executor holds batches on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under our own names, so that further columns of the caller never clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_HELD: list = []


def give_back() -> None:
    """Returns freed memory of this Python worker to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def use_cache(owner: str, clear: Callable[[], None]) -> None:
    """One operator's caches at a time: a worker that serves another stage drops those of the stage before."""
    if _HELD and _HELD[0] != owner:
        _HELD[1]()
        gc.collect()
        give_back()
    _HELD[:] = [owner, clear]


def coded_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words `[^\\x20\\x09-\\x0D]+` of some texts (null: none), the number of each word in order, and where each text's start and end."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    codes = coded.indices.to_numpy()
    bounds = np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    if b"" in words:  # beside white space at an end
        real = codes != words.index(b"")
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        codes = codes[real]
    return words, codes, bounds


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words of some texts in order, and where each text's start and end. Equal words are hashed once; nothing is kept."""
    words, codes, bounds = coded_words(texts)
    return hashes_of(words)[codes], bounds


class Lexicon:
    """word -> bytes, computed for the words that are not remembered; forgotten once the memory is full.

    What is held is counted in bytes, so that words of any length are bounded alike.
    """

    def __init__(self, compute: Callable[[list[str]], list[bytes]], most: int = CACHE_BYTES) -> None:
        self.compute, self.most = compute, most
        self.known: dict[str, bytes] = {}
        self.size = 0

    def __call__(self, words: list[str]) -> list[bytes]:
        found = list(map(self.known.get, words))
        new = [w for w, v in zip(words, found, strict=True) if v is None]
        if not new:
            return found
        made = self.compute(new)
        size = sum(map(len, new)) + sum(map(len, made)) + ENTRY_BYTES * len(new)
        if self.size + size > self.most:
            self.known.clear()
            self.size = 0
        if size <= self.most:
            self.known.update(zip(new, made, strict=True))
            self.size += size
        rest = iter(made)
        return [next(rest) if v is None else v for v in found]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct space-delimited pieces of some texts, the number of each piece in order, and where each text's pieces start and end."""
    parts = pc.split_pattern(texts, " ")
    coded = parts.flatten().dictionary_encode()
    bounds = np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return coded.dictionary, coded.indices.to_numpy(), bounds


def joined(values: list[bytes], codes: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
    """For each text, the values of its pieces one after another."""
    taken = pa.array(values, pa.large_binary()).take(pa.array(codes, pa.int64()))
    _, places, data = taken.buffers()
    at = np.frombuffer(places, np.int64)[bounds].tolist()
    whole = memoryview(data) if data is not None else memoryview(b"")
    return [whole[a:b] for a, b in zip(at, at[1:], strict=False)]


def slices(batch: pa.RecordBatch, column: str | int = "text") -> Iterator[pa.RecordBatch]:
    """The batch in parts of few rows and bytes of text; a long text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for at, size in enumerate(sizes.tolist()):
        if at > start and (held + size > SLICE_BYTES or at - start == SLICE_ROWS):
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Each text as UTF-8 bytes, null as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive words (empty where there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : n + j]
    return mix(out)


def over_batches(function: Callable[[pa.RecordBatch], dict], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from one that turns a batch into columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch) if "text" in batch.schema.names else (batch.slice(at, SLICE_ROWS) for at in range(0, batch.num_rows, SLICE_ROWS)):
                columns = function(part)
                yield pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)
        give_back()

    return run


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): each linked node with the smallest node that links reach.

    Alternating large-star and small-star steps; a hub is only ever met by an
    aggregate and by a join whose skewed side Spark may split. Each round is
    checkpointed in the shared folder. Self links and repeated links are ignored.
    """
    shared_folder(edges.sparkSession)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    state = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # every edge keeps its larger end in a
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = small.select("e.a", "e.b").where("a <> b").distinct().checkpoint()
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = seen
