"""Approximate nearest neighbours by a permutation index.

Pivots are vectors drawn from the table. A vector is represented by the pivots in order of
nearness and posted in the inverted files of its `posted` nearest ones. A query opens the
files of its own nearest pivots, ranks what it finds there by the footrule distance of the
two orders, and scores the nearest of them, and all within a radius, on the original vectors.
A query that has found too few vectors is scored against all, so that k come out wherever k
exist. Equal vectors are indexed once and asked once, so a group of copies neither fills the
files nor gives several equal pivots. Files with many vectors or queries are split into
tiles, which join like small files. Vectors of unlike lengths have indexes of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, written

#: Pivots (at most 256), and the files that a vector is posted in.
PIVOTS, POSTED = 128, 24
#: Footrule distance up to which candidates are scored, as a share of the largest between two orders.
RADIUS = 0.6
#: Of a tile's candidates at least so many for each neighbour wanted are scored, the nearest by footrule and all as near.
AT_LEAST = 40
#: Distinct vectors drawn for each pivot, and the cosine from which a vector is too near a chosen pivot to be one before others.
DRAWN, SPREAD = 8, 0.9
#: Parts in which the ids of one vector are looked through.
ID_PARTS = 64
TILE_VECTORS, TILE_QUERIES = 8192, 2048


def valid(column: str = "embedding") -> Column:
    c = F.col(column)
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(c) > 0) & F.forall(c, ok) & F.exists(c, lambda x: x != 0), F.lit(False))


def permutation_ranks(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For each vector, the rank of every pivot in order of nearness (by angle; ties to the first pivot)."""
    near = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))) @ pivots.T
    order = np.argsort(-near, axis=1, kind="stable")
    ranks = np.empty(order.shape, np.uint8)
    np.put_along_axis(ranks, order, np.arange(order.shape[1], dtype=np.uint8)[None], axis=1)
    return ranks


def footrule(ranks: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Footrule distances of some orders (vectors x pivots) from one."""
    return (np.maximum(ranks, own) - np.minimum(ranks, own)).sum(axis=1, dtype=np.int32)


def _files(ranks: np.ndarray, posted: int) -> np.ndarray:
    """Bit p of the row: the vector is posted in file p (uint64 words)."""
    bits = ranks < posted
    return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1, bitorder="little").view(np.uint64)


def spread_pivots(x: np.ndarray, pivots: int) -> np.ndarray:
    """`pivots` of the unit vectors x, the first ones that lie apart (cosines below SPREAD), then the first of the others."""
    apart: list[int] = []
    near = np.full(len(x), -np.inf)
    for i in range(len(x)):
        if len(apart) < pivots and near[i] < SPREAD:
            apart.append(i)
            near = np.maximum(near, x @ x[i])
    rest = np.setdiff1d(np.arange(len(x)), apart)
    return x[np.concatenate([np.array(apart, np.int64), rest])[:pivots]]


def search(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", *, pivots: int = PIVOTS, posted: int = POSTED, radius: float = RADIUS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for every row that the condition on vec_id picks, its k
    largest inner products with other rows, in double precision, nearest first, ties to the smaller vec_id.

    All rows are indexed and searched; a query finds k ids wherever k other ids have vectors of its length.
    Vectors that are null, empty, zero, or hold null or non-finite components, and rows without id, take no
    part; vectors of unlike lengths have no inner product and never find each other. Rows that repeat an id
    are the same row's copies: a query never finds its own id, and an id is found once, with its largest
    score. Of the ids that hold one vector only the k + 1 least can be among the k nearest of a query, so no
    more are indexed. The pivots of a length are drawn from its distinct vectors least by hash, a bounded
    sample. An empty table gives an empty result.
    """
    base = pick(vectors, vec_id=id_col, embedding=vector_col).withColumn("vec_id", F.col("vec_id").cast("long"))
    base = base.withColumn("embedding", F.col("embedding").cast("array<double>")).where(valid() & F.col("vec_id").isNotNull())
    base = base.withColumn("query", F.coalesce(queries, F.lit(False)))
    result = "query_id long, rank int, vec_id long, score double"
    key = ["dims", "h1", "h2"]  # 128 bits stand for a vector of a length
    base = base.withColumn("dims", F.size("embedding")).withColumn("h1", F.xxhash64(F.lit(3), "embedding")).withColumn("h2", F.xxhash64(F.lit(11), "embedding"))
    rows = written(base.groupBy("vec_id", *key).agg(F.bool_or("query").alias("query"), F.first("embedding").alias("embedding")), "vectors")
    askers = rows.where("query").select(*key, F.col("vec_id").alias("query_id"))
    ids = rows.select("vec_id", *key).withColumn("part", F.xxhash64(F.lit(7), "vec_id") % ID_PARTS)
    for by in ([*key, "part"], key):  # a vector that many rows hold is first looked through in parts
        ids = ids.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("at") <= k + 1).drop("at")
    ids = ids.groupBy(*key).agg(F.collect_list("vec_id").alias("ids"))
    distinct = rows.groupBy(*key).agg(F.first("embedding").alias("embedding"), F.bool_or("query").alias("query")).join(ids, key)
    distinct = written(distinct, "distinct")
    lengths = [r["dims"] for r in distinct.select("dims").distinct().collect()]
    if not lengths:
        return vectors.sparkSession.createDataFrame([], result)
    pivot: dict[int, np.ndarray] = {}
    for dims in lengths:
        chosen = distinct.where(F.col("dims") == dims).orderBy("h1", "h2").limit(DRAWN * pivots).select("embedding").collect()
        x = np.array([r["embedding"] for r in chosen])
        pivot[dims] = spread_pivots(x / np.sqrt((x * x).sum(axis=1, keepdims=True)), pivots)

    def represent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch["dims"].to_numpy()
            for dims in np.unique(length).tolist():
                part = batch.filter(pa.array(length == dims))
                x = part["embedding"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims)
                ranks = permutation_ranks(x, pivot[dims])
                files = np.argsort(ranks, axis=1, kind="stable")[:, :posted].astype(np.int32)
                yield pa.RecordBatch.from_arrays([part["dims"], part["h1"], part["h2"], part["query"], part["ids"], pa.array(list(files), pa.list_(pa.int32())), pa.array([r.tobytes() for r in ranks], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], names=["dims", "h1", "h2", "query", "ids", "files", "ranks", "vector"])

    index = written(distinct.select(*key, "query", "ids", "embedding").mapInArrow(represent, "dims int, h1 long, h2 long, query boolean, ids array<long>, files array<int>, ranks binary, vector binary"), "index")
    schema = pa.schema([("dims", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def unpack(table: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray]:
        n = table.num_rows
        return np.frombuffer(b"".join(table["ranks"].to_pylist()), np.uint8).reshape(n, -1), np.frombuffer(b"".join(table["vector"].to_pylist()), np.float64).reshape(n, dims)

    def nearest(q: np.ndarray, rough: np.ndarray, x: np.ndarray, places: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k + 1 nearest ids among the vectors at some places, and their scores; rough holds these but for rounding."""
        want = k + 1
        while True:
            some = places
            if want < len(places):
                at = np.partition(rough, len(rough) - want)[len(rough) - want]
                some = places[rough >= at - 1e-9 * max(1.0, abs(at))]
            each = (x[some] * q).sum(axis=1)
            found = np.concatenate([ids[ends[i] : ends[i + 1]] for i in some]) if len(some) else ids[:0]
            score = np.repeat(each, ends[some + 1] - ends[some])
            order = np.lexsort((found, -score))
            first = np.sort(np.unique(found[order], return_index=True)[1])  # an id once, with its largest score
            if len(first) > k or want >= len(places):
                top = order[first[: k + 1]]
                return found[top], score[top]
            want *= 4  # vectors of few ids

    def join(key: tuple, queries: pa.Table, posts: pa.Table) -> pa.Table:
        """The best of a tile for each query; file -1 holds all vectors, and there all are scored."""
        if not queries.num_rows or not posts.num_rows:
            return schema.empty_table()
        dims, file = key[0].as_py(), key[1].as_py()
        (q_ranks, q), (x_ranks, x) = unpack(queries, dims), unpack(posts, dims)
        limit = radius * (x_ranks.shape[1] ** 2 // 2)
        q_files, x_files = _files(q_ranks, posted), _files(x_ranks, posted)
        below = [np.uint64((1 << min(64, max(0, file - 64 * w))) - 1) for w in range(x_files.shape[1])]
        held = posts["ids"].combine_chunks()
        ids = held.flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy(zero_copy_only=False))])
        h1, h2 = queries["h1"].to_numpy(), queries["h2"].to_numpy()
        out: list[tuple[np.ndarray, ...]] = []
        for i in range(len(q)):
            some = np.arange(len(x))
            if file >= 0:
                earlier = np.zeros(len(x), bool)
                for w, bits in enumerate(below):
                    if bits & q_files[i, w]:
                        earlier |= (x_files[:, w] & (q_files[i, w] & bits)) != 0
                some = np.flatnonzero(~earlier)  # a pair meets in the first file that holds both
                far = footrule(x_ranks[some], q_ranks[i])
                enough = AT_LEAST * k
                some = some[far <= (max(limit, np.partition(far, enough - 1)[enough - 1]) if enough < len(far) else np.inf)]
            found, score = nearest(q[i], x[some] @ q[i], x, some, ids, ends)
            out.append((np.full(len(found), dims, np.int32), np.full(len(found), h1[i]), np.full(len(found), h2[i]), found, score))
        return pa.Table.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(5)], schema=schema)

    def renamed(df: DataFrame, need: list[str]) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{c}_") for c in need]).toDF(*need).groupBy("dims", "file", "x", "q")

    def found_in(posts: DataFrame, asks: DataFrame) -> DataFrame:
        """Vectors (with file) against queries (with file), in tiles of both: the k + 1 nearest ids of each query."""
        tiles = posts.groupBy("dims", "file").agg(F.count("*").alias("n")).join(asks.groupBy("dims", "file").agg(F.count("*").alias("q")), ["dims", "file"])  # files without queries drop out
        tiles = tiles.select("dims", "file", F.ceil(F.col("n") / TILE_VECTORS).cast("int").alias("tx"), F.ceil(F.col("q") / TILE_QUERIES).cast("int").alias("tq"))
        spread = F.abs(F.xxhash64(F.lit(5), "h1") % 1_000_003)
        placed = lambda df: df.join(F.broadcast(tiles), ["dims", "file"]).withColumn("h", spread)  # noqa: E731  # at most a row per pivot of each length
        at = lambda tiles_: (F.col("h") % F.col(tiles_)).cast("int")
        every = lambda tiles_: F.explode(F.sequence(F.lit(0), F.col(tiles_) - 1))
        posted_ = placed(posts).withColumn("x", at("tx")).withColumn("q", every("tq"))
        asked = placed(asks).withColumn("q", at("tq")).withColumn("x", every("tx"))
        pairs = renamed(asked, ["dims", "file", "x", "q", "h1", "h2", "ranks", "vector"]).cogroup(renamed(posted_, ["dims", "file", "x", "q", "ids", "ranks", "vector"])).applyInArrow(join, "dims int, h1 long, h2 long, vec_id long, score double")
        pairs = pairs.groupBy(*key, "vec_id").agg(F.max("score").alias("score"))
        # a query's own id is among the k + 1 nearest of its vector at most once
        best = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= k + 1)
        return best.groupBy(*key).agg(F.collect_list(F.struct("vec_id", "score")).alias("found"))

    filed = index.withColumn("file", F.explode("files"))
    found = written(found_in(filed, filed.where("query")), "found")
    asked = index.where("query")
    # the few that found less than a query and its k nearest need are held against all vectors of their length
    short = asked.join(found.where(F.size("found") > k).select(*key), key, "left_anti").withColumn("file", F.lit(-1))
    if not short.isEmpty():
        short = written(short, "short")
        all_ = index.join(short.select("dims").distinct(), "dims", "left_semi").withColumn("file", F.lit(-1))
        found = found.where(F.size("found") > k).unionByName(found_in(all_, short))
    pairs = askers.join(found, key).select("query_id", F.explode("found").alias("m")).select("query_id", "m.vec_id", "m.score").where("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
