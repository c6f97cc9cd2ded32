"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors of cosine c are at squared distance 2(1 - c). They are rotated and split into
blocks; each block gets a budget in proportion to its dimensions. If a pair keeps within
the whole budget, it keeps within that of some block. So each block is range-joined by
itself: a grid over its first two coordinates, cells as wide as the block's radius, a point
meeting the nine cells around it where its third coordinate is near enough. Candidates are
verified in double precision on the original vectors. A pair counts in its first block within
budget, so that it counts once.

The distinct vectors are written once, to the shared folder, and cut into tiles by the rows
of the files; a task reads two tiles from there and joins all their blocks. No vector is sent
to where it is met, so disk grows with the vectors, whatever their number and however crowded
a cell is; time grows with the square of their number, as every two tiles meet. A task sends,
per vector that it links, its number of links and the root of its tree of links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import valid
from .common import components, give_back, pick, written

BLOCK_DIMS = 8
#: The most points of a tile, and how few are not cut further to occupy all cores.
TILE_POINTS, LEAST_POINTS = 65_536, 2_048
#: Bytes of a row group of the vectors' files, which a task reads whole.
GROUP_BYTES = 8 << 20
#: Points that meet a column of cells at once, candidates verified at once, links held until they are counted.
MEET, VERIFY, HELD = 256, 20_000, 500_000
#: Slack for rounding, of doubles and of single floats: candidates may be found in excess, never too few.
SLACK, COARSE = 1e-7, 1e-5


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(17).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blobs(x: np.ndarray) -> list[bytes]:
    """Rows as bytes: of single floats where these hold the values exactly, else of doubles."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    exact = (small == x).all(axis=1).tolist()
    return [s.tobytes() if e else v.tobytes() for s, v, e in zip(small, x, exact, strict=True)]


def matrix(held: list[bytes], dims: int) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.float64 if len(b) == 8 * dims else np.float32) for b in held]).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def blocks(dims: int) -> list[slice]:
    return [slice(a, min(a + BLOCK_DIMS, dims)) for a in range(0, dims, BLOCK_DIMS)]


def _columns(flat: np.ndarray, width: float) -> tuple[np.ndarray, dict[tuple[int, int], tuple[int, int]], np.ndarray]:
    """Points in the order of their column of cells and third coordinate: their places, where each column starts and ends, and the third coordinates."""
    wide = np.pad(flat[:, :3], ((0, 0), (0, max(0, 3 - flat.shape[1]))))
    cell = np.floor(wide[:, :2] / width).astype(np.int64)
    order = np.lexsort((wide[:, 2], cell[:, 1], cell[:, 0]))
    cell = cell[order]
    starts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]).any(axis=1)]))
    ends = np.append(starts[1:], len(cell))
    return order, {(x, y): (s, e) for (x, y), s, e in zip(cell[starts].tolist(), starts.tolist(), ends.tolist(), strict=True)}, wide[order, 2]


def _candidates(left: np.ndarray, right: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs whose squared distance in a block is at most the limit, and of few beyond it."""
    width = np.sqrt(limit) * (1 + 1e-6) + SLACK
    order_l, own, near_l = _columns(left, width)
    order_r, other, near_r = _columns(right, width)
    # the product of these is the squared distance
    a, b = left[order_l].astype(np.float32), right[order_r].astype(np.float32)
    a = np.column_stack([-2 * a, (a * a).sum(axis=1), np.ones(len(a), np.float32)])
    b = np.column_stack([b, np.ones(len(b), np.float32), (b * b).sum(axis=1)])
    most = np.float32(limit + COARSE)
    for (x, y), (start, end) in own.items():
        around = [other[c] for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (c := (x + dx, y + dy)) in other]
        for at in range(start, end, MEET):
            stop = min(at + MEET, end)
            for s, e in around:
                low, high = s + np.searchsorted(near_r[s:e], (near_l[at] - width, near_l[stop - 1] + width))
                if low < high:
                    hit = np.flatnonzero((a[at:stop] @ b[low:high].T).ravel() <= most)
                    if len(hit):
                        i, j = np.divmod(hit, high - low)
                        yield order_l[at + i], order_r[low + j]


def _links(own: np.ndarray, other: np.ndarray | None, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of unit vectors that verify, each pair once; without others, of own vectors among themselves."""
    same = other is None
    other = own if same else other
    turn = rotation(own.shape[1])
    a = own @ turn
    b = a if same else other @ turn
    parts = blocks(own.shape[1])
    limits = [budget * (p.stop - p.start) / own.shape[1] + SLACK for p in parts]

    def verified(block: int, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for s in range(0, len(x), VERIFY):
            i, j = x[s : s + VERIFY], y[s : s + VERIFY]
            good = (own[i] * other[j]).sum(axis=1) >= 1 - budget / 2
            i, j = i[good], j[good]
            gap = (a[i] - b[j]) ** 2
            first = gap[:, parts[block]].sum(axis=1) <= limits[block]
            for k in range(block):
                first &= gap[:, parts[k]].sum(axis=1) > limits[k]
            yield i[first], j[first]

    for block, part in enumerate(parts):
        held, size = [], 0
        for i, j in _candidates(a[:, part], b[:, part], limits[block]):
            if same:
                up = i < j
                i, j = i[up], j[up]
            held.append((i, j))
            size += len(i)
            if size >= VERIFY:
                yield from verified(block, *map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if held:
            yield from verified(block, *map(np.concatenate, zip(*held, strict=True)))


def _trees(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place that links reach, for each of n places."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _joined(own: np.ndarray, n: np.ndarray, other: np.ndarray | None, budget: float, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of links of every vector (own before others; n: the rows that hold it) and the place of the least id that these links reach."""
    order = np.argsort(ids, kind="stable")  # roots are least places, so places go by id
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    held, size = [], 0
    shift = 0 if other is None else len(own)

    def merged() -> np.ndarray:
        i, j = map(np.concatenate, zip(*held, strict=True))
        done = np.flatnonzero(root != np.arange(len(root)))
        return _trees(len(root), np.concatenate([place[i], done]), np.concatenate([place[j], root[done]]))

    for i, j in _links(own, other, budget):
        if not len(i):
            continue
        j = j + shift
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        held.append((i, j))
        size += len(i)
        if size >= HELD:
            root = merged()
            held, size = [], 0
    if held:
        root = merged()
    return links, order[root[place]]


def _tiles(files: list[str], points: int) -> list[list[tuple[int, int, int, int]]]:
    """Tiles of at most so many rows: of each the files' numbers, row groups, and the first and last row in them."""
    tiles: list[list[tuple[int, int, int, int]]] = []
    free = 0
    for f, uri in enumerate(files):
        store, path = pyarrow.fs.FileSystem.from_uri(uri)
        with store.open_input_file(path) as handle:
            about = pq.ParquetFile(handle).metadata
            sizes = [about.row_group(g).num_rows for g in range(about.num_row_groups)]
        for g, size in enumerate(sizes):
            at = 0
            while at < size:
                if not free:
                    tiles.append([])
                    free = points
                end = min(size, at + free)
                tiles[-1].append((f, g, at, end))
                free -= end - at
                at = end
    return tiles


def _read(files: list[str], tile: list[tuple[int, int, int, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """dims -> ids, h, n and unit vectors of a tile."""
    got = []
    for f, g, start, end in tile:
        store, path = pyarrow.fs.FileSystem.from_uri(files[f])
        with store.open_input_file(path) as handle:
            got.append(pq.ParquetFile(handle).read_row_group(g, columns=["dims", "id", "h", "n", "vector"]).slice(start, end - start))
    table = pa.concat_tables(got)
    dims, ids, h, n = (table[c].to_numpy() for c in ("dims", "id", "h", "n"))
    out = {}
    for d in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == d)
        out[d] = ids[rows], h[rows], n[rows], unit(matrix(table["vector"].take(pa.array(rows)).to_pylist(), d))
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, threshold: float = 0.95, tile_points: int = TILE_POINTS) -> DataFrame:
    """vec_id, n_links (other vectors of cosine >= threshold), component_id (least id that links reach) and kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing.
    Vectors of unlike lengths never link. Equal vectors are joined as one and their links counted
    for each; an id that several rows hold counts each row as a vector with links of its own (64
    bits tell them apart), and their component is shared. A null id is a row of its own, without links. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    base = pick(vectors, vec_id=id_col, embedding=vector_col).withColumn("vec_id", F.col("vec_id").cast("long"))
    base = base.withColumn("embedding", F.col("embedding").cast("array<double>"))
    base = base.withColumn("embedding", F.when(valid() & F.col("vec_id").isNotNull(), F.transform("embedding", lambda x: x + 0.0)))
    budget = 2 * (1 - threshold)
    schema = pa.schema([("vec_id", pa.int64()), ("dims", pa.int32()), ("vector", pa.binary())])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors as bytes, null where they take no part."""
        for batch in batches:
            lists = batch["embedding"]
            dims = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(dims) - dims
            held = np.full(len(dims), None, object)
            for d in np.unique(dims[dims > 0]):
                rows = np.flatnonzero(dims == d)
                held[rows] = blobs(flat[starts[rows][:, None] + np.arange(d)])
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(dims, pa.int32()), pa.array(held.tolist(), pa.binary())], schema=schema)

    rows = base.mapInArrow(coded, "vec_id long, dims int, vector binary")
    digest = F.unhex(F.sha2(F.concat(F.col("dims").cast("string").cast("binary"), F.lit(b":"), F.col("vector")), 256)).alias("digest")
    classes = rows.where("vector is not null").groupBy("dims", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).withColumn("h", F.xxhash64("dims", "vector"))
    classes = written(classes, "classes", **{"parquet.block.size": str(GROUP_BYTES), "parquet.enable.dictionary": "false"})
    files = sorted(classes.inputFiles())
    cores = spark.sparkContext.defaultParallelism
    points = max(1, min(tile_points, max(LEAST_POINTS, int(classes.count() / np.sqrt(8 * cores)) + 1)))
    tiles = _tiles(files, points)
    # row i of the triangle of pairs starts here
    starts = np.concatenate([[0], np.cumsum(np.arange(len(tiles), 0, -1))])
    result = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, {}
        for batch in batches:
            for pair in batch["id"].to_pylist():
                i = int(np.searchsorted(starts, pair, side="right")) - 1
                j = i + pair - int(starts[i])
                if i != at:
                    at, own = i, _read(files, tiles[i])
                other = own if i == j else _read(files, tiles[j])
                for d in own.keys() & other.keys():
                    both = [own[d]] if i == j else [own[d], other[d]]
                    ids, h, n = (np.concatenate([side[k] for side in both]) for k in range(3))
                    links, root = _joined(own[d][3], n, None if i == j else other[d][3], budget, ids)
                    hit = np.flatnonzero(links)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(h[hit]), pa.array(links[hit]), pa.array(ids[root[hit]])], schema=result)
        give_back()

    pairs = int(starts[-1])
    found = written(spark.range(0, pairs, 1, max(1, min(pairs, max(4 * cores, pairs // 8)))).mapInArrow(join, "id long, h long, links long, root long"), "links")
    links = found.groupBy("id", "h").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    done = classes.select("id", "h", "n", digest).join(links, ["id", "h"], "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    done = done.select("digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    # rows are matched by a digest of their vector, so that no vector is shuffled again
    out = rows.select("vec_id", digest).join(done, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
