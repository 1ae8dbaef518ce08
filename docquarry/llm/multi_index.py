"""Embedding near-duplicates through an inverted multi-index.

Unit vectors are cut in two halves, each with its own codebook of k centroids, fitted by k-means on a bounded
sample. A vector lies in the cell of its two nearest centroids, one of k * k. A search visits cells by rising
distance from the query: for each half, the bisectors between centroids bound how near a vector of another
centroid can be, and the multi-sequence traversal takes cells in order of the sum of the two squared bounds
until that exceeds what the target recall asks for (see shell()). Visited cells are verified in double precision.

Equal vectors count as one with a weight. Cells are cut into blocks of bounded size, and a task compares one block
of searching vectors with one block of a cell; it returns counts and its own components, never pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut
from .components import components, small


@dataclass(frozen=True)
class Index:
    """Parameters of the index. A fit reads ``sample`` vectors at most; all vectors are indexed."""

    centroids: int | None = None  #: of each half; by default the cube root of a hundredth of the vectors, 8 at least
    sample: int = 20_000
    rounds: int = 8  #: of k-means
    target_recall: float = 0.9995
    block: int = 2_048  #: vectors of a cell that one comparison takes


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return np.maximum(0.0, (x * x).sum(1)[:, None] - 2 * x @ book.T + (book * book).sum(1)[None])


def fit_book(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centroids by k-means from evenly spaced rows; a centroid without rows stays where it is."""
    book = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        at = _nearest(x, book).argmin(1)
        for c in np.unique(at):
            book[c] = x[at == c].mean(0)
    return book


def _bounds(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's centroid, and for each centroid the squared distance below which none of its vectors can be."""
    d = _nearest(x, book)
    own = d.argmin(1)
    gap = np.sqrt(_nearest(book, book))
    plane = np.zeros_like(d)
    with np.errstate(divide="ignore", invalid="ignore"):
        for j in range(len(book)):  # a vector of i is nearer to i than to any j
            plane = np.maximum(plane, np.where(gap[j] > 0, (d - d[:, j : j + 1]) / (2 * gap[j]), 0.0))
    return own, plane**2


def visits(first: np.ndarray, second: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Multi-sequence traversal: cells (i, j) by rising first[i] + second[j], as long as that is within ``limit``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, pushed = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}
    while heap:
        bound, i, j = heapq.heappop(heap)
        if bound > limit:
            return
        yield int(a[i]), int(b[j])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in pushed:
                pushed.add((p, q))
                heapq.heappush(heap, (first[a[p]] + second[b[q]], p, q))


def shell(threshold: float, dim: int, recall: float) -> float:
    """The sum of squared bounds up to which cells are visited.

    Partners differ by at most |p - q|^2 = 2 - 2 cos. That is the limit for recall 1. A difference of any direction has
    a share of 1 / dim of it along each of the two bisectors' normals, about normally, so that their squares together
    exceed the limit with probability exp(-limit * dim / (2 |p - q|^2)); at the threshold that is 1 - recall, and less for nearer pairs.
    """
    most = 2 - 2 * threshold
    return most + 1e-9 if recall >= 1 else min(most, 2 * most / dim * float(np.log(1 / (1 - recall)))) + 1e-9


def _local_components(linked: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """(node, smallest node) of the components of a block of links between ``rows`` and ``cols``."""
    some_r, some_c = linked.any(1), linked.any(0)
    linked, rows, cols = linked[some_r][:, some_c], rows[some_r], cols[some_c]
    if not len(rows):
        return []
    big = np.iinfo(np.int64).max
    of_r, of_c = rows.copy(), cols.copy()
    while True:
        new_c = np.minimum(of_c, np.where(linked, of_r[:, None], big).min(0))
        new_r = np.minimum(of_r, np.where(linked, new_c[None], big).min(1))
        # a vector may stand on both sides
        low = dict(zip(cols.tolist(), new_c.tolist(), strict=True))
        new_r = np.array([min(x, low.get(r, x)) for r, x in zip(rows.tolist(), new_r.tolist(), strict=True)], np.int64)
        if (new_r == of_r).all() and (new_c == of_c).all():
            return [*zip(rows.tolist(), of_r.tolist(), strict=True), *zip(cols.tolist(), of_c.tolist(), strict=True)]
        of_r, of_c = new_r, new_c


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, index: Index = Index()) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of (vec_id, embedding).

    Vectors link when their cosine in double precision is ``threshold`` or more. n_links: other rows linked
    directly; component_id: the smallest vec_id reachable by links, itself included; kept: whether that is its own.
    Vectors that are null, zero, or hold null or non-finite components link with nothing, and vectors of
    different lengths not with each other. Equal vectors link. Rows with one vec_id and one vector are two rows that link. Extra columns are left out.
    """
    spark = vectors.sparkSession
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    # vectors are scaled by their largest component before anything is squared
    usable = F.coalesce(F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(doubles, lambda x: x != 0), F.lit(False))
    rows = cut(vectors.select("vec_id", F.when(usable, doubles).alias("v")))
    # equal vectors are counted before they meet; the key is a 128-bit hash of the components
    key = F.struct(F.xxhash64("v").alias("x"), F.xxhash64(F.lit(1), "v").alias("y"))
    keyed = rows.where("v is not null").withColumn("key", key)
    distinct = keyed.groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("v").alias("v"))
    distinct = cut(distinct.select("key", "id", "weight", "v", F.size("v").alias("dim")))
    found = [_search(distinct.where(F.col("dim") == d.dim), threshold, index) for d in distinct.select("dim").distinct().collect()]
    empty = spark.createDataFrame([], "id long, links long, root long")
    searched = empty
    for x in found:
        searched = searched.unionByName(x)
    searched = cut(searched)
    counts = searched.groupBy("id").agg(F.sum("links").alias("links"))
    grouped = cut(components(searched.where("root is not null").select(F.col("id").alias("a"), F.col("root").alias("b"))))
    per_vector = distinct.select("key", "id", "weight").join(small(cut(counts)), "id", "left").join(small(grouped), F.col("id") == F.col("node"), "left")
    per_vector = cut(per_vector.select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    out = rows.withColumn("key", F.when(F.col("v").isNotNull(), key)).join(small(per_vector), "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _search(distinct: DataFrame, threshold: float, index: Index) -> DataFrame:
    """(id, links, root): parts of each vector's links, and links enough to make the components."""
    spark = distinct.sparkSession
    sample = distinct.orderBy(F.xxhash64("id")).limit(index.sample).select("v").toPandas()["v"]
    x = np.stack(sample.to_numpy())
    x = x / np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    half = x.shape[1] // 2
    k = index.centroids or max(8, round((distinct.count() / 100) ** (1 / 3)))
    books = spark.sparkContext.broadcast((fit_book(x[:, :half], k, index.rounds), fit_book(x[:, half:], k, index.rounds)))
    limit = shell(threshold, x.shape[1], index.target_recall)

    def unit(batch: pa.RecordBatch) -> np.ndarray:
        v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
        scale = np.abs(v).max(1, keepdims=True)
        v = v / scale
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each cell that a vector lies in (home) or visits."""
        first, second = books.value
        for batch in (whole.slice(i, 512) for whole in batches for i in range(0, len(whole), 512)):
            v = unit(batch)
            own_a, bound_a = _bounds(v[:, :half], first)
            own_b, bound_b = _bounds(v[:, half:], second)
            at, cells, home = [], [], []
            for r in range(len(batch)):
                own = (int(own_a[r]), int(own_b[r]))
                for cell in visits(bound_a[r], bound_b[r], limit):
                    at.append(r)
                    cells.append(cell[0] * len(second) + cell[1])
                    home.append(cell == own)
            taken = pa.array(at, pa.int64())
            packed = pa.array([x.tobytes() for x in v], pa.binary())
            yield pa.record_batch([pa.array(cells, pa.int32()), pa.array(home, pa.bool_()), batch.column("id").take(taken), batch.column("weight").take(taken), packed.take(taken)], ["cell", "home", "id", "weight", "v"])

    placed = cut(distinct.select("id", "weight", "v").mapInArrow(place, "cell int, home boolean, id long, weight long, v binary"))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n_all"), F.count_if("home").alias("n_home")).where("n_home > 0")
    blocks = sizes.select("cell", F.ceil(F.col("n_all") / index.block).cast("int").alias("p"), F.ceil(F.col("n_home") / index.block).cast("int").alias("q"))
    dealt = placed.join(small(cut(blocks)), "cell")  # at most k * k rows
    # a searching vector goes to one of p blocks and meets all q blocks of the cell; a vector at home is met by all p
    one = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = dealt.select("cell", one("p").alias("i"), every("q").alias("j"), F.lit(True).alias("asks"), "id", "weight", "v")
    holds = dealt.where("home").select("cell", every("p").alias("i"), one("q").alias("j"), F.lit(False).alias("asks"), "id", "weight", "v")

    def compare(table):
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        v = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float64).reshape(len(table), -1)
        ids, weight = table.column("id").to_numpy(), table.column("weight").to_numpy()
        held, held_id, held_weight = v[~asks], ids[~asks], weight[~asks]
        who, own, out = v[asks], ids[asks], []
        linked = (who @ held.T >= threshold) & (own[:, None] != held_id[None])
        links = linked @ held_weight
        some = links > 0
        out += zip(own[some].tolist(), links[some].tolist(), [None] * int(some.sum()), strict=True)
        out += [(a, 0, b) for a, b in _local_components(linked, own, held_id) if a != b]
        got = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"id": pa.array(got[0], pa.int64()), "links": pa.array(got[1], pa.int64()), "root": pa.array(got[2], pa.int64())})

    return asks.unionByName(holds).groupBy("cell", "i", "j").applyInArrow(compare, "id long, links long, root long")
