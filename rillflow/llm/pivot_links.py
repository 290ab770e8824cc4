"""Near-duplicate vectors: a pivot-permutation index, inverted lists and verification by cosine.

A bounded sample of mutually distant vectors are the pivots.  Every vector is
described by its ``NEAREST`` nearest pivots in order of similarity.  The inverted
lists are kept by sets of ``SHARED`` pivots: a vector stands in the list of every
such subset of its nearest pivots, so two vectors meet in some list exactly when
they share that many pivots, and no pair is written down to count them.

A pair that shares more pivots meets in several lists and is counted in one only:
the list of the smallest pivots that both have.  Each list checks this from the
pivots of its rows before it multiplies anything; what is left is verified by
cosine in double precision.  A list returns a number of links for each row and a
spanning forest of its links, never the links themselves.

Equal vectors are one class with a multiplicity, so copies are not compared.
Lists longer than ``BLOCK_ROWS`` are cut to blocks, compared pairwise in tasks of
their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from rillflow.llm.components import components
from rillflow.llm.counted_join import join_counted
from rillflow.llm.near_dedup import _by_group, _dealt, _edges
from rillflow.plans.lineage import materialize

LEAST_COSINE = 0.93
#: The sample of pivots: at most so many for each of the so many commonest lengths of vectors; none is nearer to another one than this.
PIVOTS = 512
PIVOT_LENGTHS = 4
APART = 0.8
NEAREST = 8
SHARED = 3
BLOCK_ROWS = 1_024
#: A pivot's number takes so many bits of a list's number.
_BITS = 20
#: The list of all vectors of a length that has no pivots.
_ALL = -1
_KEYS = ["label", "dim", "list"]


def described(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, dim, name, vector) per row; name, a digest of label and vector, is null for what links with nothing."""
    kind = rows.schema[vector_col].dataType
    dtype = np.float32 if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else np.float64

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, names, vectors = [], [], []
            for vec_id, label, values in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                usable = vec_id is not None and label is not None and values and None not in values
                array = np.array(values, dtype) + dtype(0) if usable else None  # adding zero makes -0.0 and 0.0 one
                if usable and np.isfinite(array).all() and array.any():
                    vectors.append(array.tobytes())
                    names.append(hashlib.blake2b(vectors[-1], digest_size=16, key=hashlib.blake2b(label.encode()).digest()).digest())
                    dims.append(len(array))
                else:
                    vectors.append(None), names.append(None), dims.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(names, pa.binary()), pa.array(vectors, pa.binary())], names=["vec_id", "label", "dim", "name", "vector"])

    wanted = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"))
    return wanted.mapInArrow(describe, "vec_id long, label string, dim int, name binary, vector binary")


def unit_rows(vectors: list[bytes], dim: int) -> np.ndarray:
    """Packed vectors as rows of length one, in double precision."""
    data = b"".join(vectors)
    kind = np.float32 if len(data) == 4 * dim * len(vectors) else np.float64
    rows = np.frombuffer(data, kind).reshape(len(vectors), dim).astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # so that no square leaves the range of numbers
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def choose_pivots(nodes: DataFrame, pivots: int = PIVOTS) -> dict[int, np.ndarray]:
    """The pivots by length of vector: of the vectors with the smallest digests, those that are apart from all chosen before."""
    lengths = [r.dim for r in nodes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(PIVOT_LENGTHS).collect()]
    found = {}
    for dim in lengths:
        sample = unit_rows([bytes(r.vector) for r in nodes.filter(F.col("dim") == dim).orderBy("name").limit(2 * pivots).select("vector").collect()], dim)
        chosen = sample[:1]
        for row in sample[1:]:
            if len(chosen) < pivots and (chosen @ row).max() < APART:
                chosen = np.vstack([chosen, row])
        if len(chosen) > NEAREST:
            found[dim] = chosen
    return found


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The numbers of each vector's nearest pivots, nearest first."""
    likeness = vectors @ pivots.T
    near = np.argpartition(-likeness, NEAREST - 1, axis=1)[:, :NEAREST]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(likeness, near, axis=1), axis=1, kind="stable"), axis=1)


def with_pivots(nodes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Add ``nearest``, the description of each vector; null for a length without pivots."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(names.index("dim")).to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim))
                near = nearest_pivots(unit_rows(rows.column(names.index("vector")).to_pylist(), dim), pivots[dim]).tolist() if dim in pivots else None
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(near, pa.list_(pa.int32())) if near else pa.nulls(rows.num_rows, pa.list_(pa.int32()))], names=[*names, "nearest"])

    names = nodes.columns
    return nodes.mapInArrow(place, ", ".join(f"{name} {kind}" for name, kind in nodes.dtypes) + ", nearest array<int>")


def inverted_lists(nodes: DataFrame) -> DataFrame:
    """(label, dim, list, name): every class in the list of each subset of ``SHARED`` of its pivots; a length without pivots has one list of all."""
    ordered = F.transform(F.array_sort("nearest"), lambda x: x.cast("long"))
    numbers = [reduce(Column.bitwiseOR, [F.shiftleft(F.col("ordered")[at], _BITS * (SHARED - 1 - k)) for k, at in enumerate(subset)]) for subset in combinations(range(NEAREST), SHARED)]
    numbers = F.when(F.col("ordered").isNull(), F.array(F.lit(_ALL).cast("long"))).otherwise(F.array(*numbers))
    return nodes.withColumn("ordered", ordered).select("label", "dim", F.explode(numbers).alias("list"), "name")


def counted_here(nearest: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list count a pair there: (allowed, pattern), so that rows x and y do where ``allowed[pattern[x], pattern[y]]``.

    They do if they share no pivot, but the list's own, below the list's largest one.
    """
    own = [(number >> (_BITS * k)) & ((1 << _BITS) - 1) for k in range(SHARED)]
    others = np.where((nearest < own[0]) & ~np.isin(nearest, own), nearest, -1)
    kinds, pattern = np.unique(np.sort(others, axis=1), axis=0, return_inverse=True)
    has = np.zeros((len(kinds), int(kinds.max(initial=0)) + 2), np.float32)
    np.put_along_axis(has, kinds + 1, 1, axis=1)
    return has[:, 1:] @ has[:, 1:].T == 0, pattern.ravel()


def spanning_pairs(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links."""
    open_, pairs = linked.any(axis=1), []
    while open_.any():
        front = [int(np.argmax(open_))]
        open_[front[0]] = False
        while front:
            at = front.pop()
            new = np.flatnonzero(linked[at] & open_).tolist()
            open_[new] = False
            front += new
            pairs += [(at, x) for x in new]
    return pairs


def block_links(met: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(name, n_links, u, v): numbers of links by class in rows of a name, forest edges between classes' smallest ids in the others."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, lo, hi in _by_group(batches, 5):
            part = table.slice(lo, hi - lo)
            (dim, number, a, b), same = (part.column(k)[0].as_py() for k in range(1, 5)), part.column(5).to_numpy()
            names, ids, copies = part.column(6).to_pylist(), part.column(7).to_pylist(), part.column(8).to_numpy()
            vectors = unit_rows(part.column(9).to_pylist(), dim)
            if number == _ALL:
                allowed, pattern = np.ones((1, 1), bool), np.zeros(hi - lo, np.int64)
            else:
                allowed, pattern = counted_here(np.array(part.column(10).to_pylist(), np.int64), number)
            if not allowed.any():
                continue
            linked = np.zeros((hi - lo, hi - lo), bool)
            for at in range(0, hi - lo, BLOCK_ROWS):
                rows = slice(at, at + BLOCK_ROWS)
                linked[rows] = (vectors[rows] @ vectors.T >= least) & allowed[np.ix_(pattern[rows], pattern)]
                if a != b:
                    linked[rows] &= same[rows, None] != same[None, :]
            np.fill_diagonal(linked, False)
            linked |= linked.T  # products of one pair may differ in their last digit
            n = linked @ copies
            some = np.flatnonzero(n).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in some], pa.binary()), pa.array(n[some], pa.int64()), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64())], names=["name", "n_links", "u", "v"])
            edges = _edges([(ids[x], ids[y]) for x, y in spanning_pairs(linked)])
            yield pa.RecordBatch.from_arrays([pa.nulls(edges.num_rows, pa.binary()), pa.nulls(edges.num_rows, pa.int64()), *edges.columns], names=["name", "n_links", "u", "v"])

    by_class = met.groupBy("name").agg(F.collect_list(F.struct("list", F.col("n").alias("n_list"))).alias("lists"))  # at most one for each subset
    parts = F.ceil(F.col("l.n_list") / BLOCK_ROWS).cast("int")
    dealt = (
        nodes.join(by_class.hint("merge"), "name").select("label", "dim", F.explode("lists").alias("l"), "name", "node", "n", "vector", "nearest")
        .withColumn("own", F.pmod(F.xxhash64("name"), parts).cast("int"))
        .select("label", "dim", F.col("l.list").alias("list"), F.explode(_dealt(F.col("own"), parts)).alias("to"), "own", "name", "node", "n", "vector", "nearest")
        .select(*_KEYS, "to.a", "to.b", "own", "name", "node", "n", "vector", "nearest")
    )
    blocks = dealt.repartition(*_KEYS, "a", "b").sortWithinPartitions(*_KEYS, "a", "b", "name")
    return blocks.mapInArrow(compare, "name binary, n_links long, u long, v long")


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST_COSINE, pivots: int = PIVOTS) -> DataFrame:
    """Return one row per vector: vec_id, n_links, component_id, kept.

    Vectors of equal label and length are linked when their cosine is at least
    ``least``.  A row links with nothing when its id, label or vector is null, or
    when the vector is empty, zero or holds null or non-finite components; its
    component is its own id (null for a null id) and it is kept.  Rows repeated
    with one id and vector are rows of their own and linked; an id with several
    vectors takes part with each.  An empty table gives an empty result; further
    columns are ignored whatever their names.

    The index holds every vector and no list is cut.  What it can miss is a pair
    that shares fewer than ``SHARED`` of the ``NEAREST`` nearest of at most ``pivots``
    pivots; the README states the recall.  Larger inputs want more pivots, as
    lists of vectors that are not near grow with the rows.
    """
    marks = materialize(described(rows, id_col, vector_col, label_col), "vectors")
    valid = F.col("name").isNotNull()
    nodes = marks.filter(valid).groupBy("name").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), F.any_value("label").alias("label"), F.any_value("dim").alias("dim"), F.any_value("vector").alias("vector"))
    nodes = materialize(nodes, "vector-classes")
    nodes = materialize(with_pivots(nodes, choose_pivots(nodes, pivots)), "vector-pivots")
    listed = materialize(inverted_lists(nodes), "inverted-lists")
    shared = materialize(listed.groupBy(*_KEYS).agg(F.count("*").alias("n")).filter("n > 1"), "shared-lists")
    found = materialize(block_links(join_counted(listed, shared, _KEYS), nodes, least), "vector-links")
    links = found.filter(valid).groupBy("name").agg(F.sum("n_links").alias("n_links"))
    named = components(found.filter(F.col("u").isNotNull()).select("u", "v"))
    by_class = nodes.select("name", "node", "n").join(links, "name", "left").join(named, "node", "left")
    by_class = by_class.select("name", "n", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    alone = marks.filter(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = join_counted(marks.filter(valid).select("vec_id", "name"), materialize(by_class, "vector-components"), ["name"])
    return linked.select("vec_id", "n_links", "component_id").unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
