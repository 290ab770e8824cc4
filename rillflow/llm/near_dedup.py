"""Near-duplicate documents: b-bit MinHash signatures and a multi-index Hamming join.

A signature holds ``HASHES`` min-wise values of 16 bits.  Two texts of similarity s
differ in ``HASHES * (1 - s)`` values on average; the distance threshold lies five
standard deviations above (23 of 64 at 0.85, 28 at 0.80).  Split into
``distance // 2 + 1`` chunks, two signatures within the threshold have, by the
pigeonhole principle, a chunk with at most one differing value.  Every chunk is
therefore indexed once for each value that may differ, with that value left out,
so all pairs within the threshold meet under at least one key.

Texts with equal sets are one node.  Nodes that meet under a key are compared by
their signatures, and only those within the threshold go on: a key's nodes are
reduced to a forest of such pairs, so the rows do not grow with the square of a
key.  Connected pairs form families.  Links are then confirmed on full sets: every
node with the best connected node of its family, and the nodes that this leaves
loose with all others of the family whose signature is near.

Keys and families of any size are cut to blocks.  First every node is compared with
one node, a key's smallest or a family's center, which goes to each block as one
row; only the nodes that this leaves loose are compared with all others, block
against block in tasks of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.components import components
from rillflow.llm.counted_join import join_counted
from rillflow.llm.shingles import MinHasher, mix64, shingle_sets
from rillflow.plans.lineage import materialize

#: Least similarity of linked texts, in hundredths; a caller with a contract of its own passes another.
PERCENT = 80
HASHES = 64
#: Rows and bytes of a block of a key's signatures, and of a family's sets.
KEY_ROWS = 4_096
BLOCK_ROWS = 1_024
BLOCK_BYTES = 8 << 20
#: Rows of an Arrow batch whose texts are unpacked at a time.
SLICE_ROWS = 1_000


def distance_limit(percent: int, hashes: int = HASHES) -> int:
    """The signature distance that texts of the link similarity stay within: mean and five standard deviations."""
    differ = 1 - percent / 100
    return int(hashes * differ + 5 * (hashes * differ * (1 - differ)) ** 0.5)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in smaller parts, which bounds what a worker holds unpacked."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, set_hash, signature) per document; the last two are null for an empty set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher(HASHES)
        for batch in _slices(batches):
            sizes, names, signatures = [], [], []
            for values in shingle_sets(batch.column(1).to_pylist()):
                sizes.append(len(values))
                names.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
                signatures.append(hasher.signature(values).tobytes() if len(values) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(signatures, pa.binary())], names=["doc_id", "n_shingles", "set_hash", "signature"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(sketch, "doc_id long, n_shingles long, set_hash binary, signature binary")


def unpack(signatures: list[bytes]) -> np.ndarray:
    """(n, HASHES) values of packed signatures."""
    return np.frombuffer(b"".join(signatures), dtype=np.uint16).reshape(-1, HASHES)


def chunk_keys(signatures: np.ndarray, chunks: int) -> np.ndarray:
    """64-bit index keys of an (n, HASHES) array of uint16: per chunk, one key for each value left out."""
    limits = np.linspace(0, HASHES, chunks + 1).astype(int)
    wide = signatures.astype(np.uint64)
    keys = np.empty((len(wide), HASHES), dtype=np.uint64)
    for chunk, (lo, hi) in enumerate(zip(limits[:-1], limits[1:], strict=True)):
        for out in range(lo, hi):
            key = np.full(len(wide), chunk * 64 + out - lo + 1, dtype=np.uint64)
            for at in range(lo, hi):
                if at != out:
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, at])
            keys[:, out] = key
    return keys


def index_keys(nodes: DataFrame, distance: int) -> DataFrame:
    """(key, node): every node under each of its index keys."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            values = pa.array(chunk_keys(unpack(batch.column(1).to_pylist()), distance // 2 + 1).view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([values, pa.array(np.repeat(batch.column(0).to_numpy(), HASHES))], names=["key", "node"])

    return nodes.select("node", "signature").mapInArrow(keys, "key long, node long")


class Forest:
    """Union-find over places; keeps the pairs that connected something."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))
        self.pairs: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def link(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[a] = b
            self.pairs.append((x, y))


def near_rows(signatures: np.ndarray, at: int, distance: int) -> np.ndarray:
    """Which rows are within the distance of row ``at``."""
    return (signatures != signatures[at]).sum(axis=1) <= distance


def key_forest(signatures: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within the distance: the first row with all, then the rows it leaves loose with all."""
    forest = Forest(len(signatures))
    near = near_rows(signatures, 0, distance)
    for other in np.flatnonzero(near)[1:].tolist():
        forest.link(0, other)
    for k in np.flatnonzero(~near).tolist():
        for other in np.flatnonzero(near_rows(signatures, k, distance)).tolist():
            forest.link(k, other)
    return forest.pairs


def _by_group(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.Table, int, int]]:
    """(table, first row, row after) of every group of a sorted stream, by its first ``n_keys`` columns; only one group at a time is held whole."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
        change = np.zeros(max(0, table.num_rows - 1), bool)
        for k in range(n_keys):
            values = table.column(k).to_numpy()
            change |= values[1:] != values[:-1]
        limits = [0, *(np.flatnonzero(change) + 1).tolist()]
        for lo, hi in zip(limits, limits[1:], strict=False):
            yield table, lo, hi
        rest = table.slice(limits[-1]).combine_chunks() if table.num_rows else rest
    if rest is not None and rest.num_rows:
        yield rest, 0, rest.num_rows


def _dealt(own: Column, parts: Column) -> Column:
    """Every pair of blocks (a, b), a <= b, that a row of block ``own`` belongs to."""
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda x: F.struct(F.least(own, x).alias("a"), F.greatest(own, x).alias("b")))


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["u", "v"])


def candidate_pairs(nodes: DataFrame, distance: int) -> DataFrame:
    """(u, v): pairs within the signature distance that connect all that are connected by such pairs."""
    keyed = index_keys(nodes, distance)
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("all")).filter("low < high")
    # keys that the same nodes share are one: their least, greatest, number and combined hash agree
    shared = materialize(shared.groupBy("low", "high", "n", "all").agg(F.min("key").alias("key")).drop("all"), "shared")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(iter([batch])):
                near = (unpack(part.column(2).to_pylist()) != unpack(part.column(3).to_pylist())).sum(axis=1) <= distance
                yield part.select(["u", "v"]).filter(pa.array(near))

    # keys of two nodes are pairs already
    signed = lambda name: nodes.select(F.col("node").alias(name), F.col("signature").alias(f"{name}_signature"))
    twos = shared.filter("n = 2").select(F.col("low").alias("u"), F.col("high").alias("v")).distinct()
    twos = twos.join(signed("u").hint("merge"), "u").join(signed("v").hint("merge"), "v").select("u", "v", "u_signature", "v_signature").mapInArrow(compare, "u long, v long")

    many = materialize(shared.filter("n > 2").select("key", "low", "n"), "larger")
    found = materialize(key_pairs(_signed(join_counted(keyed, many, ["key"]), nodes), distance), "key-pairs")
    loose = found.filter("key is not null").select("key", F.col("v").alias("node"))
    pairs = twos.unionByName(found.filter("key is null").select("u", "v"))
    if not loose.isEmpty():
        load = loose.groupBy("key").agg(F.count("*").alias("n_loose")).join(many.hint("merge"), "key")
        met = join_counted(keyed, materialize(load.select("key", "n", "n_loose"), "loose-keys"), ["key"])
        marked = met.join(loose.withColumn("loose", F.lit(True)).hint("merge"), ["key", "node"], "left").withColumn("loose", F.coalesce("loose", F.lit(False)))
        pairs = pairs.unionByName(loose_pairs(_signed(marked, nodes), distance))
    return pairs.distinct()


def _signed(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows with their nodes' signatures, which are joined once for all keys of a node (at most HASHES)."""
    by_node = met.groupBy("node").agg(F.collect_list(F.struct(*[c for c in met.columns if c != "node"])).alias("keys"))
    return nodes.select("node", "signature").join(by_node.hint("merge"), "node").select("node", "signature", F.explode("keys").alias("k")).select("k.*", "node", "signature")


def in_parts(rows: DataFrame) -> DataFrame:
    """(key, part, n, node, signature): keys of more than ``KEY_ROWS`` nodes in parts of that size, with the key's lowest node in each."""
    parts = F.ceil(F.col("n") / KEY_ROWS).cast("int")
    to = F.when(F.col("node") == F.col("low"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), parts).cast("int")))
    return rows.select("key", F.explode(to).alias("part"), "n", "node", "signature")


def key_pairs(rows: DataFrame, distance: int) -> DataFrame:
    """(key, u, v): pairs within the distance, with a null key, and of larger keys the nodes v that are not near the lowest one.

    A key's nodes are reduced to a forest; those of a larger key, part by part, are compared with
    its lowest node only, so that the work grows with the number of its nodes.
    """

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int | None, int | None, int]] = []
        for table, lo, hi in _by_group(batches, 2):
            key, n = table.column(0)[lo].as_py(), table.column(2)[lo].as_py()
            ids = table.column(3).slice(lo, hi - lo).to_pylist()
            signatures = unpack(table.column(4).slice(lo, hi - lo).to_pylist())
            if n <= KEY_ROWS:
                found += [(None, ids[a], ids[b]) for a, b in key_forest(signatures, distance)]
            else:
                near = near_rows(signatures, 0, distance).tolist()
                found += [(None, ids[0], ids[k]) if near[k] else (key, None, ids[k]) for k in range(1, hi - lo)]
            if len(found) >= 10_000:
                yield _marked(found)
                found = []
        yield _marked(found)

    blocks = in_parts(rows).repartition("key", "part").sortWithinPartitions("key", "part", "node")
    return blocks.mapInArrow(forests, "key long, u long, v long")


def _marked(found: list[tuple]) -> pa.RecordBatch:
    rows = list(dict.fromkeys(found))
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in range(3)], names=["key", "u", "v"])


def loose_pairs(rows: DataFrame, distance: int) -> DataFrame:
    """(u, v): of each key's nodes that its lowest one left loose, a forest with all others of the key, block against block."""
    own = lambda parts: F.pmod(F.xxhash64("node"), parts).cast("int")
    loose_parts, tied_parts = (F.greatest(F.lit(1), F.ceil(n / KEY_ROWS)).cast("int") for n in (F.col("n_loose"), F.col("n") - F.col("n_loose")))
    to = lambda tied, a, b: F.struct(F.lit(tied).alias("tied"), a.alias("a"), b.alias("b"))
    among = F.transform(_dealt(own(loose_parts), loose_parts), lambda x: to(False, x["a"], x["b"]))
    with_tied = F.transform(F.sequence(F.lit(0), tied_parts - 1), lambda x: to(True, own(loose_parts), x))
    tied = F.transform(F.sequence(F.lit(0), loose_parts - 1), lambda x: to(True, x, own(tied_parts)))
    dealt = rows.select("key", F.explode(F.when(F.col("loose"), F.concat(among, with_tied)).otherwise(tied)).alias("to"), "node", "loose", "signature").select("key", "to.tied", "to.a", "to.b", "node", "loose", "signature")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, lo, hi in _by_group(batches, 4):
            ids, loose, packed = (table.column(k).slice(lo, hi - lo).to_pylist() for k in (4, 5, 6))
            signatures, forest = unpack(packed), Forest(hi - lo)
            for k in np.flatnonzero(loose).tolist():
                for other in np.flatnonzero(near_rows(signatures, k, distance)).tolist():
                    forest.link(k, other)
            yield _edges([(ids[x], ids[y]) for x, y in forest.pairs])

    return dealt.repartition("key", "tied", "a", "b").sortWithinPartitions("key", "tied", "a", "b").mapInArrow(compare, "u long, v long")


def families(pairs: DataFrame) -> DataFrame:
    """(node, family, center): connected nodes, and the node of each family that is in most pairs."""
    ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).groupBy("node").agg(F.count("*").alias("n"))
    by_family = materialize(ends.join(components(pairs).withColumnRenamed("component", "family"), "node"), "families")
    centers = materialize(by_family.groupBy("family").agg(F.max(F.struct("n", (-F.col("node")).alias("other"))).alias("best"), F.count("*").alias("n")).select("family", (-F.col("best.other")).alias("center"), "n"), "centers")
    return materialize(join_counted(by_family.select("node", "family"), centers, ["family"]).select("node", "family", "center"), "members")


def member_sets(docs: DataFrame, members: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, family, center, signature, values): the full shingle sets of the families' members."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            keep, values = [], []
            for k, (want, found) in enumerate(zip(batch.column(5).to_pylist(), shingle_sets(batch.column(4).to_pylist()), strict=True)):
                data = found.tobytes()
                if hashlib.blake2b(data, digest_size=16).digest() == want:  # a row that repeats the id with another text is another node's
                    keep.append(k)
                    values.append(data)
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(values, pa.binary())], names=["node", "family", "center", "signature", "values"])

    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    wanted = members.join(nodes.drop("n").hint("merge"), "node")
    return texts.join(wanted.hint("merge"), "node").select("node", "family", "center", "signature", "text", "set_hash").mapInArrow(sets, "node long, family long, center long, signature binary, values binary")


def similar(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int = PERCENT):
    """The link rule on an intersection's size and both set sizes, in integers."""
    return 100 * common >= percent * (a + b - common)


class Sets:
    """A block's full sets, for intersections of one with many."""

    def __init__(self, values: list[bytes], percent: int) -> None:
        arrays = [np.frombuffer(v, dtype=np.uint64) for v in values]
        self.percent = percent
        self.sizes = np.array([len(x) for x in arrays], dtype=np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
        _, self.ids = np.unique(np.concatenate(arrays), return_inverse=True)
        self.flags = np.zeros(len(self.ids) + 1, dtype=np.int64)

    def linked(self, k: int, others: np.ndarray) -> np.ndarray:
        """Those of the places ``others`` whose set is similar to that of place ``k``."""
        fits = np.minimum(self.sizes[others], self.sizes[k]) * 100 >= self.percent * np.maximum(self.sizes[others], self.sizes[k])
        others = others[fits]
        if not len(others):
            return others
        own = self.ids[self.begins[k] : self.begins[k + 1]]
        self.flags[own] = 1
        common = np.array([self.flags[self.ids[self.begins[x] : self.begins[x + 1]]].sum() for x in others.tolist()])
        self.flags[own] = 0
        return others[similar(common, self.sizes[k], self.sizes[others], self.percent)]


def _parts(n: str, size: str) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK_ROWS), F.ceil(F.col(size) / BLOCK_BYTES)).cast("int")


def center_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, family, center, linked) for all members but the centers; a center goes to each block of its family."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, lo, hi in _by_group(batches, 2):
            nodes, centers = (table.column(k).slice(lo, hi - lo).to_pylist() for k in (2, 3))
            center = nodes.index(centers[0])
            others = np.array([k for k in range(hi - lo) if k != center], dtype=np.int64)
            if not len(others):
                continue
            tied = set(Sets(table.column(4).slice(lo, hi - lo).to_pylist(), percent).linked(center, others).tolist())
            rows = table.slice(lo, hi - lo).take(pa.array(others))
            yield pa.RecordBatch.from_arrays([rows.column(k).combine_chunks() for k in (2, 0, 3)] + [pa.array([k in tied for k in others.tolist()], pa.bool_())], names=["node", "family", "center", "linked"])

    load = materialize(sets.groupBy("family").agg(F.count("*").alias("n"), F.sum(F.octet_length("values")).alias("size")).select("family", "n", _parts("n", "size").alias("parts")), "loads")
    to = F.when(F.col("node") == F.col("center"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))
    dealt = join_counted(sets, load, ["family"]).select("family", F.explode(to).alias("part"), "node", "center", "values")
    return dealt.repartition("family", "part").sortWithinPartitions("family", "part").mapInArrow(compare, "node long, family long, center long, linked boolean")


def loose_links(sets: DataFrame, verdicts: DataFrame, distance: int, percent: int = PERCENT) -> DataFrame:
    """(u, v): links of the nodes that their center did not take, block against block in their families."""
    marked = sets.join(verdicts.select("node", "linked").hint("merge"), "node", "left").withColumn("loose", ~F.coalesce("linked", F.lit(True)))
    sums = [F.sum(F.when(F.col("loose") == flag, value).otherwise(0)).alias(f"{what}_{name}") for flag, name in ((True, "loose"), (False, "tied")) for what, value in (("n", F.lit(1)), ("size", F.octet_length("values")))]
    load = marked.groupBy("family").agg(F.count("*").alias("n"), *sums).filter("n_loose > 0")
    load = materialize(load.select("family", "n", _parts("n_loose", "size_loose").alias("loose_parts"), _parts("n_tied", "size_tied").alias("tied_parts")), "loose-loads")

    def own(name: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(name)).cast("int")

    def to(tied: bool, a: Column, b: Column) -> Column:
        return F.struct(F.lit(tied).alias("tied"), a.alias("a"), b.alias("b"))

    each = F.sequence(F.lit(0), F.col("loose_parts") - 1)
    among = F.transform(_dealt(own("loose_parts"), F.col("loose_parts")), lambda x: to(False, x["a"], x["b"]))
    with_tied = F.transform(F.sequence(F.lit(0), F.col("tied_parts") - 1), lambda x: to(True, own("loose_parts"), x))
    targets = F.when(F.col("loose"), F.concat(among, with_tied)).otherwise(F.transform(each, lambda x: to(True, x, own("tied_parts"))))
    dealt = join_counted(marked, load, ["family"]).select("family", F.explode(targets).alias("to"), "node", "loose", "signature", "values").select("family", "to.tied", "to.a", "to.b", "node", "loose", "signature", "values")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, lo, hi in _by_group(batches, 4):
            nodes, loose, signatures, values = (table.column(k).slice(lo, hi - lo).to_pylist() for k in (4, 5, 6, 7))
            matrix, sets_, forest = unpack(signatures), Sets(values, percent), Forest(hi - lo)
            for k in np.flatnonzero(loose).tolist():
                near = np.flatnonzero(near_rows(matrix, k, distance))
                for other in sets_.linked(k, near[near != k]).tolist():
                    forest.link(k, other)
            yield _edges([(nodes[a], nodes[b]) for a, b in forest.pairs])

    return dealt.repartition("family", "tied", "a", "b").sortWithinPartitions("family", "tied", "a", "b").mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Return per document: doc_id, n_shingles, component_id, kept.

    Documents with a similarity of at least ``percent`` hundredths are linked.

    A document without words or text has no shingles and is linked with nothing.
    A row with a null id takes no part in links: its component_id is null and it
    is kept.  Rows repeated with one id have a row each and take part with each of
    their texts.  An empty table gives an empty result; further columns are ignored.
    """
    distance = distance_limit(percent)
    marks = materialize(sketches(docs, id_col, text_col), "sketches")
    nodes = marks.filter("n_shingles > 0 and doc_id is not null").groupBy("set_hash").agg(F.min(F.struct("doc_id", "signature")).alias("low"), F.count("*").alias("n"))
    nodes = materialize(nodes.select("set_hash", "n", F.col("low.doc_id").alias("node"), F.col("low.signature").alias("signature")), "nodes")
    members = families(materialize(candidate_pairs(nodes, distance), "pairs"))
    rows = docs.filter(F.col(id_col).isNotNull())
    sets = materialize(member_sets(rows, members, nodes, id_col, text_col).dropDuplicates(["node", "values"]), "sets")
    verdicts = materialize(center_links(sets, percent), "verdicts")
    links = verdicts.filter("linked").select(F.col("node").alias("u"), F.col("center").alias("v")).unionByName(loose_links(sets, verdicts, distance, percent))
    named = components(links)
    by_set = nodes.select("set_hash", "node", "n").join(named, "node", "left").select("set_hash", "n", F.coalesce("component", "node").alias("component"))
    return (
        join_counted(marks.filter("set_hash is not null and doc_id is not null"), materialize(by_set, "by-set"), ["set_hash"]).drop("n")
        .unionByName(marks.filter("set_hash is null or doc_id is null").withColumn("component", F.col("doc_id")))
        .select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))
    )


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents that stay, with all their columns: one of each component, and rows with a null id.

    Of rows repeated with one id all are returned.  An empty table gives an empty result.
    """
    gone = near_duplicates(docs, id_col, text_col, percent).filter(~F.col("kept")).select("doc_id").distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("own_id"), F.struct("*").alias("row"))
    return rows.join(gone, F.col("own_id") == F.col("doc_id"), "left_anti").select("row.*")
