"""Exact substring deduplication: bytes covered by long strings that start more than once.

The suffixes to be sorted are all starts of ``limit``-byte strings.  Sorting
them byte by byte over a corpus moves every suffix several times; two exact
reductions leave the suffix arrays only those starts that need them.

1. A sparse cover of the starts.  Every start belongs to the anchor of its
   string: the place of the smallest hash of a ``GRAM``-byte gram inside it (the
   last one of equals).  The anchor depends on the string alone, so equal strings
   have equal grams there, at equal distances.  Starts with the same anchor are
   neighbours and form a block.  Grams that occur once, over all documents,
   settle their blocks: nothing repeats.  Blocks whose whole text occurs twice
   are settled, too: every start repeats.
2. The remaining blocks are split into cells of ``CELL`` neighbouring distances
   from the anchor.  All strings of a cell share a core; a core that only one
   distinct cell has settles it.

The cells left are dealt out by their core, so strings that can be equal meet,
and every task sorts its cells' suffixes with the difference-cover algorithm
(sampled triples, recursion on names, merge of the remaining suffixes) and
compares adjacent prefixes.  A core that very many cells share is split into
finer cells first, down to single starts, which counting settles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.counted_join import join_salted
from rillflow.llm.shingles import byte_sums, mix64, window_min
from rillflow.llm.suffix_array import repeated_prefixes
from rillflow.plans.lineage import discard, materialize

LIMIT = 200
GRAM = 64
CELL = 32
FINER = (8, 1)
HOT_CORE = 1_000
CHUNK_BYTES = 600_000
_PIECE = 1 << 18
_PLACE = np.uint64(0xFFFFFF)


def find_blocks(data: bytes, limit: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, block hash, packed place) of every block of a text, in order.

    A packed place holds the first start, the number of starts less one, and the
    anchor's distance from the first start.
    """
    grams, blocks, packs = [], [], []
    n_starts = len(data) - limit + 1
    for at in range(0, max(0, n_starts), _PIECE):
        part = data[at : at + _PIECE + limit - 1]
        n = min(_PIECE, n_starts - at)
        sums, inverse = byte_sums(part)
        names = mix64((sums[gram:] - sums[:-gram]) * inverse[: len(part) - gram + 1])
        keyed = (names & ~_PLACE) | (_PLACE - np.arange(len(names), dtype=np.uint64))
        anchor = (_PLACE - (window_min(keyed, limit - gram + 1)[:n] & _PLACE)).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        count = np.diff(np.append(first, n))
        ahead = anchor[first] - first
        text = mix64((sums[first + count - 1 + limit] - sums[first]) * inverse[first] + ahead.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        grams.append(names[anchor[first]])
        blocks.append(text)
        packs.append(((first + at) << 16) | ((count - 1) << 8) | ahead)
    if not grams:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(grams), np.concatenate(blocks), np.concatenate(packs)


def _unpack(pack: int) -> tuple[int, int, int]:
    """(first start, number of starts, anchor) of a packed place."""
    start = pack >> 16
    return start, ((pack >> 8) & 0xFF) + 1, start + (pack & 0xFF)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, text); the key tells apart rows that repeat an id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text"))


def _all_blocks(rows: DataFrame, limit: int, gram: int) -> DataFrame:
    """(doc_id, text_key, gram, block, pack) for every block of every text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_key", "gram", "block", "pack"]
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for k, text in enumerate(batch.column(2)):
                grams, blocks, packs = find_blocks(text.as_py(), limit, gram)
                held.append((k, grams, blocks, packs))
                size += len(packs)
                if size >= 200_000:
                    yield emit(batch, held, names)
                    held, size = [], 0
            if size:
                yield emit(batch, held, names)

    def emit(batch: pa.RecordBatch, held: list[tuple], names: list[str]) -> pa.RecordBatch:
        at = pa.array(np.repeat([k for k, *_ in held], [len(x[3]) for x in held]))
        columns = [np.concatenate([x[c] for x in held]) for c in (1, 2, 3)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(columns[0].view(np.int64)), pa.array(columns[1].view(np.int64)), pa.array(columns[2])], names=names)

    return rows.mapInArrow(scan, "doc_id long, text_key long, gram long, block long, pack long")


def cells_of(text: bytes, offset: int, pack: int, width: int, limit: int, within: tuple[int, int] | None = None) -> list[tuple[int, int, bytes, bytes]]:
    """(first start, number of starts, core, whole text) of a block's cells of ``width`` distances; ``text`` begins at ``offset``.

    ``within`` restricts the cells to those starts (first, number).
    """
    start, count, anchor = _unpack(pack)
    lo_start, n = within or (start, count)
    least, most = anchor - (lo_start + n - 1), anchor - lo_start  # distances of the last and the first start
    out = []
    for x in range(least - least % width, most + 1, width):
        near, far = max(x, least), min(x + width - 1, most)
        core = text[anchor - x - offset : anchor - (x + width - 1) + limit - offset]
        whole = text[anchor - far - offset : anchor - near + limit - offset]
        out.append((anchor - far, far - near + 1, core, whole))
    return out


def _name(size: int, *parts: bytes | int) -> bytes:
    joined = b"|".join(p if isinstance(p, bytes) else str(p).encode() for p in parts)
    return hashlib.blake2b(joined, digest_size=size).digest()


def _cell_rows(block: dict, offset: int, text: bytes, width: int, limit: int, within: tuple[int, int] | None) -> list[tuple]:
    """(start, number of starts, core name, name of the whole cell) of a block's cells.

    Equal names of whole cells settle them, so these have 128 bits; cores only
    bring cells together that are compared byte by byte, so 64 bits will do.
    """
    anchor = _unpack(block["pack"])[2]
    return [(lo, n, int.from_bytes(_name(8, block["gram"], (anchor - lo) // width, core), "little", signed=True), _name(16, block["gram"], anchor - lo, n, whole)) for lo, n, core, whole in cells_of(text, offset, block["pack"], width, limit, within)]


_CELL_SCHEMA = "doc_id long, text_key long, gram long, pack long, settled boolean, cells array<struct<start:long,n:int,core:long,whole:binary>>"


def _with_cells(blocks: DataFrame, width: int, limit: int) -> DataFrame:
    """Adds the cells of ``width`` to blocks (doc_id, text_key, gram, pack, settled, text[, within])."""
    nested = "within" in blocks.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for row in batch.to_pylist():
                start = row["pack"] >> 16
                parts = [(w["start"], w["n"]) for w in row["within"]] if nested else [None]
                cells.append([dict(zip(("start", "n", "core", "whole"), c, strict=True)) for part in parts for c in _cell_rows(row, start, row["text"], width, limit, part)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int32()), ("core", pa.int64()), ("whole", pa.binary())]))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text_key", "gram", "pack", "settled")], pa.array(cells, kind)], names=["doc_id", "text_key", "gram", "pack", "settled", "cells"])

    return blocks.mapInArrow(cut, _CELL_SCHEMA)


def settle_cells(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repeated, open) of cells (doc_id, text_key, pack, settled, start, n, core, whole).

    A cell whose whole text another cell has is repeated.  Of equal cells one
    stays as a partner for others.  Cells stay open while their core has two
    distinct cells or more, one of which is not settled.
    """
    by_whole = materialize(
        cells.groupBy("whole").agg(F.count("*").alias("times"), F.any_value("doc_id").alias("doc_id"), F.any_value("text_key").alias("text_key"), F.any_value("pack").alias("pack"), F.any_value("start").alias("start"), F.any_value("n").alias("n"), F.any_value("core").alias("core"), F.max("settled").alias("settled")),
        "wholes",
    )
    repeated = cells.filter("not settled").join(by_whole.filter("times > 1").select("whole"), "whole", "left_semi").select("doc_id", "text_key", "start", "n")
    distinct = by_whole.withColumn("settled", F.col("settled") | (F.col("times") > 1)).drop("times", "whole")
    cores = materialize(distinct.groupBy("core").agg(F.count("*").alias("sharing"), F.min("settled").alias("all_settled")).filter("sharing > 1 and not all_settled").select("core", "sharing"), "cores")
    return repeated, materialize(distinct.join(cores, "core"), "open")


def _suffix_sort(limit: int, chunk_bytes: int):
    """Task function: repeated starts among the cells of each core, by suffix arrays over whole cores."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if held and size >= chunk_bytes and row["core"] != held[-1]["core"]:
                    yield resolve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["slice"])
        if held:
            yield resolve(held)

    def resolve(held: list[dict]) -> pa.RecordBatch:
        counts = [r["n"] for r in held]
        string_of = np.repeat(np.arange(len(held)), counts)
        starts = np.arange(len(string_of)) - np.repeat(np.cumsum(counts) - counts, counts)
        again = repeated_prefixes([r["slice"] for r in held], starts, string_of, limit)
        out = []
        edges = np.flatnonzero(np.diff(np.concatenate([[-1], np.where(again, string_of, -1), [-1]])))
        bounds = np.concatenate([[-1], np.where(again, string_of, -1), [-1]])
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            k = bounds[lo + 1]
            if k >= 0 and not held[k]["settled"]:
                out.append((held[k]["doc_id"], held[k]["text_key"], held[k]["start"] + int(starts[lo]), hi - lo))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int32())], names=["doc_id", "text_key", "start", "n"])

    return sort


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def repeated_starts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, gram: int = GRAM, hot_core: int = HOT_CORE) -> DataFrame:
    """(doc_id, text_key, start, n): runs of starts whose ``limit``-byte string starts anywhere else, too."""
    rows = _rows(docs, id_col, text_col)
    # grams that occur twice, and the blocks that have them
    shared = materialize(_all_blocks(rows, limit, gram).groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "grams")
    candidates = materialize(join_salted(_all_blocks(rows, limit, gram), shared, ["gram"]).drop("n"), "candidates")
    discard(shared)
    by_block = materialize(
        candidates.groupBy("gram", "block").agg(F.count("*").alias("times"), F.any_value("doc_id").alias("doc_id"), F.any_value("text_key").alias("text_key"), F.any_value("pack").alias("pack")), "blocks"
    )
    twice = join_salted(candidates, by_block.filter("times > 1").select("gram", "block", "times"), ["gram", "block"], "times")
    whole_blocks = materialize(twice.groupBy("doc_id", "text_key").agg(F.collect_list("pack").alias("packs")), "whole-blocks")
    discard(candidates)
    # distinct blocks of grams that several distinct blocks share, one of them not settled
    mixed = materialize(by_block.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("times").alias("least")).filter("kinds > 1 and least = 1").select("gram", "kinds"), "mixed")
    wanted = join_salted(by_block, mixed, ["gram"], "kinds").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("gram", "pack", (F.col("times") > 1).alias("settled"))).alias("wanted"))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("gram", pa.int64()), ("pack", pa.int64()), ("settled", pa.bool_()), ("text", pa.binary())])
        for batch in batches:
            out = []
            for doc_id, key, text, blocks in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                for block in blocks:
                    start, count, _ = _unpack(block["pack"])
                    out.append((doc_id, key, block["gram"], block["pack"], block["settled"], text[start : start + count - 1 + limit]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    wanted = wanted.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "wanted").hint("merge")
    blocks = materialize(
        rows.join(wanted, _same("doc_id", "__id") & (F.col("text_key") == F.col("__key"))).select("doc_id", "text_key", "text", "wanted").mapInArrow(slices, "doc_id long, text_key long, gram long, pack long, settled boolean, text binary"),
        "block-texts",
    )
    key = ["doc_id", "text_key", "pack"]
    cells = materialize(_with_cells(blocks, CELL, limit).select("doc_id", "text_key", "pack", "settled", F.explode("cells").alias("c")).select("doc_id", "text_key", "pack", "settled", "c.*"), "cells")
    found, open_cells = settle_cells(cells)
    results = [found]
    for width in FINER:
        hot = open_cells.filter(F.col("sharing") > hot_core)
        if hot.isEmpty():
            break
        nested = hot.groupBy("doc_id", "text_key", F.col("pack").alias("__pack")).agg(F.collect_list(F.struct("start", "n")).alias("within"), F.min("settled").alias("__settled")).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "__pack", "within", "__settled")
        inner = blocks.join(nested, _same("doc_id", "__id") & (F.col("text_key") == F.col("__key")) & (F.col("pack") == F.col("__pack"))).drop("settled").withColumnRenamed("__settled", "settled")
        finer = materialize(_with_cells(inner.select(*key, "gram", "settled", "text", "within"), width, limit).select(*key, "settled", F.explode("cells").alias("c")).select(*key, "settled", "c.*"), "finer")
        found, still = settle_cells(finer)
        results.append(found)
        open_cells = open_cells.filter(F.col("sharing") <= hot_core).unionByName(still)
    # suffix arrays over what is left, core by core
    lists = open_cells.groupBy(*[F.col(c).alias(f"__{c}") for c in key]).agg(F.collect_list(F.struct("core", "start", "n", "settled")).alias("cells"))
    left = (
        blocks.drop("settled")
        .join(lists.hint("merge"), _same("doc_id", "__doc_id") & (F.col("text_key") == F.col("__text_key")) & (F.col("pack") == F.col("__pack")))
        .select("doc_id", "text_key", "pack", "text", F.explode("cells").alias("c"))
        .select("doc_id", "text_key", "c.core", "c.start", "c.n", "c.settled", F.expr(f"substring(text, int(c.start - (pack >> 16)) + 1, c.n + {limit - 1})").alias("slice"))
        .repartition("core")
        .sortWithinPartitions("core")
    )
    results.append(left.mapInArrow(_suffix_sort(limit, CHUNK_BYTES), "doc_id long, text_key long, start long, n int"))
    runs = results[0]
    for more in results[1:]:
        runs = runs.unionByName(more)
    grouped = runs.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    pack_runs = F.transform("packs", lambda p: F.struct(F.shiftright(p, 16).alias("start"), (F.shiftright(p, 8).bitwiseAND(F.lit(255)) + 1).cast("int").alias("n")))
    return grouped.unionByName(whole_blocks.select("doc_id", "text_key", pack_runs.alias("runs")))


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Return per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    Removed is every byte covered by a string of ``limit`` bytes that also starts
    anywhere else, judged on the input; ``kept`` holds the remaining bytes.  A
    null text is an empty one.  Repeated rows are occurrences of their own: from
    ``limit`` bytes on, all of them lose everything.  A null id is an id like any
    other.  An empty table gives an empty result; further columns are ignored.
    """
    runs = repeated_starts(docs, id_col, text_col, limit)
    hits = runs.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.flatten(F.collect_list("runs")).alias("runs"))
    rows = _rows(docs, id_col, text_col)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
        for batch in batches:
            out = []
            for k, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                text = text.as_py()
                found = batch.column(2)[k].values
                spans: list[list[int]] = []
                if found is not None and len(found):
                    start, n = (found.field(f).to_numpy().astype(np.int64) for f in ("start", "n"))
                    order = np.argsort(start, kind="stable")
                    for lo, hi in zip(start[order].tolist(), (start + n - 1 + limit)[order].tolist(), strict=True):
                        if spans and lo <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], hi)
                        else:
                            spans.append([lo, hi])
                kept, at = [], 0
                for lo, hi in spans:
                    kept.append(text[at:lo])
                    at = hi
                kept.append(text[at:])
                rest = b"".join(kept)
                out.append((doc_id, len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    joined = rows.join(hits.hint("merge"), _same("doc_id", "__id") & (F.col("text_key") == F.col("__key")), "left")
    return joined.select("doc_id", "text", "runs").mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
