"""Packing documents into token sequences: dominance reduction, then best fit.

The lengths of all pieces form a histogram with at most ``capacity`` classes.
That histogram *is* the packing instance, so the Martello-Toth reduction and
best-fit-decreasing run on classes with multiplicities: their cost and the size
of the plan depend on ``capacity`` alone, not on the number of documents.  Spark
tokenizes, builds the histogram, ranks the pieces inside their length class with
distributed prefix sums, and looks up each ranked piece's place in the plan.
"""

from __future__ import annotations

import base64
import json
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.plans.lineage import materialize

CAPACITY = 2048
END_ID = 0
#: Pieces that a bucket holds when all have one length.
ROWS_PER_BUCKET = 1_000_000
BUCKETS = 256
#: Beyond this many characters a text goes through the tokenizer itself.
LONG_CHARS = 100_000
#: Bounds of the tokenizer's remembered pieces in a worker.
MEMO_CHARS = 32
MEMO_PIECES = 1 << 18
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def default_tokenizer() -> tuple[str, str]:
    """Paths of the public byte-level vocabulary: as tokenizer file, and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Pretokens(dict):
    """The tokenizer's ids of pieces that its pattern cuts, as bytes of unsigned 32-bit numbers; short pieces are remembered."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class TokenIds:
    """Ids of the tokenizer file.

    The tokenizer itself is used for texts of more than ``LONG_CHARS`` characters,
    cut by its pattern so that memory does not grow with the text, and for texts
    that hold one of its added tokens.  Other texts take the rank form of the same
    vocabulary, a quarter of the tokenizer's time for the same ids (tested).
    """

    def __init__(self, tokenizer_path: str, ranks_path: str) -> None:
        import public_tokenizers
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(tokenizer_path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.pieces = Pretokens(self.full)
        with open(tokenizer_path, encoding="utf-8") as file:
            added = sorted((t["content"] for t in json.load(file)["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added)) or "(?!)")
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _cut(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join([self.pieces[m[0]] for m in self.pattern.finditer(text)]), dtype="<u4")

    def __call__(self, text: str) -> np.ndarray:
        if len(text) <= LONG_CHARS:
            if self.added.search(text):
                return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        # an added token is cut out before the pattern is applied to what stands between
        parts, at = [], 0
        for m in self.added.finditer(text):
            parts += [self._cut(text[at : m.start()]), np.array(self.full.encode(m[0], add_special_tokens=False).ids, dtype="<u4")]
            at = m.end()
        return np.concatenate([*parts, self._cut(text[at:])])


@cache
def token_ids(tokenizer_path: str, ranks_path: str) -> TokenIds:
    """One tokenizer for all tasks of a worker process."""
    return TokenIds(tokenizer_path, ranks_path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than ``capacity`` if there are several."""
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer: tuple[str, str]) -> DataFrame:
    """Every document's pieces: ids of the whole text, the end id, cut to at most ``capacity``."""

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = token_ids(*tokenizer)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(ids_of(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tokenize, PIECES)


def _largest_upto(lengths: list[int], limit: int) -> int:
    """The largest present length of at most ``limit``, or 0."""
    at = bisect_left(lengths, limit + 1)
    return lengths[at - 1] if at else 0


def _best_pair(counts: dict[int, int], lengths: list[int], room: int) -> int:
    """The largest sum of two present items that fits in ``room``, or 0."""
    best, lo, hi = 0, 0, len(lengths) - 1
    while lo <= hi:
        total = lengths[lo] + lengths[hi]
        if total > room:
            hi -= 1
            continue
        if lo < hi or counts[lengths[lo]] > 1:
            best = max(best, total)
        lo += 1
    return best


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[Plan, dict[int, int]]:
    """Martello-Toth reduction on length classes: (fixed sequences, what is left).

    An item with no partner that fits is fixed alone.  An item and its largest
    fitting partner are fixed together if they fill the sequence, if no third
    item could join, or if at most two could join and no pair of them is longer
    than that partner.  Every alternative set is dominated by the one fixed.  Fixing
    items only takes alternatives away, so a whole class is fixed at once.
    """
    counts = {k: v for k, v in counts.items() if v}
    fixed: Plan = []

    def take(length: int, n: int) -> None:
        counts[length] -= n
        if not counts[length]:
            del counts[length]

    changed = True
    while changed:
        changed = False
        for length in sorted(counts, reverse=True):
            while counts.get(length):
                take(length, 1)  # one item of the class looks for its partners among all others
                others = sorted(counts)
                small = [x for x in others[:3] for _ in range(min(3, counts[x]))][:3]
                room = capacity - length
                partner = _largest_upto(others, room)
                n_fit = 0 if not small or small[0] > room else 1 if sum(small[:2]) > room or len(small) < 2 else 2 if sum(small) > room or len(small) < 3 else 3
                same = counts.get(length, 0) + 1
                if n_fit == 0:
                    fixed.append((((length, 1),), same))
                    if same > 1:
                        take(length, same - 1)
                elif partner == room or n_fit == 1 or (n_fit == 2 and partner >= _best_pair(counts, others, room)):
                    if partner == length:
                        n = same // 2
                        fixed.append((((length, 2),), n))
                        take(length, 2 * n - 1)
                    else:
                        n = min(same, counts[partner])
                        fixed.append((((length, 1), (partner, 1)), n))
                        take(partner, n)
                        if n > 1:
                            take(length, n - 1)
                else:
                    counts[length] = counts.get(length, 0) + 1
                    break
                changed = True
    return fixed, counts


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit-decreasing on length classes: equal sequences are kept as one pattern with a number."""
    by_room: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    rooms: list[int] = []

    def put(pattern: tuple[tuple[int, int], ...], n: int, room: int) -> None:
        if n:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append((pattern, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in [r for r in rooms if r >= length]:
            if not left:
                break
            each, groups = room // length, by_room.pop(room)
            rooms.remove(room)
            for pattern, n in groups:
                full = min(n, left // each)
                put((*pattern, (length, each)), full, room - each * length)
                left -= full * each
                if full < n and 0 < left < each:
                    put((*pattern, (length, left)), 1, room - left * length)
                    full, left = full + 1, 0
                put(pattern, n - full, room)
        each = capacity // length
        put(((length, each),), left // each, capacity - each * length)
        if left % each:
            put(((length, left % each),), 1, capacity - left % each * length)
    return [group for groups in by_room.values() for group in groups]


def plan_sequences(counts: dict[int, int], capacity: int) -> Plan:
    """Patterns of (length, how many) with the number of sequences that have each pattern."""
    fixed, rest = reduce_dominated(counts, capacity)
    return fixed + best_fit(rest, capacity)


def slots(plan: Plan) -> np.ndarray:
    """Rows (length, first rank, per sequence, first sequence id, first offset), sorted by length and rank."""
    rows, used, sequence = [], {}, 0
    for pattern, n in plan:
        offset = 0
        for length, each in pattern:
            rows.append((length, used.get(length, 0), each, sequence, offset))
            used[length] = used.get(length, 0) + each * n
            offset += each * length
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    tokenizer: tuple[str, str] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Return per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is an empty one: its piece is the end id alone.  Null ids and
    repeated rows are packed as documents of their own.  An empty table gives an
    empty result; further columns are ignored.
    """
    table = materialize(pieces(docs, id_col, text_col, capacity, tokenizer or default_tokenizer()), "pieces")
    buckets = max(BUCKETS, -(-table.count() // rows_per_bucket))  # grows with the pieces, so that the most frequent length is ranked in bounded parts
    bucketed = table.withColumn("bucket", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sums = bucketed.groupBy("length", "bucket").count()
    ahead = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        bucketed.join(sums.select("length", "bucket", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("ahead")), ["length", "bucket"])
        .withColumn("rank", F.col("ahead") + F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
        .select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    )
    histogram = {row["length"]: row["n"] for row in sums.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    plan = slots(plan_sequences(histogram, capacity))
    keys = (plan[:, 0] << 44) | plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            slot = plan[np.searchsorted(keys, (length << 44) | rank, side="right") - 1] if len(rank) else plan[:0]
            at = rank - slot[:, 1]
            sequence, offset = slot[:, 3] + at // slot[:, 2], slot[:, 4] + at % slot[:, 2] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
