"""A trie of conversation prefixes by smallest-member ownership, without building a tree.

A node is a sequence of turns that some conversation begins with; its members are
the conversations that do, and its owner is the smallest of them.  A conversation
that owns a node owns every later one on its path, so what it owns is a suffix of
the path and two numbers describe it: where it begins, and what lies before.

* Windows along the conversations number the turns and fold them into 128-bit prefix
  names, in ranges of a conversation, so that a long one needs no single task.
* A node's owner is found by a minimum with partial sums and goes back to the node's
  occurrences; a window over a node would bring a first turn that
  many conversations share to one task.
* One group-by of all occurrences by prefix then gives the subtrees: tokens of the
  occurrences from the node on minus those that their conversations own,
  leaves that the members own, and children, which are the owned next turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.counted_join import join_counted
from rillflow.llm.near_dedup import _by_group
from rillflow.operators.ranges import running
from rillflow.plans.lineage import materialize

#: A conversation takes over fewer than so many turns of another one, whose id is the next multiple of the block below.
MOST_BORROWED = 6
BLOCK = 100
#: Members' ids are joined in spans of so many numbers, so that a group has no more members than that.
ID_SPAN = 4_096
_NODE = ["depth", "px", "py"]


def turn_digests(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, x, y, n_chars): turns with 128 bits of a digest of role and text; rows without an id are no conversation's."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    bits = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    return rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), bits(1).alias("x"), bits(17).alias("y"), F.char_length(text).cast("long").alias("n_chars"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, conversations): the turns (conv_id, depth, x, y, n_chars) after each conversation's first h were replaced, and (conv_id, length)."""
    numbered = materialize(running(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("x").asc(), F.col("y").asc()], {"at": (F.lit(1).cast("long"), F.sum)}).drop("turn"), "numbered-turns")
    h = F.crc32(F.col("conv_id").cast("string")) % MOST_BORROWED
    convs = numbered.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"))
    known = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(known, "base", "left").withColumn("borrowed", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = materialize(convs.select("conv_id", "base", "n", "h", "borrowed", (F.col("borrowed") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")), "conversations")
    heads = numbered.filter(F.col("at") < MOST_BORROWED).withColumnRenamed("conv_id", "base")
    taken = convs.select("conv_id", "base", "h").join(heads, "base").filter(F.col("at") <= F.col("h")).select("conv_id", F.col("at").alias("depth"), "x", "y", "n_chars")
    rest = join_counted(numbered, convs.select("conv_id", "n", "h", "borrowed"), ["conv_id"]).filter(F.col("at") > F.col("h"))
    return taken.unionByName(rest.select("conv_id", (F.col("borrowed") + F.col("at") - F.col("h")).alias("depth"), "x", "y", "n_chars")), convs.select("conv_id", "length")


def occurrences(items: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, length, depth, px, py, n_chars, upto): every node on every path, the root first; upto sums n_chars up to and including it."""
    tags = {"px": (F.xxhash64("depth", "x", "y"), F.bit_xor), "py": (F.xxhash64("y", "x", "depth"), F.bit_xor), "upto": (F.col("n_chars"), F.sum)}
    paths = running(items, ["conv_id"], [F.col("depth").asc()], tags).drop("x", "y")
    n_rows = conversations.withColumn("n", F.col("length"))
    below = join_counted(paths, n_rows, ["conv_id"]).drop("n")
    zero = F.lit(0).cast("long")
    root = conversations.select("conv_id", "length", zero.alias("depth"), zero.alias("px"), zero.alias("py"), zero.alias("n_chars"), zero.alias("upto"))
    return below.select(*root.columns).unionByName(root)


def ends(occurring: DataFrame) -> DataFrame:
    """(depth, px, py, ends_sha256): the digest of the joined ids of the conversations that end at a node, in numerical order.

    Ids are sorted and joined in spans of ``ID_SPAN`` numbers.  Only the digest of a node
    with many spans runs over them in order, in one task but span by span.
    """
    last = occurring.filter(F.col("depth") == F.col("length"))
    spans = last.groupBy(*_NODE, F.floor(F.col("conv_id") / ID_SPAN).alias("span")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    spans = materialize(spans, "end-spans")
    per = spans.groupBy(*_NODE).agg(F.count("*").alias("n_spans"), F.any_value("ids").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, hashlib.sha256()
        row = lambda: pa.RecordBatch.from_arrays([*[pa.array([v], pa.int64()) for v in at], pa.array([state.hexdigest()])], names=[*_NODE, "ends_sha256"])
        for batch in batches:
            for *node, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if node == at:
                    state.update(b",")
                else:
                    if at is not None:
                        yield row()
                    at, state = node, hashlib.sha256()
                state.update(ids.encode())
        if at is not None:
            yield row()

    several = per.filter("n_spans > 1").select(*_NODE)
    long = spans.join(several.hint("merge"), _NODE, "left_semi").repartition(*_NODE).sortWithinPartitions(*_NODE, "span").select(*_NODE, "ids")
    short = per.filter("n_spans = 1").select(*_NODE, F.sha2("ids", 256).alias("ends_sha256"))
    return short.unionByName(long.mapInArrow(digest, "depth long, px long, py long, ends_sha256 string"))


def prefix_trie(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Return one row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are rebuilt first: the first h turns of a conversation are those
    of the one whose id is the multiple of ``BLOCK`` below, h being the id's CRC modulo
    ``MOST_BORROWED``.  Turns are in the order of ``turn``, null ones first; rows of one turn are in
    the order of the digest of role and text, so repeated rows are turns
    of their own.  A null role or text is empty.  Rows with a null id belong to no
    conversation and are ignored, as are further columns.  Nodes are told apart by 128 bits
    of digests.  An empty table has no root and gives an empty result.
    """
    items, conversations = rebuilt(turn_digests(rows, id_col, turn_col, role_col, text_col))
    occurring = materialize(occurrences(items, conversations), "occurrences")
    nodes = materialize(occurring.groupBy(*_NODE).agg(F.min("conv_id").alias("low"), F.count("*").alias("n"), F.max("length").alias("deepest")), "trie-nodes")
    seen = materialize(join_counted(occurring, nodes, _NODE), "owned-occurrences")
    owned = F.col("conv_id") == F.col("low")
    facts = seen.groupBy("conv_id").agg(
        F.count("*").alias("n"), F.min(F.when(owned, F.col("depth"))).alias("begins"), F.max_by("low", F.when(~owned, F.col("depth"))).alias("low_before"),
        F.sum(F.when(owned, 0).otherwise(F.col("n_chars"))).alias("shared"), F.max(owned & (F.col("depth") == F.col("length")) & (F.col("deepest") == F.col("length"))).alias("leaf"),
    )
    marked = join_counted(seen.drop("n"), materialize(facts, "owned-suffixes"), ["conv_id"])
    shared_from_here: Column = F.when(owned, 0).otherwise(F.col("shared") - F.col("upto") + F.col("n_chars"))
    next_owned = F.coalesce((F.col("depth") + 1 >= F.col("begins")) & (F.col("depth") < F.col("length")), F.lit(False))
    parent = F.when(owned & (F.col("depth") > 0), F.when(F.col("depth") > F.col("begins"), F.col("conv_id")).otherwise(F.col("low_before")))
    summed = marked.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"), F.max(parent).alias("parent_conv_id"), F.count("*").alias("n_convs"), F.count_if(next_owned).alias("n_children"),
        F.count_if("leaf").alias("n_leaves"), F.sum(shared_from_here).cast("long").alias("saved_tokens"),
    )
    none = hashlib.sha256().hexdigest()
    return summed.join(ends(occurring).hint("merge"), _NODE, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
