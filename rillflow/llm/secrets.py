"""Secret scanning with an incremental blob ledger, in DataFrame operations only.

Every version of every path is content-addressed: its text's SHA-256 names a
blob.  A ledger of (blob, rule version) pairs tells what was scanned before, so
only unseen pairs are scanned, once per blob however many paths and versions
share it.  Findings are kept by blob and joined back to all paths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.plans.lineage import materialize

#: (kind, pattern, group whose length counts, least length): the base kinds first, in the order in which they are listed.
#: A run that is too short holds no other match, so ``access`` and ``hex`` look for long runs only; a short ``assign`` match does hide what it covers.
BASE_RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Kinds that the method adds.
MORE_RULES = (
    ("bearer", r"\bBearer\x20+[A-Za-z0-9._~+/-]+=*", 0, 27),
    ("ghtoken", r"\bgh[pousr]_[A-Za-z0-9]+", 0, 36),
    ("jwt", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 20),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)
RULE_VERSION = "secrets-1"
#: Parts of a blob's paths; a blob has at most as many as it has paths.
SALTS = 4_096
#: Matches of a text that are placed together; a text of many has many such parts.
PART = 128
_SPAN = "array<struct<start:long,kind_no:int,end:long>>"
#: What must occur in a text before a costly pattern is tried at all; each is implied by a match of its kind.
_HINT = {
    "assign": r"(?i:passw|secret|token|api_?key)",
    "hex": r"[0-9a-f]{32}",
    "bearer": r"Bearer",
}


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _parts(steps: Column) -> Column:
    """An array in parts of ``PART`` elements."""
    last = F.floor((F.size(steps) - 1) / PART).cast("int")
    return F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(steps, k * PART + 1, F.lit(PART)))).otherwise(F.slice(F.array(steps), 1, 0))


def spans(text: Column, kind_no: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches of a pattern as (start, kind, end) in code points; matches with too short a group are dropped.

    The pieces between the matches and the matches themselves alternate, so their
    lengths give every place.  They are added up in parts of ``PART`` matches, first
    each part's length, then where it begins, then the places inside it, so
    the work grows with the number of matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), measured.alias("part"))
    steps = F.transform(F.filter(zipped, lambda x: x["hit"].isNotNull()), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["part"]).alias("part")))
    zero, none = F.lit(0).cast("long"), F.array().cast(_SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["hit"]
        keep = x["part"] >= least
        one = F.array(F.struct(start.alias("start"), F.lit(kind_no).alias("kind_no"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def begins(parts: Column) -> Column:
        length = lambda part: F.aggregate(part, zero, lambda n, x: n + x["gap"] + x["hit"])
        return F.aggregate(parts, F.struct(zero.alias("at"), F.array().cast("array<long>").alias("out")), lambda acc, part: F.struct((acc["at"] + length(part)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    place = lambda part, at: F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    every = _bound(_bound(steps, _parts), lambda parts: F.flatten(F.zip_with(parts, begins(parts), place)))
    hint = _HINT.get(kind)
    return F.when(text.rlike(hint or pattern), every).otherwise(none)


def scan(blobs: DataFrame, rules: tuple = BASE_RULES + MORE_RULES) -> DataFrame:
    """(blob_id, found): all spans of a blob's text, by start and then kind."""
    each = [spans(F.col("text"), k, *rule) for k, rule in enumerate(rules)]
    return blobs.select("blob_id", F.sort_array(F.concat(*each)).alias("found"))


def versions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(path, blob_id, text): one row per historical version of a path; null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("path"), F.sha2(text, 256).alias("blob_id"), text.alias("text"))


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple = BASE_RULES + MORE_RULES, rule_version: str = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """New ledger rows (blob_id, rule_version, found) for the pairs of blob and rule version that ``ledger`` lacks."""
    seen = versions(docs, id_col, text_col)
    first = seen.groupBy("blob_id").agg(F.min("path").alias("path"))
    if ledger is not None:
        first = first.join(ledger.filter(F.col("rule_version") == rule_version).select("blob_id"), "blob_id", "left_anti")
    unseen = (
        seen.join(first.select(F.col("path").alias("__path"), F.col("blob_id").alias("__blob")), F.col("path").eqNullSafe(F.col("__path")) & (F.col("blob_id") == F.col("__blob")), "left_semi").select("blob_id", "text")
    )
    # a row repeated with its id and text is scanned again; of a blob's equal findings one stays
    return scan(unseen, rules).dropDuplicates(["blob_id"]).select("blob_id", F.lit(rule_version).alias("rule_version"), "found")


def secret_spans(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple = BASE_RULES + MORE_RULES, rule_version: str = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, blob_id, found) for every version, from the ledger with its new rows.

    A blob shared by many paths is spread: its findings are repeated once per
    salt that any of its paths has, and joined on blob and salt.
    """
    new = materialize(update_ledger(docs, ledger, rules, rule_version, id_col, text_col), "ledger")
    all_found = new if ledger is None else new.unionByName(ledger.filter(F.col("rule_version") == rule_version))
    paths = versions(docs, id_col, text_col).select("path", "blob_id", F.pmod(F.xxhash64(F.coalesce(F.col("path"), F.lit(-1))), F.lit(SALTS)).cast("int").alias("salt"))
    placed = paths.select("blob_id", "salt").distinct().join(all_found.select("blob_id", "found"), "blob_id")
    return paths.join(placed, ["blob_id", "salt"]).select("path", "blob_id", "found")


def _listing(found: Column, rules: tuple) -> Column:
    names = F.array(*[F.lit(r[0]) for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind_no"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null text counts as empty and has no spans.  Rows repeated with the same id
    and text each have their row.  Null ids are a path like any other.  An empty
    table gives an empty result; further columns are ignored.
    """
    rules = BASE_RULES + MORE_RULES
    base = F.filter("found", lambda x: x["kind_no"] < len(BASE_RULES))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind_no"] == k)).cast("long")
    return secret_spans(docs, ledger, rules, id_col=id_col, text_col=text_col).select(
        F.col("path").alias("doc_id"),
        *[count(k).alias(f"n_{rule[0]}") for k, rule in enumerate(BASE_RULES)],
        F.sha2(_listing(base, rules), 256).alias("base_sha256"),
        _listing(F.col("found"), rules).alias("spans"),
    )
