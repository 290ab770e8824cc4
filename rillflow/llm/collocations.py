"""Phrase collocations: n-grams as rows, counted per language and scored against their parts.

A phrase that is frequent enough to be a candidate has only frequent words and
only frequent pairs of neighbouring words.  So two passes over the texts prepare
the n-grams, without losing any of them:

* words are counted as they are; pairs of frequent words are counted by a hash;
* texts are cut into runs of words whose neighbouring pairs are all frequent.

What the passes hand to the next one through the driver are two tables of bits of
a fixed size, in which a frequent word or pair sets the bit of its hash.  A bit
that is set by chance only lets a run be longer than need be: the n-grams are
counted by their words.  All n-grams of the runs are exploded into rows, hash-aggregated
per language, joined with the counts of their first and last parts, scored in
decimals, thinned by an anti-join with their one-word extensions and ranked.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.llm.counted_join import join_counted
from rillflow.plans.lineage import materialize

LEAST_COUNT = 100
MOST_WORDS = 5
BEST = 2_000
#: An extension with so many hundredths of a phrase's occurrences stands for it.
SHARE = 100
#: Each table of bits has 2 to the power of this many.
BITS = 25
#: Bytes of text that are worked on at a time; a longer text is worked on alone.
SLICE_BYTES = 4 << 20
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0a\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n\n")
_SPACE, _CUT = 32, 10


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, texts joined by line breaks, folded), in parts of bounded size."""
    for batch in batches:
        held: dict[str, list[bytes]] = {}
        size = 0
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            data = text.as_py()
            held.setdefault(lang.as_py(), []).append(data)
            size += len(data)
            if size >= SLICE_BYTES:
                yield from ((k, b"\n".join(v).translate(_FOLD)) for k, v in held.items())
                held, size = {}, 0
        yield from ((k, b"\n".join(v).translate(_FOLD)) for k, v in held.items())


def word_places(data: bytes) -> np.ndarray:
    """The number of the piece of each word of a folded text."""
    codes = np.frombuffer(data, np.uint8)
    blank = (codes == _SPACE) | (codes == _CUT)
    begins = ~blank
    begins[1:] &= blank[:-1]
    return np.cumsum(codes == _CUT, dtype=np.int32)[begins]


def set_bits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set."""
    at = hashes.view(np.uint64) & np.uint64((1 << BITS) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)).astype(np.uint64)) & np.uint64(1) > 0


def bit_table(hashes: DataFrame) -> np.ndarray:
    """The table of bits of a column ``hash``; the driver gets its 2 ** (BITS - 6) words at most, whatever the rows."""
    low = F.col("hash").cast("long").bitwiseAND((1 << BITS) - 1)
    words = hashes.groupBy(F.shiftright(low, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(63).cast("int"))).alias("bits")).toArrow()
    table = np.zeros(1 << (BITS - 6), np.uint64)
    table[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return table


def _hash_words(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.array([xxhash.xxh3_64_intdigest(x, seed) for x in words], np.uint64)


def _word_codes(lang: str, data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, number of each word among the distinct ones, hashes of those)."""
    words = data.split()
    coded = pa.array(words, pa.binary()).dictionary_encode()
    return words, coded.indices.to_numpy(), _hash_words(lang, coded.dictionary.to_pylist())


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = (first ^ (first >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + second
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def _word_rows(texts: DataFrame) -> DataFrame:
    """(lang, phrase, n): distinct words of each part of the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in _texts(batches):
            found = Counter(data.split())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "phrase", "n"])

    return texts.mapInArrow(count, "lang string, phrase string, n long")


def _with_hashes(words: DataFrame) -> DataFrame:
    """(hash) of counted words, as the later passes compute it."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            hashes = np.array([int(_hash_words(lang, [word.encode()])[0]) for lang, word in pairs], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["hash"])

    return words.select("lang", "phrase").mapInArrow(name, "hash long")


def _pair_rows(texts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(hash, n): pairs of neighbouring words that may both be frequent, by 32 bits of their hash, which is as much as the table of bits can tell apart."""
    held = texts.sparkSession.sparkContext.broadcast(frequent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in _texts(batches):
            words, codes, hashes = _word_codes(lang, data)
            if len(words) > 1:
                fits, places = set_bits(held.value, hashes)[codes], word_places(data)
                at = np.flatnonzero((places[1:] == places[:-1]) & fits[1:] & fits[:-1])
                pairs, n = np.unique(codes[at].astype(np.int64) * len(hashes) + codes[at + 1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(_pair_hashes(hashes[pairs // len(hashes)], hashes[pairs % len(hashes)]).astype(np.uint32).view(np.int32)), pa.array(n)], names=["hash", "n"])

    return texts.mapInArrow(count, "hash int, n long")


def _run_rows(texts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(lang, run, n): the longest stretches of words, two at least, whose neighbouring pairs may all be frequent."""
    held = texts.sparkSession.sparkContext.broadcast(frequent)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in _texts(batches):
            words, codes, hashes = _word_codes(lang, data)
            if len(words) > 1:
                places, by_word = word_places(data), hashes[codes]
                tied = (places[1:] == places[:-1]) & set_bits(held.value, _pair_hashes(by_word[:-1], by_word[1:]))
                edge = np.diff(np.concatenate([[False], tied, [False]]).astype(np.int8))
                runs = Counter(b" ".join(words[a : b + 1]) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(runs), pa.string()), pa.array(list(runs), pa.binary()).cast(pa.string()), pa.array(list(runs.values()), pa.int64())], names=["lang", "run", "n"])

    return texts.mapInArrow(cut, "lang string, run string, n long")


def phrase_counts(runs: DataFrame, most_words: int) -> DataFrame:
    """(lang, phrase, a, size): all n-grams of 2 to ``most_words`` words of the runs as rows, counted."""
    words = runs.select("lang", "n", F.split("run", " ").alias("words"))
    placed = words.select("lang", "n", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("at"))
    ahead = placed.select("lang", "n", F.slice("words", F.col("at"), F.lit(most_words)).alias("ahead"))
    sizes = F.sequence(F.lit(2), F.size("ahead"))
    grams = ahead.select("lang", "n", "ahead", F.explode(sizes).alias("size")).select("lang", F.array_join(F.slice("ahead", F.lit(1), F.col("size")), " ").alias("phrase"), "size", "n")
    return grams.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("a"))


def _whole(x: Column, digits: int = 20) -> Column:
    return x.cast(f"decimal({digits},0)")


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score): the lowest-scoring cut of every phrase."""
    words = F.split("phrase", " ")
    cuts = phrases.select("*", words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "a", "n", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))
    first, rest = counts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    joined = cuts.join(first.hint("merge"), ["lang", "first"]).join(rest.hint("merge"), ["lang", "rest"])
    product, parts = _whole(F.lit(1000), 4) * _whole(F.col("a"), 17) * _whole(F.col("n"), 17), _whole(F.col("l"), 19) * _whole(F.col("r"), 19)
    lowest = joined.select("lang", "phrase", "size", "a", "n", "k", "l", "r", product.alias("product"), parts.alias("parts")).withColumn("score", F.expr("product div parts"))
    low = lowest.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    return low.select("lang", "phrase", "size", "a", "low.l", "low.r", "n", "low.score")


def without_contained(phrases: DataFrame, share: int) -> DataFrame:
    """The phrases that no one-word extension stands for.

    A longer phrase that does so contains an extension that does so, too: it
    occurs at least as often.
    """
    words = F.split("phrase", " ")
    parts = F.array(F.slice(words, F.lit(1), F.col("size") - 1), F.slice(words, F.lit(2), F.col("size") - 1))
    longer = phrases.filter("size > 2").select("lang", F.explode(F.transform(parts, lambda x: F.array_join(x, " "))).alias("phrase"), F.col("a").alias("longer"))
    most = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    covered = phrases.join(most, ["lang", "phrase"]).filter(100 * F.col("longer") >= share * F.col("a")).select("lang", "phrase")
    return phrases.join(covered, ["lang", "phrase"], "left_anti")


def best_by_language(phrases: DataFrame, best: int) -> DataFrame:
    """The first ``best`` of each language with their rank: within parts of a language first, then among those parts' best."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = max(1, int((phrases.count() / best) ** 0.5))
    dealt = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)).cast("int"))
    near = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= best)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST_COUNT, most_words: int = MOST_WORDS, share: int = SHARE, best: int = BEST) -> DataFrame:
    """Return each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    A-Z count as lower-case; a null text counts as empty, a null language as ``und``.
    Rows repeated count each time.  Phrases of equal score and count are in the order of
    their bytes, cuts of equal score go to the shortest first part.  An empty table, or one
    without a phrase that occurs ``least`` times, gives an empty result; further
    columns are ignored whatever their names.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    words = materialize(_word_rows(texts).groupBy("lang", "phrase").agg(F.sum("n").alias("a")), "words")
    pairs = _pair_rows(texts, bit_table(_with_hashes(words.filter(F.col("a") >= least)))).groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    runs = _run_rows(texts, bit_table(pairs)).groupBy("lang", "run").agg(F.sum("n").alias("n"))
    phrases = materialize(phrase_counts(runs, most_words).filter(F.col("a") >= least), "phrases")
    counts = phrases.select("lang", "phrase", "a").unionByName(words.filter(F.col("a") >= least).select("lang", "phrase", "a"))
    totals = words.groupBy("lang").agg(F.sum("a").alias("n")).join(phrases.groupBy("lang").agg(F.count("*").alias("n_rows")).hint("merge"), "lang")
    sized = join_counted(phrases, materialize(totals, "languages"), ["lang"], "n_rows").drop("n_rows")
    kept = materialize(without_contained(scored(sized, counts), share), "collocations")
    return best_by_language(kept, best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
