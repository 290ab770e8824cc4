"""Licence scan: a trained paragraph classifier with template confirmation.

A paragraph ends at a line without a letter or digit, such as a blank one or a
bare comment mark; line breaks and comment marks inside it count as spaces.  Its
features are hashed words (runs of letters and digits) and word pairs;
multinomial logistic regression with sparse inputs scores ordinary text, each family
and, as a class of its own, notices of other licences (``unknown``).  Two temperatures
calibrate it, one for whether a unit is a notice and one for whose it is; they are fitted on
whole templates, and on ordinary lines, that the model did not see.

Three kinds of units are classified: every line; every passage, which is two or
more successive lines of a paragraph with at least ``LEAST_KNOWN`` of their words
in word pairs of the templates; and every paragraph of several lines without a
passage.  The classifier names the family of a unit that is likely a notice, and a
template of that family must confirm it: every other family's templates share fewer
word pairs with the unit, it covers enough of one of them, and it has the words by which that
template differs from other families' and the family's version.  A notice that is not
confirmed is ``unknown``, and is left out for a line inside a passage or paragraph
that is a notice itself; one that a line of it names already is listed by that line.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.license_templates import FOREIGN, NOT_A_GRANT, TEMPLATES
from rillflow.llm.shingles import blocks, locate_words, mix64

BITS = 16
LEAST_PROBABILITY = 0.5
LEAST_COVER = 0.5
LEAST_KNOWN = 0.5
#: A template of up to so many words must agree in all of its own words, a longer one in this share of them.
SHORT_WORDS, LEAST_OWN = 12, 0.5
#: One template in so many is held out to calibrate.
HELD_OUT = 4
#: Bound of the sample of ordinary paragraphs: whole documents, by smallest hash of the id.
BACKGROUND_DOCS = 200
BACKGROUND_ROWS = 4_000
VARIANTS = 60
EPOCHS = 12
UNKNOWN = "unknown"
TEMPERATURES = np.geomspace(0.05, 5, 40)
_ALNUM = np.full(256, 0x20, dtype=np.uint8)
for _c in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _ALNUM[_c] = _c
_ALNUM[65:91] = np.arange(97, 123)
_ALNUM[10] = 10


def lines_of(block: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, first word of every line with words, its line number in its document, where each document's lines begin)."""
    joined, starts, _, names, begins = locate_words(block, _ALNUM)
    if not len(starts):
        return names, np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(block) + 1, np.int64)
    lines = np.concatenate([[0], np.cumsum(joined == 10)])
    line = lines[starts]
    opening = np.ones(len(starts), bool)
    opening[1:] = line[1:] != line[:-1]
    opening[begins[:-1][begins[:-1] < len(starts)]] = True
    first = np.flatnonzero(opening)
    of_doc = np.searchsorted(first, begins)
    doc_starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in block])[:-1]]).astype(np.int64)
    return names, first, line[first] - np.repeat(lines[doc_starts], np.diff(of_doc)), of_doc


def features(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of words and of word pairs; a pair that would leave its paragraph has the last number."""
    shift = np.uint64(64 - BITS)
    single = (mix64(names) >> shift).astype(np.int64)
    pair = np.full(len(names), 1 << BITS, dtype=np.int64)
    if len(names) > 1:
        pair[:-1] = (mix64(names[:-1] * np.uint64(3) + names[1:]) >> shift).astype(np.int64)
    pair[np.append(first[1:], len(names)) - 1] = 1 << BITS
    return single, pair


class ParagraphClassifier:
    """Sparse multinomial logistic regression; class 0 is everything that is no licence notice, the last one notices of other licences."""

    def __init__(self, families: list[str]) -> None:
        self.families = families
        self.weights = np.zeros(((1 << BITS) + 1, len(families) + 1), dtype=np.float32)
        self.bias = np.zeros(len(families) + 1, dtype=np.float32)
        self.notice_temperature = self.family_temperature = 1.0

    def totals(self, names: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Sums of the weights of every line of a block."""
        single, pair = features(names, first)
        return np.add.reduceat(self.weights[single] + self.weights[pair], first, axis=0) if len(first) else np.zeros((0, len(self.bias)), np.float32)

    def scores_of(self, totals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Scores from sums of weights and numbers of words."""
        return totals / np.sqrt(2.0 * lengths)[:, None] + self.bias

    def scores(self, names: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Mean-weight scores of every line of a block."""
        return self.scores_of(self.totals(names, first), np.diff(np.append(first, len(names))))

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """Calibrated: the odds of a notice at one temperature, shared out among the classes at the other."""
        top = scores[:, 1:].max(axis=1)
        odds = top + np.log(np.exp(scores[:, 1:] - top[:, None]).sum(axis=1)) - scores[:, 0]
        notice = 1 / (1 + np.exp(-np.clip(odds / self.notice_temperature, -60, 60)))
        shares = np.exp((scores[:, 1:] - top[:, None]) / self.family_temperature)
        return np.concatenate([1 - notice[:, None], notice[:, None] * shares / shares.sum(axis=1, keepdims=True)], axis=1)

    def train(self, rows: list[bytes], labels: np.ndarray, rate: float = 0.5, decay: float = 1e-4, seed: int = 3) -> None:
        """Stochastic gradient steps."""
        rng = np.random.default_rng(seed)
        names, first, _, _ = lines_of(rows)
        single, pair = features(names, first)
        limits = np.append(first, len(names))
        for epoch in range(EPOCHS):
            for k in rng.permutation(len(rows)):
                lo, hi = limits[k], limits[k + 1]
                used = np.concatenate([single[lo:hi], pair[lo : hi - 1]])
                scale = 1.0 / np.sqrt(2.0 * (hi - lo))
                z = self.weights[used].sum(axis=0) * scale + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[k]] -= 1
                step = rate / (1 + epoch)
                np.add.at(self.weights, used, (-step * scale * p).astype(np.float32))
                self.bias -= (0.1 * step * p).astype(np.float32)
            self.weights *= 1 - decay

    def calibrate(self, rows: list[bytes], labels: np.ndarray) -> tuple[float, float]:
        """The two temperatures of least loss on rows that the model has not seen."""
        names, first, _, _ = lines_of(rows)
        scores, best = self.scores(names, first), []
        for name, loss in (("notice_temperature", lambda p: np.where(labels > 0, 1 - p[:, 0], p[:, 0])), ("family_temperature", lambda p: (p / (1 - p[:, :1] + 1e-12))[labels > 0, labels[labels > 0]])):
            losses = []
            for t in TEMPERATURES:
                setattr(self, name, float(t))
                losses.append(-np.log(loss(self.probabilities(scores)) + 1e-12).mean())
            best.append(float(TEMPERATURES[int(np.argmin(losses))]))
            setattr(self, name, best[-1])
        return best[0], best[1]


def _variants(notice: str, rng: np.random.Generator) -> list[str]:
    """The notice, with other words around it, with words lost, and in part."""
    words, out = notice.split(), [notice]
    for _ in range(VARIANTS):
        kept = [w for w in words if rng.random() > 0.05] or words
        if len(kept) > 14 and rng.random() < 0.5:
            at = int(rng.integers(0, len(kept) - 10))
            kept = kept[at : at + int(rng.integers(10, len(kept) - at + 1))]
        out.append(" ".join(kept))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ParagraphClassifier:
    """Train on varied templates and on ordinary paragraphs of at most ``BACKGROUND_DOCS`` whole documents.

    The temperatures come from a first model that did not see every ``HELD_OUT``-th
    template nor as many of the ordinary lines; the model that is returned has seen all.
    """
    rng = np.random.default_rng(1)
    families = [*sorted(TEMPLATES), UNKNOWN]
    rows, labels, held = [], [], []
    known: set[int] = set()
    for k, family in enumerate(families):
        for at, notice in enumerate(FOREIGN if family == UNKNOWN else TEMPLATES[family]):
            for text in _variants(notice, rng):
                rows.append(text.encode())
                labels.append(k + 1)
                held.append(at % HELD_OUT == HELD_OUT - 1)
            names, first, _, _ = lines_of([notice.encode()])
            known |= set(features(names, first)[1][:-1].tolist())
    for at, notice in enumerate(NOT_A_GRANT):
        for text in _variants(notice, rng):
            rows.append(text.encode())
            labels.append(0)
            held.append(at % HELD_OUT == HELD_OUT - 1)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null and doc_id is not null")
    ids = sorted(r["doc_id"] for r in named.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(BACKGROUND_DOCS).collect())
    sample = named.filter(F.col("doc_id").isin(ids)).dropDuplicates(["doc_id"]).select("text").collect()
    lines = [line.encode() for text in sorted(r["text"] for r in sample) for line in text.split("\n") if any(c.isalnum() for c in line)]
    for at, line in enumerate(lines[k] for k in rng.permutation(len(lines))[:BACKGROUND_ROWS]):
        names, first, _, _ = lines_of([line])
        pairs = features(names, first)[1][:-1].tolist() if len(names) else []
        if pairs and sum(x in known for x in pairs) < 0.2 * len(pairs):  # a notice in the sample is no ordinary paragraph
            rows.append(line)
            labels.append(0)
            held.append(at % HELD_OUT == HELD_OUT - 1)
    solid = [k for k, row in enumerate(rows) if len(lines_of([row])[0])]
    part = lambda chosen: ([rows[k] for k in chosen], np.array([labels[k] for k in chosen]))
    first_model, model = ParagraphClassifier(families), ParagraphClassifier(families)
    first_model.train(*part([k for k in solid if not held[k]]))
    model.train(*part(solid))
    model.notice_temperature, model.family_temperature = first_model.calibrate(*part([k for k in solid if held[k]]))
    return model


def word_hashes(text: str) -> dict[str, int]:
    """The words of a text, lower-cased runs of letters and digits, with their hashes."""
    words = re.findall("[a-z0-9]+", text.lower())
    return {word: int(lines_of([word.encode()])[0][0]) for word in set(words)}


@dataclass(frozen=True)
class Template:
    """What confirms a notice: a template's word pairs, the words that no other family's templates have, how many of them must be there, and the family's version."""

    pairs: frozenset[int]
    own: frozenset[int]
    least_own: int
    version: int | None


def pair_set(names: np.ndarray) -> set[int]:
    return set((names[:-1] * np.uint64(3) + names[1:]).tolist())


def known_templates() -> list[list[Template]]:
    """The templates of every family, in the order of the classes."""
    words = {family: [word_hashes(notice) for notice in TEMPLATES[family]] for family in sorted(TEMPLATES)}
    used = Counter(word for sets in words.values() for word in {w for one in sets for w in one})
    out = []
    for family, sets in words.items():
        number = re.search(r"-(\d+)\.", family)
        version = word_hashes(number[1])[number[1]] if number else None
        templates = []
        for notice, hashes in zip(TEMPLATES[family], sets, strict=True):
            own = {h for word, h in hashes.items() if used[word] == 1 and not word.isdigit()}
            short = len(re.findall("[a-z0-9]+", notice.lower())) <= SHORT_WORDS
            templates.append(Template(frozenset(pair_set(lines_of([notice.encode()])[0])), frozenset(own), len(own) if short else math.ceil(LEAST_OWN * len(own)), version))
        out.append(templates)
    return out


def confirm(names: np.ndarray, templates: list[list[Template]], family: int) -> bool:
    """Whether the templates bear out that a unit is a notice of a family: those of any other share fewer word pairs, and one of its own is covered and agrees in its own words and the version."""
    pairs, words = pair_set(names), set(names.tolist())
    shared = [max(len(pairs & t.pairs) for t in others) for others in templates]
    if any(n >= shared[family] for k, n in enumerate(shared) if k != family):
        return False
    for t in templates[family]:
        cover = len(pairs & t.pairs) / max(3, min(len(pairs), len(t.pairs)))
        of_long = t.least_own if len(pairs) >= len(t.pairs) else min(t.least_own, math.ceil(LEAST_OWN * len(pairs) / max(1, len(t.pairs)) * len(t.own)))
        if cover >= LEAST_COVER and len(words & t.own) >= of_long and (t.version is None or t.version in words):
            return True
    return False


def known_pairs(families: list[str]) -> np.ndarray:
    """Whether a feature number is a word pair of some template."""
    known = np.zeros((1 << BITS) + 1, bool)
    for family in families:
        for notice in TEMPLATES.get(family, ()):
            names, first, _, _ = lines_of([notice.encode()])
            known[features(names, first)[1][:-1]] = True
    known[1 << BITS] = False
    return known


def named(model: ParagraphClassifier, templates: list[list[Template]], names: np.ndarray, p: np.ndarray) -> tuple[str, float]:
    """(family, probability) of a unit that is a notice: the classifier's class if a template confirms it, else ``unknown`` with the probability of a notice."""
    best = int(np.argmax(p[1:]))
    if model.families[best] != UNKNOWN and confirm(names, templates, best):
        return model.families[best], round(float(p[best + 1]), 4)
    return UNKNOWN, round(float(1 - p[0]), 4)


def notices_of(model: ParagraphClassifier, templates: list[list[Template]], known: np.ndarray, block: list[bytes]) -> tuple[list[int], list[list[tuple[int, str, float]]]]:
    """Per document of a block: number of paragraphs, and (line, family, probability) of the notices, in order."""
    names, first, line, of_doc = lines_of(block)
    found: list[list[tuple[int, str, float]]] = [[] for _ in block]
    if not len(first):
        return [0] * len(block), found
    n = len(first)
    limits = np.append(first, len(names))
    opening = np.ones(n, bool)
    opening[1:] = np.diff(line) != 1
    opening[of_doc[:-1][of_doc[:-1] < n]] = True
    paragraph = np.flatnonzero(opening)
    _, pair = features(names, first[paragraph])
    last = limits[1:] - 1
    in_pair = known[pair]
    in_pair[1:] |= known[pair[:-1]]
    like = np.add.reduceat(in_pair.astype(np.int64), first) >= LEAST_KNOWN * np.diff(limits)
    part_opening = opening.copy()
    part_opening[1:] |= like[1:] != like[:-1]
    part = np.flatnonzero(part_opening)

    totals = model.totals(names, first)
    p = model.probabilities(model.scores_of(totals, np.diff(limits)))

    def units(begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the line after each unit, probabilities): word pairs across line breaks inside a unit count."""
        ends = np.append(begins[1:], n)
        across = pair[last]
        across[ends - 1] = 1 << BITS
        sums = np.add.reduceat(totals + model.weights[across], begins, axis=0)
        return ends, model.probabilities(model.scores_of(sums, limits[ends] - limits[begins]))

    part_end, part_p = units(part)
    paragraph_end, paragraph_p = units(paragraph)
    passage = like[part] & (part_end - part > 1)
    holding = np.add.reduceat(np.repeat(passage, part_end - part), paragraph)
    whole = (paragraph_end - paragraph > 1) & (holding == 0)
    inside = np.zeros(n, bool)
    hits: list[tuple[int, int, str, float]] = []
    for begins, ends, probability, wanted in ((part, part_end, part_p, passage), (paragraph, paragraph_end, paragraph_p, whole)):
        for k in np.flatnonzero(wanted & (1 - probability[:, 0] >= LEAST_PROBABILITY)).tolist():
            lo, hi = int(begins[k]), int(ends[k])
            inside[lo:hi] = True
            hits.append((lo, hi, *named(model, templates, names[limits[lo] : limits[hi]], probability[k])))
    lines: list[tuple[int, str, float]] = []
    for k in np.flatnonzero(1 - p[:, 0] >= LEAST_PROBABILITY).tolist():
        name, score = named(model, templates, names[limits[k] : limits[k + 1]], p[k])
        if name != UNKNOWN or not inside[k]:
            lines.append((k, name, score))
    hits = [(lo, name, score) for lo, hi, name, score in hits if not any(lo <= k < hi and other == name for k, other, _ in lines)]
    for k, name, score in sorted(hits + lines):
        found[int(np.searchsorted(of_doc, k, side="right")) - 1].append((int(line[k]), name, score))
    return np.diff(np.searchsorted(paragraph, of_doc)).tolist(), found


def scan(docs: DataFrame, model: ParagraphClassifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_paragraphs, n_notices, families, notices."""
    templates, known = known_templates(), known_pairs(model.families)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, listed, families = [], [], []
            for block in blocks(batch.column(1).to_pylist()):
                n_paragraphs, found = notices_of(model, templates, known, block)
                counts += n_paragraphs
                for hits in found:
                    listed.append([f"{at}:{name}:{score}" for at, name, score in hits])
                    families.append(sorted({name for _, name, _ in hits if name != UNKNOWN}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array([len(x) for x in listed], pa.int64()), pa.array([",".join(x) for x in families], pa.string()), pa.array([",".join(x) for x in listed], pa.string())],
                names=["doc_id", "n_paragraphs", "n_notices", "families", "notices"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(classify, "doc_id long, n_paragraphs long, n_notices long, families string, notices string")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return per document: doc_id, n_paragraphs, n_notices, families, notices.

    ``families`` are the confirmed ones, sorted; ``notices`` lists every notice
    as line:family:probability (its first line, from 0; ``unknown`` where no
    template confirms).  A null text is an empty one and has no paragraphs.  Repeated rows
    each have their row; an empty table gives an empty result; further columns
    are ignored.
    """
    return scan(docs, fit(docs, id_col, text_col), id_col, text_col)
