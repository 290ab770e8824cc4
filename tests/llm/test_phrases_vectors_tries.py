"""Collocations, near vectors and prefix tries against brute force on small tables, with nulls, ties, repeats, long values and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.llm import collocations as phrases
from rillflow.llm import pivot_links
from rillflow.llm.collocations import collocations
from rillflow.llm.pivot_links import near_vectors
from rillflow.llm.prefix_trie import prefix_trie
from tests.llm.helpers import awkward, documents
from tests.oracle import connect, sql_bag


def collocation_truth(rows, least, best, most_words=5, share=100):
    """Rows by plain counting, from (lang, text)."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(len(words)):
                for n in range(1, min(most_words, len(words) - k) + 1):
                    counts[lang][tuple(words[k : k + n])] += 1
    out = []
    for lang, own in counts.items():
        f = {g: a for g, a in own.items() if a >= least}
        scored = []
        for g, a in f.items():
            if len(g) == 1:
                continue
            score, k = min((1000 * a * totals[lang] // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            inside = any(len(o) > len(g) and 100 * b >= share * a and any(o[i : i + len(g)] == g for i in range(len(o) - len(g) + 1)) for o, b in f.items())
            if not inside:
                scored.append((-score, -a, " ".join(g).encode(), a, f[g[:k]], f[g[k:]], totals[lang], score))
        for rank, x in enumerate(sorted(scored)[:best], 1):
            out.append((lang, rank, x[2].decode(), *x[3:]))
    return sorted(out)


def phrase_rows(n, seed):
    rng = random.Random(seed)
    words = ["red", "Fire", "é", "a", "b", "c", "zz", "x-y", "'t", "\x00", "日本", "rare%d"]
    for k in range(n):
        text = "".join(rng.choice(words).replace("%d", str(rng.random())) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\x0b", "!", " "]) for _ in range(rng.choice([0, 1, 4, 30])))
        yield k, rng.choice(["en", "en", None, "de"]), text


@pytest.mark.parametrize(("least", "best"), [(3, 2000), (5, 4), (2, 1)])
def test_collocations(spark, least, best):
    rows = list(phrase_rows(250, least))
    rows += [(900, "en", None), (901, "fr", ""), (902, None, "one two three four five six " * 400), (903, "en", "same same same same same"), (903, "en", "same same same same same"), (None, "de", "no id no id no id")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    for name in ("phrase", "n", "hash", "run", "rank", "score", "size"):
        df = df.withColumn(name, F.lit(1))
    got = sorted(tuple(r) for r in collocations(df, least=least, best=best).collect())
    assert got == collocation_truth([r[1:] for r in rows], least, best)


def test_collocations_share_and_small_bits(spark, monkeypatch):
    """A share below 100 drops more; a table of bits that is nearly full changes nothing."""
    rows = [(k, "en", t) for k, (_, _, t) in enumerate(phrase_rows(200, 11))] + [(900 + k, "en", "p q r. p q" if k < 2 else "p q r") for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    want = collocation_truth([r[1:] for r in rows], 3, 2000, share=60)
    assert sorted(tuple(r) for r in collocations(df, least=3, share=60).collect()) == want
    assert len(want) < len(collocation_truth([r[1:] for r in rows], 3, 2000))
    full = np.full(1 << (phrases.BITS - 6), 2**64 - 1, np.uint64)
    monkeypatch.setattr(phrases, "bit_table", lambda hashes: full)
    assert sorted(tuple(r) for r in collocations(df, least=3, share=60).collect()) == want


def test_collocations_of_nothing(spark):
    assert collocations(documents(spark, [])).count() == 0
    assert collocations(awkward(spark, [(1, None), (2, ""), (3, "a b c d e f")])).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000
    pairs = spark.createDataFrame([("en", "a b", 2, big, 99_000_000_000_000)], "lang string, phrase string, size int, a long, n long")
    parts = spark.createDataFrame([("en", "a", big + 1), ("en", "b", 3 * big)], "lang string, phrase string, a long")
    row = phrases.scored(pairs, parts).first()
    assert row["score"] == 1000 * big * 99_000_000_000_000 // ((big + 1) * 3 * big)


# -- near vectors


def vector_rows(n, seed, dim=24):
    """Groups near a center, copies, scaled copies, loose vectors and every kind of unusable one."""
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for label in (0, 1):
        for _ in range(n // 20):
            center = rng.normal(size=dim)
            for _ in range(8):
                rows.append((k, [float(np.float32(x)) for x in center + rng.normal(size=dim) * rng.choice([0.05, 0.2, 0.3])], label))
                k += 1
        for _ in range(n // 4):
            rows.append((k, [float(np.float32(x)) for x in rng.normal(size=dim)], label))
            k += 1
    first = rows[0][1]
    rows += [(k, first, 0), (k + 1, first, 0), (k + 2, first, 1), (k + 3, [2 * x for x in first], 0), (k + 4, first, None), (k + 5, None, 0), (k + 6, [], 0), (k + 7, [0.0] * dim, 0), (k + 8, [float("nan")] + first[1:], 0), (k + 9, [float("inf")] + first[1:], 0)]
    rows += [(k + 10, [None, *first[1:]], 0), (None, first, 0), (k + 11, first[:5], 0), (k + 12, first[:5], 0), (k + 13, rows[1][1], 0), (k + 13, rows[1][1], 0)]
    return rows


def vector_truth(rows, least=0.93):
    usable = [i for i, (v, x, label) in enumerate(rows) if v is not None and label is not None and x and None not in x and np.isfinite(x).all() and np.any(x)]
    links, low = Counter(), {i: i for i in usable}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, j in combinations(usable, 2):
        a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
        if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
            links[i] += 1
            links[j] += 1
            low[root(j)] = root(i)
    smallest = {}
    for i in usable:
        smallest[root(i)] = min(smallest.get(root(i), rows[i][0]), rows[i][0])
    return Counter((v, links[i], smallest[root(i)] if i in low else v, (smallest[root(i)] if i in low else v) == v) for i, (v, _, _) in enumerate(rows))


@pytest.mark.parametrize(("block_rows", "pivots"), [(1024, 64), (3, 64), (7, 4)])
def test_near_vectors(spark, monkeypatch, block_rows, pivots):
    """Also with lists cut to small blocks, and without enough pivots for an index, where one list holds all."""
    monkeypatch.setattr(pivot_links, "BLOCK_ROWS", block_rows)
    rows = vector_rows(200, block_rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for name in ("name", "node", "n", "list", "dim", "u", "v", "kept", "vector"):
        df = df.withColumn(name, F.lit(1))
    got = Counter(tuple(r) for r in near_vectors(df, pivots=pivots).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == vector_truth(rows)
    assert near_vectors(df.limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    """Of pairs whose cosine is barely above the threshold, in 64 dimensions among loose vectors, nearly all are found."""
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for _ in range(400):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (b @ a) * a
        cos = rng.uniform(0.931, 0.95)
        rows += [(k, a.tolist(), 1), (k + 1, (cos * a + np.sqrt(1 - cos * cos) * b / np.linalg.norm(b)).tolist(), 1)]
        k += 2
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).filter("n_links = 1").count()
    assert got >= 0.97 * len(rows)


def test_every_pair_has_one_list():
    """Whatever two vectors' pivots are, exactly one of the lists that they share counts the pair."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        two = np.stack([rng.permutation(14)[: pivot_links.NEAREST] for _ in range(2)])
        lists = [set(x) for x in pivot_links_numbers(two)]
        both = lists[0] & lists[1]
        counted = 0
        for number in both:
            allowed, pattern = pivot_links.counted_here(two, number)
            counted += bool(allowed[pattern[0], pattern[1]])
        assert counted == (len(set(two[0]) & set(two[1])) >= pivot_links.SHARED)


def pivot_links_numbers(nearest):
    """The lists of each vector, by the definition."""
    for row in np.sort(nearest, axis=1).tolist():
        yield [sum(p << (pivot_links._BITS * (pivot_links.SHARED - 1 - k)) for k, p in enumerate(s)) for s in combinations(row, pivot_links.SHARED)]


# -- prefix tries


def trie_truth(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            signed = tuple(int.from_bytes(digest[at : at + 8], "big", signed=True) for at in (0, 8))
            own[c].append(((turn is not None, turn or 0), signed, (role or "", text or "")))
    turns = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    paths = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        paths[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    nodes = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
    children = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members) - 1) * (len(p[-1][1]) if p else 0)
    out = Counter()
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if paths[c] == p)))
        out[(min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def trie_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-120, 420), 160) + [10_000, 20_000_000_000]:
        for k in range(rng.choice([1, 1, 2, 3, 7, 9])):
            rows.append((c, rng.choice([k, k, k, None]), rng.choice(["user", "user", "bot", None]), rng.choice(["hi", "hi", "yes", "é😀", "", None])))
    rows += [(100, k, "user", "long " * k) for k in range(60)] + [(101, k, "user", "long " * k) for k in range(60)]
    return rows + rows[:9] + [(None, 1, "user", "nobody"), (7, 1, "us", "erx"), (8, 1, "user", "x")]


@pytest.mark.parametrize("span", [4096, 3])
def test_prefix_trie(spark, monkeypatch, span):
    """With spans of ids so small that a node's digest runs over many of them, too."""
    from rillflow.llm import prefix_trie as module

    monkeypatch.setattr(module, "ID_SPAN", span)
    rows = trie_rows(span)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("x", "y", "n", "at", "depth", "px", "low", "length", "__row"):
        df = df.withColumn(name, F.lit(1))
    got = Counter(tuple(r) for r in prefix_trie(df).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())
    assert got == trie_truth(rows)
    assert prefix_trie(df.limit(0)).count() == 0


def test_turnless_conversation_is_a_member_of_the_root(spark):
    """A conversation whose turns are all replaced by those of an absent one has none left and ends at the root."""
    c = next(k for k in range(1, 99) if zlib.crc32(str(k).encode()) % 6 == 5)
    rows = [(c, 1, "user", "gone")]
    got = prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_sql_crc_is_the_crc():
    """The SQL of the trie computes the same h as zlib."""
    con = connect()
    con.execute("CREATE OR REPLACE VIEW conversations AS SELECT range AS conv_id, 1 AS turn, 'u' AS role, 't' AS text FROM range(0, 400, 7)")
    from rillflow.llm.sql import OP13

    rows = [(k, 1, "u", "t") for k in range(0, 400, 7)]
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    order = sorted(range(len(names)), key=lambda k: names[k])
    assert sql_bag(con, OP13) == Counter({tuple(r[k] for k in order): n for r, n in trie_truth(rows).items()})
