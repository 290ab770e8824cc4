"""Places where an operator once did less than its whole job."""

import hashlib
import random
import re
import textwrap
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from rillflow.llm import language_id, licenses, near_dedup, registry
from rillflow.llm.components import components
from rillflow.llm.mixing import mix
from rillflow.llm.near_dedup import keep_representatives
from rillflow.llm.secrets import scan_secrets
from rillflow.llm.syncmers import anchors_of, fingerprints
from tests.llm.helpers import documents
from tests.llm.test_contracts import shingles
from tests.oracle import SMALL


def test_near_copies_at_both_thresholds(spark):
    """At 0.80, the threshold of the pipeline, the pairs between 0.80 and 0.85 are linked, too; the truth is a brute force of all pairs."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.select("doc_id", "text").collect()}
    ids, kept = sorted(sets), {}
    for percent in (80, 85):
        low = {i: i for i in ids}
        for k, a in enumerate(ids):
            for b in ids[:k]:
                common = len(sets[a] & sets[b])
                if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common) and low[a] != low[b]:
                    old, new = max(low[a], low[b]), min(low[a], low[b])
                    low = {i: new if x == old else x for i, x in low.items()}
        kept[percent] = sorted(i for i in ids if low[i] == i)
        assert sorted(r.doc_id for r in keep_representatives(docs, percent=percent).collect()) == kept[percent]
    assert len(kept[80]) < len(kept[85])


def _grant(name, version, kind="program"):
    return f"This {kind} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


HEADERS = {
    "GPL-2.0": _grant("GNU General Public License", "2"),
    "GPL-3.0": _grant("GNU General Public License", "3"),
    "AGPL-3.0": _grant("GNU Affero General Public License", "3"),
    "LGPL": _grant("GNU Lesser General Public License", "2.1", "library"),
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
}


def test_wrapped_licence_headers(spark):
    """A hard-wrapped notice names its family and no other, alone and between lines of code, in each usual comment form."""
    texts, want = [], {}
    for family, notice in HEADERS.items():
        for width in (30, 70):
            for mark in ("", " * ", "# ", "// "):
                body = "\n".join(mark + x for x in textwrap.wrap(notice, width))
                tail = f"\n{mark}This program is distributed in the hope that it will be useful, but without any\n{mark}warranty. See the GNU General Public License for more details.\n"
                for text in (body, f"{mark}Copyright (C) 2020 Jane Roe\n{body}\nint main(void) {{ return count(7); }}\n", f"{body}\n{mark}{tail}"):
                    want[len(texts)] = family
                    texts.append((len(texts), text))
    filler = [(1000 + k, f"Ordinary words number {k} stand in this line.\nAnother line follows it here {k}.\n\nA second paragraph.") for k in range(40)]
    one_line = [(2000, "A line.\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0.\nAnother line.")]
    got = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, texts + filler + one_line)).collect()}
    assert {k: got[k].families for k in want} == want
    assert got[2000].families == "Apache-2.0,MIT" and got[2000].n_paragraphs == 1
    assert not any(got[1000 + k].families or got[1000 + k].n_paragraphs != 2 for k in range(40))
    listed = licenses.scan_licenses(documents(spark, [(1, "of the License, or (at your option)\nThis work is licensed under the GNU General Public License, version 3."), *filler])).filter("doc_id = 1").first()
    assert (listed.families, listed.n_notices) == ("GPL-3.0", 1)


def test_fingerprints_of_long_texts_share_a_passage(spark):
    """Two texts of 50 KB that share 500 bytes have common anchors in their fingerprints and a likeness above 0."""
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    common = noise(500)
    texts = [(1, noise(25_000) + common + noise(25_000)), (2, noise(10_000) + common + noise(40_000)), (3, common)]
    got = {r.doc_id: r for r in fingerprints(documents(spark, texts)).collect()}
    kept = {i: {x.split("@")[0] for x in r.fingerprint.split(",")} for i, r in got.items()}
    assert len(kept[1]) > 10 * len(kept[3])
    assert len(kept[1] & kept[2]) >= 10 and len(kept[2] & kept[3]) >= 10
    assert 0 < got[1].near_next < 0.02 and 0 < got[2].near_next < 0.02


def test_short_and_long_texts_have_fingerprints_of_one_rule(spark, tmp_path):
    """The query keeps, in texts of any length, what is smallest in some window of 8 anchors that may stick out of the text; one more word changes a print at its end only."""
    rng = random.Random(11)
    words = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    docs = documents(spark, [(k, " ".join(words[:k])) for k in range(81)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: [x.split("@")[0] for x in r.fingerprint.split(",") if x] for r in registry.op3_syncmer_fingerprints(spark, str(tmp_path)).collect()}
    for k in range(1, 81):
        value = anchors_of(" ".join(words[:k]).encode())
        value = value[1][np.argsort(value[0])].tolist()
        windows = [value[max(0, j) : j + 8] for j in range(-7, len(value))]
        assert got[k] == [f"{h:08x}" for h in value if any(h == min(w) for w in windows if w)]
    prints = [set(got[k]) for k in range(4, 81)]  # from the first text of more than one anchor on
    assert all(len(a & b) >= len(a) - 8 for a, b in zip(prints, prints[1:], strict=False))


def test_the_score_limit_is_that_of_all_held_out_documents(spark):
    """A single rightly named document of a low score, at any place among 600, sets the limit; so does one whose low score is beyond its first 8,192 characters."""

    class Net:
        def sums(self, windows, lengths):
            low = (windows[:, 0] == ord("q"))[:, None]
            return np.where(low, [0.3, 0.25, 0.25, 0.2], [1.0, 0.0, 0.0, 0.0]) * lengths[:, None]

    model = (["en", "a", "b", "c"], Net())
    ids = [k for k in range(2600) if zlib.crc32(str(k).encode()) % 4 == language_id.HELD_OUT][:600]
    for odd in ids[::150]:
        docs = documents(spark, [(k, "q" * 30 if k == odd else "a" * 30) for k in ids])
        assert language_id.score_limit(docs, model) == pytest.approx(language_id.SHARE_OF_LOWEST * 0.3)
    long = documents(spark, [(ids[0], "a" * 8192 + "q" * 3 * 8192)])
    assert language_id.score_limit(long, (model[0], model[1])) == pytest.approx(min(language_id.MOST_LIMIT, language_id.SHARE_OF_LOWEST * (0.25 + 0.75 * 0.3)))
    assert language_id.score_limit(documents(spark, [(ids[0], "a")], lang=lambda k: "zz"), model) == 0.0


def test_a_tiny_language_spoils_no_other(spark):
    """One labelled document of two letters, and one of a single letter, leave the held-out accuracy of the others where it was."""
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    tiny = documents(spark, [(1_000_000 + k, t) for k, t in enumerate(["ab", "z", "ab"])], lang=lambda k: ["xx", "yy", "xx"][k])
    assert tiny.filter(language_id.fold(tiny.doc_id) != language_id.HELD_OUT).count() >= 2
    both = docs.unionByName(tiny)
    model = language_id.fit(both)
    assert {"xx", "yy"} & set(model[0]) and len(model[0]) > 4
    found = language_id.identify(both, model).join(docs.select("doc_id", "lang", "text"), "doc_id").filter("held_out and lang is not null and lang_pred != 'und'")
    right, n = found.selectExpr("count_if(lang = lang_pred)", "count(*)").first()
    assert right >= 0.99 * n
    limit = language_id.score_limit(both, model)
    assert 0 < limit <= language_id.MOST_LIMIT
    assert found.filter(f"lang = lang_pred and score < {limit}").count() == 0


def test_many_secrets_in_one_text(spark):
    """500,000 findings in one text within a minute; every place as a plain search gives it."""
    lines = [hashlib.md5(str(k).encode()).hexdigest() for k in range(500_000)]
    docs = documents(spark, [(1, "\n".join(lines)), (2, "\n".join("é secret: " + x for x in lines[:300]))])
    began = time.perf_counter()
    rows = {r.doc_id: r for r in scan_secrets(docs).collect()}
    assert time.perf_counter() - began < 60
    assert rows[1].n_hex == 500_000
    assert rows[1].spans == ",".join(f"hex:{33 * k}:{33 * k + 32}" for k in range(500_000))
    assert rows[2].spans == ",".join(f"assign:{43 * k + 2}:{43 * k + 42},hex:{43 * k + 10}:{43 * k + 42}" for k in range(300))


@pytest.mark.parametrize("loose", [0, 40])
def test_a_hot_key_is_linear(spark, monkeypatch, loose):
    """Nodes of one key that lie near its lowest one are dealt out at most twice; those that do not still find all their neighbours."""
    monkeypatch.setattr(near_dedup, "KEY_ROWS", 16)
    rng = np.random.default_rng(loose)
    base = rng.integers(0, 1 << 16, near_dedup.HASHES, dtype=np.uint16)
    other = np.where(np.arange(near_dedup.HASHES) < 8, base, rng.integers(0, 1 << 16, near_dedup.HASHES)).astype(np.uint16)  # one chunk in common
    rows = []
    for k in range(400 + loose):
        signature = (base if k < 400 else other).copy()
        signature[rng.choice(np.arange(8, near_dedup.HASHES), 6, replace=False)] = rng.integers(0, 1 << 16, 6)
        rows.append((k, signature.tobytes()))
    nodes = spark.createDataFrame(rows, "node long, signature binary")
    distance = near_dedup.distance_limit(80)
    met = nodes.selectExpr("node", "9L as key", "0L as low", f"{len(rows)}L as n")
    assert near_dedup.in_parts(near_dedup._signed(met, nodes)).count() <= 2 * len(rows)
    found = near_dedup.key_pairs(near_dedup._signed(met, nodes), distance)
    assert found.filter("key is not null").count() == loose
    pairs = near_dedup.candidate_pairs(nodes, distance)
    groups = {r.component: r.n for r in components(pairs).groupBy("component").count().withColumnRenamed("count", "n").collect()}
    assert groups == ({0: 400, 400: loose} if loose else {0: 400})
    matrix = np.stack([np.frombuffer(x, np.uint16) for _, x in rows])
    assert all((matrix[r.u] != matrix[r.v]).sum() <= distance for r in pairs.collect())


def test_null_ids_in_bulk_are_many_keys(spark):
    """A third of all rows without an id: their keys spread over the ranges and the mix meets its targets."""
    texts = [(None if k % 3 == 0 else k, f"w{k} " * (1 + k % 7)) for k in range(3_000)]
    rows = mix(documents(spark, texts, source=lambda k: "ab"[k % 2]), rows_per_range=50).collect()
    keys = [r.mix_key for r in rows if r.doc_id is None]
    assert len(keys) == 1_000 and len(set(keys)) == 1_000
    assert max(Counter(k[:1] for k in keys).values()) < 150
    for target in {r.target for r in rows}:
        assert abs(sum(r.taken for r in rows if r.target == target) - target) <= 1


FOREIGN_NOTICES = (
    "Licensed under the Eclipse Public License, Version 2.0.", "Apache License, Version 1.1", "Released under the zlib License.", "Distributed under the Boost Software License, Version 1.0.", "Licensed under the Microsoft Public License.",
    "Licensed under the Open Software License version 3.0.", "Licensed under the Academic Free License version 3.0.", "Licensed under the EUPL, Version 1.2.", "This work is licensed under the Artistic License, version 2.0.", "Licensed under the CeCILL license, version 2.1.",
)


def test_other_licences_are_no_family(spark):
    """Notices of licences that the templates do not have name none, also of licences that no training row names; the known ones beside them keep theirs."""
    texts = [(k, f"Some words stand here.\n\n{x}\n\nAnd more words.") for k, x in enumerate(FOREIGN_NOTICES)]
    known = [(100, "Released under the MIT License."), (101, "Licensed under the Mozilla Public License, version 2.0."), (102, "Licensed under the Apache License, Version 2.0.")]
    filler = [(1000 + k, f"Ordinary words number {k} stand in this line.\nAnother line follows it here {k}.") for k in range(40)]
    got = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, texts + known + filler)).collect()}
    assert [got[k].families for k, _ in texts] == [""] * len(texts)
    assert sum(":unknown:" in got[k].notices for k, _ in texts) >= 8
    assert [got[k].families for k, _ in known] == ["MIT", "MPL-2.0", "Apache-2.0"]


def plain_line(model, line):
    """Probabilities of a line by plain sums over its words and word pairs."""
    names = licenses.lines_of([line.encode()])[0].tolist()
    mixed = lambda x: int(licenses.mix64(np.array([x], np.uint64))[0]) >> (64 - licenses.BITS)
    used = [mixed(x) for x in names] + [mixed((a * 3 + b) % 2**64) for a, b in zip(names, names[1:], strict=False)] + [1 << licenses.BITS]
    z = sum(model.weights[u].astype(float) for u in used) / (2 * len(names)) ** 0.5 + model.bias
    notice = 1 / (1 + np.exp(-(np.log(np.exp(z[1:]).sum()) - z[0]) / model.notice_temperature))
    shares = np.exp(z[1:] / model.family_temperature)
    return [1 - notice, *(notice * shares / shares.sum())]


def plain_confirm(line, family):
    """Whether the templates bear a family out, from words as text."""
    words = lambda t: re.findall("[a-z0-9]+", t.lower())
    pairs = lambda t: set(zip(words(t), words(t)[1:], strict=False))
    most = {f: max(len(pairs(line) & pairs(t)) for t in ts) for f, ts in licenses.TEMPLATES.items()}
    if any(n >= most[family] for f, n in most.items() if f != family):
        return False
    version = re.search(r"-(\d+)\.", family)
    for t in licenses.TEMPLATES[family]:
        own = {w for w in words(t) if not w.isdigit() and not any(w in words(x) for f, ts in licenses.TEMPLATES.items() if f != family for x in ts)}
        least = len(own) if len(words(t)) <= 12 else -(-len(own) // 2)
        if len(pairs(line)) < len(pairs(t)):
            least = min(least, -(-len(own) * len(pairs(line)) // (2 * len(pairs(t)))))
        if len(pairs(line) & pairs(t)) >= 0.5 * max(3, min(len(pairs(line)), len(pairs(t)))) and len(own & set(words(line))) >= least and (not version or version[1] in words(line)):
            return True
    return False


def test_labels_and_confirmation_by_plain_loops(spark):
    """Every line of real documents, of templates, parts of them and of other licences: the listed family and probability are those of plain sums and word sets."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = licenses.fit(docs)
    rng = random.Random(1)
    lines = [x for r in docs.orderBy("doc_id").limit(60).collect() for x in r.text.split("\n") if any(c.isascii() and c.isalnum() for c in x) and x.isascii()][:300]
    lines += [x for ts in licenses.TEMPLATES.values() for x in ts] + list(FOREIGN_NOTICES) + list(licenses.FOREIGN)
    for ts in licenses.TEMPLATES.values():
        for t in ts:
            words = t.split()
            at = rng.randrange(max(1, len(words) - 8))
            lines.append(" ".join(words[at : at + rng.randrange(6, 20)]))
    rows = licenses.scan(documents(spark, list(enumerate(lines))), model).collect()
    named = 0
    for r in rows:
        p = plain_line(model, lines[r.doc_id])
        best = int(np.argmax(p[1:]))
        family = model.families[best]
        if abs(1 - p[0] - licenses.LEAST_PROBABILITY) < 1e-3:
            continue
        if 1 - p[0] < licenses.LEAST_PROBABILITY:
            assert r.notices == ""
            continue
        sure = family != licenses.UNKNOWN and plain_confirm(lines[r.doc_id], family)
        place, name, score = r.notices.split(":")
        assert (place, name) == ("0", family if sure else licenses.UNKNOWN), lines[r.doc_id]
        assert abs(float(score) - (p[best + 1] if sure else 1 - p[0])) < 1e-3
        named += sure
    assert named >= 40


def test_calibration_on_templates_that_were_held_out(spark):
    """A probability means something: on notices that the first model has not seen the loss at the chosen temperatures is the least."""
    model = licenses.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert licenses.TEMPERATURES[0] < model.notice_temperature < licenses.TEMPERATURES[-1]
    assert licenses.TEMPERATURES[0] < model.family_temperature < licenses.TEMPERATURES[-1]
    p = model.probabilities(np.random.default_rng(1).normal(size=(50, len(model.bias))) * 40)
    assert np.isfinite(p).all() and np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
