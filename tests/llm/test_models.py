"""Trained operators: gradients, held-out accuracy, and the pipeline."""

from collections import Counter

import numpy as np

import corpus_pipeline
from rillflow.llm import language_id, licenses
from rillflow.llm.bigru import BiGru
from rillflow.llm.suffix_array import repeated_prefixes, suffix_array
from tests.llm.helpers import awkward, documents
from tests.oracle import SMALL


def test_backpropagation_equals_differences():
    rng = np.random.default_rng(0)
    net = BiGru(3, hidden=4)
    net.params = [x.astype(np.float64) for x in net.params]
    lengths = np.array([5, 4, 4, 1])
    pieces = rng.integers(97, 103, (4, 8)).astype(np.uint8)
    labels = np.array([0, 2, 1, 1])
    _, grads = net.gradients(pieces, lengths, labels)
    for param, grad in zip(net.params, grads, strict=True):
        for place in map(tuple, rng.integers(0, param.shape, (6, param.ndim))):
            place = (int(pieces[0, 0]), *place[1:]) if param.shape[0] == 256 else place
            kept, step = param[place], 1e-3
            param[place] = kept + step
            up, _ = net.gradients(pieces, lengths, labels)
            param[place] = kept - step
            down, _ = net.gradients(pieces, lengths, labels)
            param[place] = kept
            assert abs((up - down) / (2 * step) - grad[place]) < 2e-4


def test_labels_against_a_plain_network():
    """Every byte labelled by plain recurrences over the windows, pooled over the whole text; words do not reset the state."""
    net = BiGru(3, seed=4)
    net.params[5] = np.array([0.1, -0.2, 0.05], np.float32)
    table_f, rec_f, table_b, rec_b, out, bias = (x.astype(np.float64) for x in net.params)
    hidden = net.hidden

    def states(data, table, rec):
        h, all_ = np.zeros(hidden), []
        for c in data:
            x, r = table[c], h @ rec
            update, reset = (np.clip(0.25 * (x[k : k + hidden] + r[k : k + hidden]) + 0.5, 0, 1) for k in (0, hidden))
            h = update * h + (1 - update) * np.clip(x[2 * hidden :] + reset * r[2 * hidden :], -1, 1)
            all_.append(h)
        return all_

    def truth(text):
        data = [32 if c in b" \t\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in text]
        total = np.zeros(3)
        for at in range(0, len(data), 256):
            part = data[at : at + 256]
            for f, b in zip(states(part, table_f, rec_f), states(part[::-1], table_b, rec_b)[::-1], strict=True):
                z = np.exp(np.concatenate([f, b]) @ out + bias)
                total += z / z.sum()
        return total / max(len(data), 1)

    texts = [b"A", b"Hello there, General.\nHow are YOU today?", "é à la carte ".encode() * 40, b"", b"12 34", b"x" * 256, b"y" * 257]
    got = language_id.label_texts(texts, ["a", "b", "c"], net)
    for text, (name, score) in zip(texts, got, strict=True):
        p = truth(text)
        if any(map(str.isalpha, text.decode())):
            assert name == "abc"[int(p.argmax())] and abs(score - p.max()) < 1e-4
        else:
            assert (name, score) == ("und", 0.0)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language_id.language_id(docs).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and len(held) > 20
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(language_id, "STEPS", 20)
    texts = [(1, None), (2, ""), (3, "12 ½² !!"), (4, "hello there " * 3000), (5, "hello"), (5, "hello"), (None, "bonjour"), (8, "x" * 3000), (9, "é")]
    rows = language_id.language_id(awkward(spark, texts)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts)
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 3}
    unlabelled = language_id.language_id(documents(spark, texts, lang=lambda k: None)).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
    assert language_id.language_id(documents(spark, [])).count() == 0
    assert language_id.keep_identified(documents(spark, [])).count() == 0
    kept = language_id.keep_identified(awkward(spark, texts), least_score=0.0)
    assert Counter(r.doc_id for r in kept.collect()) == Counter([4, 5, 5, None, 8, 9])
    assert Counter(r.doc_id for r in language_id.keep_identified(documents(spark, texts, lang=lambda k: None)).collect()) == Counter([4, 5, 5, None, 8, 9])


def test_licenses(spark):
    texts = [
        (1, "Text here.\nReleased under the MIT License.\nMore text."), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "Licensed under CC BY-NC 4.0."), (4, "Licensed under the Apache License, Version 2.0."),
        (5, "She was licensed to drive in the city."), (6, None), (7, ""), (None, "Released under the MIT License."), (8, "words and more words " * 3000), (9, "redistribution and use in source and binary forms, with or without modification, are permitted"),
    ]
    filler = [(100 + k, f"Ordinary words number {k} stand in this line.\nAnother line follows it here {k}.") for k in range(40)]
    got = {r.doc_id: r.families for r in licenses.scan_licenses(awkward(spark, texts + filler)).collect()}
    assert [got[k] for k in (1, 2, 3, 4, 5, 6, 7, None, 8, 9)] == ["MIT", "GPL-3.0", "CC-BY-NC", "Apache-2.0", "", "", "", "MIT", "", "BSD"]
    assert not any(got[100 + k] for k in range(40))
    assert licenses.scan_licenses(documents(spark, [])).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(400):
        s = rng.integers(1, rng.choice([3, 5, 200]), rng.integers(0, 70))
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda k: s[k:].tolist())
    strings = [b"abcabc", b"xabcx", b"zz"]
    of = np.array([0, 0, 0, 0, 1, 1, 1])
    at = np.array([0, 1, 2, 3, 0, 1, 2])
    assert repeated_prefixes(strings, at, of, 3).tolist() == [True, False, False, True, False, True, False]


def test_pipeline_against_brute_force(spark):
    """Copies go, one of each group stays, the mix meets its targets, and every drawn document is packed whole."""
    from rillflow.llm.packing import default_tokenizer, token_ids
    from tests.llm.test_contracts import lower, near_truth, words

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert 4 <= len(stage) <= 5
    known = stage["language_id"](spark, docs, SMALL)
    assert known.columns == docs.columns
    assert known.count() >= 0.98 * docs.count()
    exact = stage["exact_dedup"](spark, known, SMALL)
    texts = [(r.doc_id, r.text) for r in known.collect()]
    last = {}
    for i, t in sorted(texts):
        last[lower(t)] = i
    assert sorted(r.doc_id for r in exact.collect()) == sorted(last.values())
    near = stage["near_dedup"](spark, exact, SMALL)
    truth = near_truth([(r.doc_id, r.text) for r in exact.collect()], 80)
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, (_, c) in truth.items() if i == c)
    mixed = stage["mix_sources"](spark, near, SMALL)
    size = {r.doc_id: (r.source, words(r.text)) for r in near.collect()}
    drawn = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    total = sum(n for _, n in size.values())
    assert abs(sum(size[i][1] * k for i, k in drawn.items()) - total) <= 0.05 * total
    assert max(drawn.values()) <= 3
    packed = stage["pack"](spark, mixed, SMALL).collect()
    ids_of = token_ids(*default_tokenizer())
    text = {r.doc_id: r.text for r in near.collect()}
    assert sum(r.length for r in packed) == sum((len(ids_of(text[i])) + 1) * k for i, k in drawn.items())
    run = corpus_pipeline.run(spark, SMALL).collect()
    pieces = lambda rows: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    assert pieces(run) == pieces(packed)
