import random

import numpy as np
import pytest

from pathfold.llm import hyper_minhash as hm
from pathfold.llm.hyper_minhash import near_classes
from pathfold.llm.queries import op12_hyper_minhash

from .helpers import documents, fresh, linked, odd_rows
from .test_joins_and_mix import near_texts


def by_hand(spark, rows, n, percent=80):
    docs = documents(spark, [(i, t, None, None, 0, "", "", "") for i, t in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_classes(docs, n, percent).collect()}
    want = linked(rows, n, percent)
    assert got == want
    return want


@pytest.mark.parametrize("n, percent", [(2, 80), (5, 90)])
def test_classes_by_hand(spark, n, percent):
    assert sum(v[1] != i for i, v in by_hand(spark, near_texts(n), n, percent).items()) > 20


def test_crowds_that_no_link_connects(spark, monkeypatch):
    """A passage that makes many texts alike but not alike enough, chains, and a crowd of copies."""
    monkeypatch.setattr(hm, "SHARE", 8)
    monkeypatch.setattr(hm, "HEAD_SHARE", 4)
    monkeypatch.setattr(hm, "TILE_GRAMS", 3000)
    monkeypatch.setattr(hm, "SLAB", 64)
    rng = random.Random(11)
    passage = fresh(rng, 70)
    texts = [passage + " " + fresh(rng, rng.randrange(14, 24)) for _ in range(90)]
    base = fresh(rng, 200).split()
    for _ in range(60):  # copies of one text, which often differ too much from one another
        words = list(base)
        for _ in range(rng.randrange(0, 11)):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    chain = fresh(rng, 120).split()
    for i in range(30):  # each links with its neighbours alone
        chain[rng.randrange(120)] = f"y{i}"
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    by_hand(spark, list(enumerate(texts)), 2)


def test_odd_rows(spark, tmp_path):
    docs = documents(spark)
    out = near_classes(docs, 2)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and out.count() == len(odd_rows())
    rows = out.collect()
    want = linked([(r[0], r[1]) for r in odd_rows() if r[0] is not None], 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert {r.component_id for r in rows if r.doc_id is None} == {4}
    assert near_classes(documents(spark, [])).count() == 0
    lone = [(None, "no id at all", *odd_rows()[0][2:])] * 2 + [(7, None, *odd_rows()[0][2:])]
    assert {tuple(r) for r in near_classes(documents(spark, lone)).collect()} == {(None, 1, None, True), (7, 0, 7, True)}
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert op12_hyper_minhash(spark, str(tmp_path)).count() == len(odd_rows())


def test_registers_and_estimates():
    rng = np.random.default_rng(3)
    for size, share in ((12, 0.8), (60, 0.9), (400, 0.8), (3000, 0.3), (20_000, 0.8)):
        far = []
        for _ in range(20):
            common = round(2 * size * share / (1 + share))
            grams = rng.integers(0, 1 << 63, 2 * size - common, dtype=np.uint64)
            a, b = grams[:size], grams[size - common :]
            cls = int(hm.size_class(np.array([size]))[0])
            regs = [hm.registers(x, np.zeros(size, np.int64), 1, cls)[0] for x in (a, b)]
            same = np.array([(regs[0] == regs[1]).mean()])
            true = common / (2 * size - common)
            far.append(hm.estimate(same, np.array([size]), np.array([size]), np.array([cls]))[0] - true)
        assert abs(np.mean(far)) < 0.02 and max(map(abs, far)) < hm.MARGIN


def test_collision_rate_as_drawn():
    rng = np.random.default_rng(4)
    for size in (8, 512, 8192):
        cls = int(hm.size_class(np.array([size]))[0])
        n = 300
        a, b = (
            hm.registers(rng.integers(0, 1 << 63, n * size, dtype=np.uint64), np.repeat(np.arange(n), size), n, cls) for _ in range(2)
        )
        rate = hm.collision_rate(np.array([size]), np.array([size]), np.array([cls]))[0]
        empty = (a == hm.EMPTY) & (b == hm.EMPTY)
        assert abs((a == b)[~empty].mean() - rate) < 5 * (rate / (n * hm.REGISTERS)) ** 0.5 + 2e-5


def test_classes_of_partners():
    size = np.arange(1, 5000)
    for percent in (80, 90, 100):
        low, own = hm.size_class(hm.least_partner(size, percent)), hm.size_class(size)
        assert ((own - low == 0) | (own - low == 1)).all()
    with pytest.raises(ValueError):
        near_classes(None, 2, 70)


def test_compressed_values():
    values = np.array([0, 1, 3, (1 << 52) - 1, 1 << 51, (1 << 51) + (1 << 41)], np.uint64)
    zeros, bits = hm.compress(values) >> 10, hm.compress(values) & 1023
    assert zeros.tolist() == [52, 51, 50, 0, 0, 0] and bits.tolist() == [0, 0, 512, 1023, 0, 1]
