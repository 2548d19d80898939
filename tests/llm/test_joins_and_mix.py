import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathfold.llm.graph import components
from pathfold.llm.ngram_join import SHARED, crowded_buckets, keep_one, link_classes, parts_of, product_links, registrations
from pathfold.llm.source_mix import mix_sources, plan_documents, plan_mix, source_targets

from .helpers import WORD, documents, fresh, linked, odd_rows


def near_texts(seed=1, groups=12, copies=9):
    """Groups of copies with ever more changed words, over a passage that most texts share."""
    rng = random.Random(seed)
    passage = fresh(rng, 50)
    out = []
    for g in range(groups):
        base = fresh(rng, rng.choice([4, 9, 12, 30, 80, 250])).split()
        for c in range(copies):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(words) // 12)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(999)}"
            if rng.random() < 0.3:
                words = words[: rng.randrange(len(words) * 9 // 10, len(words) + 1)]
            out.append(" ".join(words) + ("\n" + passage if g % 3 else ""))
    out += [passage.upper(), passage, "", None, " \n"]
    rng.shuffle(out)
    return [(i * 3, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_classes_by_hand(spark, n, percent):
    rows = near_texts(n)
    docs = documents(spark, [(i, t, None, None, 0, "", "", "") for i, t in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in link_classes(docs, n, percent / 100).collect()}
    want = linked(rows, n, percent)
    assert got == want and sum(v[1] != i for i, v in want.items()) > 20
    stay = {r.doc_id for r in keep_one(docs, n, percent / 100).collect()}
    assert stay == {i for i, (_, c) in want.items() if c == i}


def test_classes_of_odd_rows(spark):
    docs = documents(spark)
    out = link_classes(docs)
    assert out.count() == len(odd_rows())
    by_id = {}
    for r in out.collect():
        by_id.setdefault(r.doc_id, []).append(r)
    assert len(by_id[9]) == 2 and by_id[1][0].n_shingles == 0 and by_id[1][0].component_id == 1 and by_id[3][0].root is None
    assert by_id[12][0].component_id == 11 and by_id[None][0].component_id == by_id[8][0].component_id == 4
    want = linked([(r[0], r[1]) for r in odd_rows() if r[0] is not None], 5, 80)
    assert {i: (r[0].n_shingles, r[0].component_id) for i, r in by_id.items() if i is not None} == want
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i, (_, c) in want.items() if c == i)
    assert link_classes(documents(spark, [])).count() == 0 and keep_one(documents(spark, [])).count() == 0


def test_parts_catch_every_linked_pair():
    """By the pigeonhole: at least spare + 1 parts are equal, for all sizes and worst differences."""
    for t in (0.8, 0.9):
        for x in range(1, 400):
            for y in range(x, int(x / t + 1e-9) + 1):
                shared = set(registrations(x, t)) & set(registrations(y, t))
                cls = registrations(x, t)[-1]
                assert cls in shared
                overlap = -(-int(round(t * 100)) * (x + y) // (100 + int(round(t * 100))))
                differ = x + y - 2 * overlap
                k, spare = parts_of(cls, t)
                assert differ <= 0 or k - differ >= spare + 1 >= SHARED


def test_product_in_slices_equals_counting(monkeypatch):
    from pathfold.llm import ngram_join

    rng = np.random.default_rng(4)
    base = rng.choice(5000, 300, replace=False)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(270, 300), replace=False), rng.integers(5000, 9000, rng.integers(0, 25))])).astype(np.uint64) for _ in range(40)]

    def forest(pairs):
        root = list(range(40))
        for i, j in pairs:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
        return root

    want = []
    for i in range(40):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 10 * common >= 8 * (len(sets[i]) + len(sets[j]) - common):
                want.append((i, j))
    assert 40 < len(want) < 780
    for columns in (7, 100, 4096):
        monkeypatch.setattr(ngram_join, "COLUMNS", columns)
        got = product_links(sets, 0.8)
        assert set(got) <= set(want) and forest(got) == forest(want)
        side = np.arange(40) % 2
        across = product_links(sets, 0.8, side)
        assert forest(across) == forest([(i, j) for i, j in want if side[i] != side[j]])


def test_large_blocks_are_tiled(spark, monkeypatch):
    from pathfold.llm import ngram_join

    monkeypatch.setattr(ngram_join, "TILE_ROWS", 8)
    rng = random.Random(9)
    base = fresh(rng, 150).split()
    rows = []
    for i in range(70):
        words = list(base)
        for _ in range(rng.randrange(4, 9)):
            words[rng.randrange(150)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = documents(spark, [(i, t, None, None, 0, "", "", "") for i, t in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in link_classes(docs, 3, 0.8).collect()}
    assert got == linked(rows, 3, 80)


def test_crowded_buckets(spark):
    counts = np.ones(1 << 18, np.int64) * 10
    counts[777] = 500
    rows = [(i, x.tobytes()) for _ in range(3) for i, x in enumerate(np.split(counts, 64))]
    bits = crowded_buckets(spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "slice int, counts binary"))
    assert np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist() == [777]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(10, 60)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (3, 2), (2, 3), (3, 1), (-5, 300), (300, 301)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 10 for i in range(10, 61)} | {100: 100} | {200 + i: 100 for i in range(50)} | {1: 1, 2: 1, 3: 1, -5: -5, 300: -5, 301: -5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def targets_by_hand(sizes, weights=(5, 2, 1), cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, fixed = {}, {s for s in names if sizes[s] == 0}
    left = float(sum(sizes.values()))
    while True:
        open_ = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        target |= share
        if not over:
            return {s: target.get(s, 0.0) if sizes[s] else 0.0 for s in names}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            fixed.add(s)
            share.pop(s)


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 500, "c": 90, "d": 1, None: 40}, {"a": 5, "é": 3, "z": 900, "B": 70}, {"x": 0, "y": 4}])
def test_targets_by_hand(spark, sizes):
    units = spark.createDataFrame([(s is None, s or "", v) for s, v in sizes.items()], "nosource boolean, src string, words long")
    got = {None if r.nosource else r.src: r.target for r in source_targets(units, (5, 2, 1), 3.0).collect()}
    assert got == pytest.approx(targets_by_hand(sizes))


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    rng = random.Random(11)
    rows = [(i, " ".join("w" * (1 + i % 3) for _ in range(int(min(rng.paretovariate(1.2) * 5, 200)))), None, rng.choice(["a", "a", "a", "b", "c", "d", None]), 0, "", "", "") for i in range(3000)]
    docs = documents(spark, rows)
    plan = plan_mix(docs).cache()
    assert plan.count() == 3000
    sums = plan.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size"), F.max("copies").alias("most"))
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1]))
    targets = targets_by_hand(sizes)
    for r in sums.collect():
        assert r["size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]]) and r["most"] <= 3
        assert abs(r["taken"] - r["target"]) <= 0.02 * r["target"]
    first = sorted(((r.doc_id, r.copies) for r in plan.collect()))
    again = sorted(((r.doc_id, r.copies) for r in plan_mix(docs.repartition(7)).collect()))
    assert first == again
    assert first != sorted(((r.doc_id, r.copies) for r in plan_mix(docs, seed=5).collect()))
    ratio = targets["b"] / sizes["b"]
    copies = dict(first)
    assert {copies[r[0]] for r in rows if r[3] == "b" and r[1]} <= {int(ratio), int(ratio) + 1}
    mixed = mix_sources(docs)
    assert mixed.columns == docs.columns
    assert sorted(r.doc_id for r in mixed.select("doc_id").collect()) == sorted(i for i, c in first for _ in range(c))


def test_mix_keeps_expectations(spark):
    """Over many seeds, each document's mean copies come near target / size."""
    rows = [(i, " ".join(["w"] * (3 + 7 * i)), None, "ab"[i % 2], 0, "", "", "") for i in range(8)]
    docs = documents(spark, rows)
    total = {}
    for seed in range(12):
        for r in plan_mix(docs, seed=seed).collect():
            total.setdefault(r.source, []).append(r.copies)
    sizes = {"a": sum(3 + 7 * i for i in range(0, 8, 2)), "b": sum(3 + 7 * i for i in range(1, 8, 2))}
    want = targets_by_hand(sizes)
    for s in "ab":
        assert abs(np.mean(total[s]) - want[s] / sizes[s]) < 0.25


def test_mix_of_odd_rows(spark):
    docs = documents(spark)
    plan = plan_documents(docs).collect()
    assert len(plan) == len({(r[0], r[1], r[3]) for r in odd_rows()})
    assert {r.n_rows for r in plan if r.doc_id == 9} == {2} and all(r.copies <= 3 * r.n_rows for r in plan)
    assert {r.size for r in plan if r.doc_id in (1, 2, 3)} == {0}
    rows = plan_mix(docs).collect()
    assert sorted((r.doc_id for r in rows), key=repr) == sorted((r[0] for r in odd_rows()), key=repr) and max(r.copies for r in rows) <= 3
    assert all(sum(r.copies for r in rows if r.doc_id == p.doc_id and r.text_key == p.text_key and r.source == p.source) == p.copies for p in plan)
    mixed = mix_sources(docs)
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: c for i in {r.doc_id for r in plan} if (c := sum(r.copies for r in plan if r.doc_id == i))}
    assert plan_mix(documents(spark, [])).count() == 0 and mix_sources(documents(spark, [])).count() == 0


def test_mix_deals_the_copies_of_a_document_to_its_rows(spark):
    """A document of 10 000 equal rows among others: a row for each, two numbers of copies, one apart."""
    rows = [(7, "one two three four", None, "a", 0, "", "", "")] * 10_000 + [(8 + i, "w " * (1 + i), None, "b", 0, "", "", "") for i in range(50)]
    docs = documents(spark, rows)
    found = plan_mix(docs).groupBy("doc_id", "copies").count().collect()
    hot = {r.copies: r["count"] for r in found if r.doc_id == 7}
    assert sum(hot.values()) == 10_000 and max(hot) - min(hot) <= 1 and max(hot) <= 3
    (plan,) = plan_documents(docs).filter("doc_id = 7").collect()
    assert sum(c * n for c, n in hot.items()) == plan.copies
    assert sum(r["count"] for r in found) == len(rows) and all(r.copies <= 3 for r in found)


def test_lone_sets_and_copies_move_no_signatures(spark, monkeypatch):
    """Signatures travel for sets that may link, and once for all copies of a text, whatever tasks these lie in."""
    from pathfold.llm import ngram_join

    rng = random.Random(17)
    rows = [(i, fresh(rng, 120)) for i in range(150)]
    twin = rows[3][1].split()
    twin[60] = "other"
    rows += [(500, " ".join(twin))] + [(600 + i, rows[7][1]) for i in range(40)]
    docs = documents(spark, [(i, t, None, None, 0, "", "", "") for i, t in rows]).repartition(8)
    seen, real = [], ngram_join.candidate_edges
    monkeypatch.setattr(ngram_join, "candidate_edges", lambda marks: seen.append(marks.count()) or real(marks))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in link_classes(docs, 5, 0.8).collect()}
    assert got == linked(rows, 5, 80) and got[500][1] == 3 and got[620][1] == 7
    assert 0 < seen[0] < 150  # of some 150 sets with 30 signatures or more each


def test_packs_tell_what_occurs_again():
    from collections import Counter

    import pyarrow as pa
    import pyarrow.compute as pc

    from pathfold.llm.ngram_join import heads_again, packs

    rng = np.random.default_rng(5)
    heads = rng.integers(0, 1 << 44, 5000, dtype=np.uint64)
    ends = np.array([0, 0, (1 << 44) - 1, (1 << 44) - 1, 1 << 32, (1 << 32) - 1, (1 << 32) - 1], np.uint64)
    heads = np.concatenate([heads, heads[:70], heads[:5], ends])
    rng.shuffle(heads)
    table = pa.concat_tables([pa.Table.from_batches([packs(x)]) for x in np.array_split(heads, 3)])
    got = [h for p in set(table["pack"].to_pylist()) for h in heads_again(table.filter(pc.equal(table["pack"], p)))["head"].to_pylist()]
    assert sorted(got) == sorted(k for k, n in Counter(heads.tolist()).items() if n > 1)


def test_tiles_are_multiplied_in_runs(monkeypatch):
    from pathfold.llm import ngram_join

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) > 0.1], rng.integers(0, 1 << 60, int(rng.integers(0, 6)), dtype=np.uint64)])) for _ in range(40)]
    want = product_links(sets, 0.8)
    side = (np.arange(40) % 3 == 0).astype(np.int8)
    across = product_links(sets, 0.8, side)
    monkeypatch.setattr(ngram_join, "PRODUCT_ROWS", 7)

    def forest(links):
        parent = list(range(40))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, j in links:
            parent[max(find(i), find(j))] = min(find(i), find(j))
        return [find(i) for i in range(40)]

    assert forest(ngram_join.tile_links(sets, 0.8, None)) == forest(want)
    assert forest(ngram_join.tile_links(sets, 0.8, side)) == forest(across)
