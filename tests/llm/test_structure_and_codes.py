import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from pathfold.llm import structure_repair as sr
from pathfold.llm import vector_codes as vc
from pathfold.llm.oracles import REPAIR, vector_codes
from pathfold.llm.queries import op11_structure_repair, op13_vector_codes

SHAPE = re.compile(r"(s?(ua)+)?")
BLANK = " \t\n\x0b\f\r"


def by_trial(symbols: str) -> tuple[int, str]:
    """All strings of edits with up to two inserts before each row and at the end."""
    best = None
    choices = ["D" if s == "x" else "DKR" for s in symbols]
    for edits in itertools.product(*choices):
        for inserts in itertools.product(range(3), repeat=len(symbols) + 1):
            cost = 5 * sum(inserts)
            audit = "".join("I" * n + e for n, e in zip(inserts, (*edits, "")))
            shape = []
            for n, edit, symbol in itertools.zip_longest(inserts, edits, symbols):
                shape += ["ua"] * n
                if edit is None:
                    continue
                cost += {"D": 2, "K": 0, "R": 1}[edit] + (5 if edit != "D" and symbol.isupper() else 0)
                shape += {"D": [], "K": [symbol.lower()], "R": ["ua"]}[edit]
            if (best is None or (cost, audit) < best) and any(SHAPE.fullmatch("".join(p)) for p in itertools.product(*shape)):
                best = (cost, audit)
    return best


@pytest.mark.parametrize("length", range(4))
def test_cells_against_all_edits(length):
    memo = {}
    for symbols in itertools.product("xuasoUAS", repeat=length):
        text = "".join(symbols)
        cost, path = sr.whole_parse([sr.span_cell(text, memo)])
        assert (cost, path[0][1]) == by_trial(text), text


def front_parse(symbols: str) -> tuple[int, str]:
    """Row by row, without spans."""
    front = {0: (0, "")}
    for cell in map(sr.row_cell, symbols):
        step = {}
        for (p, q), found in zip(sr.PAIRS, cell):
            if found and p in front:
                option = (front[p][0] + found[0], front[p][1] + found[1])
                step[q] = min(step.get(q, option), option)
        front = step
    return min(front[q] for q in (0, 3) if q in front)


def test_long_spans_are_their_parts():
    rng = random.Random(3)
    for n in (5, 15, 16, 17, 100, 700):
        text = "".join(rng.choice("xuasoUASOuaua") for _ in range(n))
        whole = sr.whole_parse([sr.span_cell(text, {})])
        cuts = sorted(rng.randrange(n + 1) for _ in range(3))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, n])]
        cost, path = sr.whole_parse([sr.span_cell(p, {}) for p in parts])
        assert (cost, "".join(a for _, a in path)) == (whole[0], whole[1][0][1]) == front_parse(text)


def turns_by_hand(rows):
    """conv_id -> the contract's values, after the damage."""
    told = defaultdict(list)
    for conv, turn, role, text in rows:
        told[conv]
        role, text = (" " if v is None else v for v in (role, text))
        part = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        if part == 0:
            continue
        text = "" if part == 1 else re.sub("[.!?]", "", text) if part == 2 else text
        told[conv] += [(turn, "user" if part == 4 else role, text)] * (2 if part == 3 else 1)
    out = {}
    for conv, given in told.items():
        given.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, symbols, counts = set(), "", [0, 0, 0]
        for _, role, text in given:
            body = text.rstrip(BLANK)
            kind = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else 3
            seen.add((role, text))
            name = role[:1] if role[:1] in ("u", "a", "s") else "o"
            symbols += "x" if kind < 2 else name.upper() if kind == 2 else name
            if kind < 3:
                counts[kind] += 1
        numbers = {t for t, _, _ in given if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(given, given[1:]))
        cost, audit = front_parse(symbols)
        lines, at, state = [], 0, 0
        for edit in audit:
            _, role, text = given[at] if edit != "I" else (0, "", "")
            at += edit != "I"
            if edit != "D":
                role = role if edit == "K" else "assistant" if state == 2 else "user"
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
                lines.append(f"{role}:{text}")
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def odd_turns():
    rng = random.Random(8)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "Üser", None])
            text = rng.choice(["Fine.", "Fine.", "Cut", "Why? ", "", " \n\t", None, "Ends\r\n", "日本。", f"No. {rng.random()}!", "\x00."])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn * 3]), role, text))
    rows += [(50, t, ("user", "assistant")[t % 2], f"Turn {t}" + ".!"[t % 2] * (t % 7 > 0)) for t in range(1300)]  # several blocks
    rows += [(51, 4, "user", "Same.")] * 1500 + [(51, 5, "assistant", "Yes.")] * 3  # one row, many times
    rows += [(52, None, "user", f"{i}.") for i in range(700)]  # many rows of one turn
    rows += [(53, 1, "user", "long " * 60_000 + "."), (53, 2, "assistant", ".")]
    rng.shuffle(rows)
    return rows


def conversations(spark, rows):
    extra = "c string, head string, symbols string, place int"
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], f"conv_id long, turn long, role string, text string, {extra}")


def test_repair_by_hand_and_sql(spark, tmp_path):
    rows = odd_turns()
    table = conversations(spark, rows)
    table.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op11_structure_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = {r[0]: tuple(r[1:]) for r in got.collect()}
    want = turns_by_hand([r for r in rows])
    empty = hashlib.sha256(b"").hexdigest()
    assert found == {c: v if v[6] or v[5] else (*v[:7], empty) for c, v in want.items()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet' WHERE conv_id IS NULL OR conv_id < 50 OR conv_id = 53")
    told = {r[0]: tuple(r[1:]) for r in con.execute(REPAIR).fetchall()}
    assert told == {c: v for c, v in found.items() if c not in (50, 51, 52)}


def test_repaired_rows_read_well(spark):
    report, rows = sr.repair(conversations(spark, odd_turns()))
    by_conv = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: r.place):
        by_conv[r.conv_id].append(r)
    for conv, told in by_conv.items():
        assert [r.place for r in told] == list(range(len(told)))
        assert SHAPE.fullmatch("".join(r.role[0] for r in told))
        assert all(r.text == "" for r in told if r.edit == "I")
    assert report.count() == 45
    none = conversations(spark, [])
    assert [d.count() for d in sr.repair(none)] == [0, 0] and sr.damaged(none).count() == 0


def nearest_by_hand(part, book):
    return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))


def codes_by_hand(rows):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 4)
    ints = [[math.floor(1024 * x) for x in v] + [0] * (4 * width - len(v)) for _, v, _ in kept]
    parts = [[v[p * width : (p + 1) * width] for p in range(4)] for v in ints]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:256]
    books = [[parts[k][p] for k in order] for p in range(4)]
    for step in range(5):
        near = [[nearest_by_hand(x[p], books[p]) for p in range(4)] for x in parts]
        if step == 4:
            break
        for p in range(4):
            for e in range(len(books[p])):
                mine = [x[p] for x, n in zip(parts, near) if n[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    return [(k[0], "".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n)) for k, n in zip(kept, near)], books


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, `__vector` string, code string")


def test_transform_keeps_scaled_distances():
    rng = np.random.default_rng(1)
    for w in (1, 3, 5, 8, 16):
        a, b = rng.integers(-900, 900, (2, 30, w))
        gap = vc.walsh(a) - vc.walsh(b)
        assert ((gap * gap).sum(1) == ((a - b) ** 2).sum(1) * gap.shape[1]).all()
    signs = vc.walsh(np.eye(16, dtype=np.int64)).T  # a row for each coefficient
    assert [int((r[1:] != r[:-1]).sum()) for r in signs] == list(range(16))


@pytest.mark.parametrize("kind", [np.int64, object])
def test_elimination_finds_the_nearest(kind):
    rng = np.random.default_rng(2)
    book = rng.integers(-9, 9, (256, 16))
    book[7] = book[3]
    parts = np.concatenate([book[rng.integers(0, 256, 200)] + rng.integers(-2, 3, (200, 16)), book[:9]])
    index, far, saved = vc.nearest(parts.astype(kind), book.astype(kind))
    want = [nearest_by_hand(p.tolist(), book.tolist()) for p in parts]
    assert list(zip(far.tolist(), index.tolist())) == want and index[-2] == 3
    assert saved > 209 * 256 * 12 // 2  # more than half of what the later coefficients take


def test_codes_by_hand_and_sql(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i * 3 % 700, rng.normal(size=12).astype("float32").tolist(), int(rng.integers(0, 3))) for i in range(330)]
    rows += [rows[4]] * 3 + [(5, [0.5] * 12, None), (None, [0.25] * 12, None), (2, None, 1), (9, [float("nan")] * 12, 1)]
    rows += [(11, [None] + [1.0] * 11, 1), (12, [float("-inf")] * 12, 2), (13, [-0.0] * 12, 2)]
    table = vectors(spark, rows)
    table.repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = op13_vector_codes(spark, str(tmp_path))
    got = sorted(out.collect(), key=repr)
    want, books = codes_by_hand(rows)
    assert sorted(((r.vec_id, r.code, r.error) for r in got), key=repr) == sorted(want, key=repr)
    assert {r.codebooks_sha256 for r in got} == {vc.codebooks_sha256(books)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(con.execute(vector_codes()).fetchall(), key=repr) == sorted(map(tuple, got), key=repr)


def test_codes_of_odd_vectors(spark):
    rows = [(1, [], 1), (2, [1.0], 1), (3, [1.0, 2.0, 3.0, 4.0, 5.0], None), (3, [3e38, -3e38], None), (4, [2.0**41] * 5, 2)]
    table = vectors(spark, rows)
    books, width = vc.fit_codebooks(table)
    coded = vc.encode_vectors(table, books, width)
    assert coded.columns == ["vec_id", "embedding", "label", "__vector", "code", "error"] and coded.count() == 5
    assert {r.error for r in coded.collect()} == {0}  # five vectors, five entries
    assert vc.label_errors(coded).filter("label_error = 0").count() == 5
    far = [[[0] * width for _ in range(2)] for _ in range(4)]
    assert max(r.error for r in vc.encode_vectors(table, far, width).collect()) == vc.LONGEST
    none = vectors(spark, [])
    books, width = vc.fit_codebooks(none)
    assert (books, width) == ([[], [], [], []], 0) and vc.encode_vectors(none, books, width).count() == 0
    blank = vectors(spark, [(1, [], 1), (1, [], None)])
    assert [r.code for r in vc.encode_vectors(blank, *vc.fit_codebooks(blank)).collect()] == ["00000000"] * 2
