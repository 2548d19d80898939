import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from pathfold.llm import piece_codec
from pathfold.llm.batches import Texts
from pathfold.llm.line_dedup import PerfectHash, dedup_lines
from pathfold.llm.piece_codec import apply_edits, decode, decode_block, decode_ids, encode, n_best
from pathfold.llm.pieces import Segments, load
from pathfold.llm.token_counts import SegmentCounts, count_tokens

from .helpers import WORD, documents, odd_rows, prose

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BLANK = " \t\n\x0b\x0c\r"


def lines_by_hand(rows, least=20, docs=3):
    keys = {}
    for n, (i, text) in enumerate(rows):
        for line in {x.strip(BLANK).translate({c: c + 32 for c in range(65, 91)}) for x in (text or "").split("\n")}:
            keys.setdefault(line, []).append(-(1 << 63) if i is None else i)
    out = []
    for i, text in rows:
        key = -(1 << 63) if i is None else i
        lines = (text or "").split("\n")
        kept = []
        for x in lines:
            held = keys[x.strip(BLANK).translate({c: c + 32 for c in range(65, 91)})]
            code_points = len(x.strip(BLANK))
            if not (code_points >= least and len(held) >= docs and max(held) != key):
                kept.append(x)
        out.append((i, text if len(kept) == len(lines) else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_words_are_those_of_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é日\t\n\x0b \x1f\x85\xa0") for _ in range(rng.randrange(60))) for _ in range(300)] + ["", "a" * 200_000 + " b"]
    block = Texts(pa.array(texts))
    block.spans()
    hashes = block.word_hashes(lower=False)
    words = [w for t in texts for w in WORD.findall(t)]
    assert block.counts().tolist() == [len(WORD.findall(t)) for t in texts]
    by_word = {}
    for w, h in zip(words, hashes.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_perfect_hash_is_minimal_and_survives_storage():
    keys = np.random.default_rng(3).integers(0, 1 << 63, 5000, dtype=np.uint64)
    built = PerfectHash.build(keys)
    again = PerfectHash.load(*built.dump())
    assert sorted(again.index(keys).tolist()) == list(range(len(keys)))
    assert PerfectHash.build(np.empty(0, np.uint64)).size == 0
    # Keys that no level separates go to the sorted rest.
    rest = PerfectHash(levels=[], rest=np.sort(keys[:9]))
    assert sorted(rest.index(keys[:9]).tolist()) == list(range(9))


def test_line_dedup_by_hand(spark):
    docs = documents(spark)
    out = dedup_lines(docs)
    assert out.columns.count("n_lines") == 1 and set(docs.columns) < set(out.columns)
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=repr)
    assert got == sorted(lines_by_hand([(r[0], r[1]) for r in odd_rows()]), key=repr)
    assert any(r[3] for r in got)
    assert dedup_lines(documents(spark, [])).count() == 0


def test_one_line_in_most_documents(spark):
    """A key above the hot bound is answered by the broadcast part, others by the shards."""
    rows = [(i, f"the line that is everywhere in this table\nown line of document number {i}\npair line of documents {i // 3} and next", None, None, 0, "", "", "") for i in range(300)]
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in dedup_lines(documents(spark, rows)).collect()}
    want = {i: (a, b) for i, _, a, b in lines_by_hand([(r[0], r[1]) for r in rows])}
    assert got == want and sum(b for _, b in got.values()) == 299 + 200


@pytest.fixture(scope="module")
def pieces():
    return load(MODEL)


def test_counts_are_the_librarys(pieces):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(2)
    texts = [r[1] or "" for r in odd_rows()] + ["".join(rng.choice("aeinrst E.,'2²½_▁\n\t 日é<s>") for _ in range(rng.randrange(80))) for _ in range(400)]
    texts += ["<s> </s> <unk> <0x0A>", "  a  b  ", "\n\n", "▁▁", "don't 3.14 ².", "é ०१ ª"]
    counts = SegmentCounts(pieces)
    cut = Segments(pa.array(texts), pieces)
    for text, a, b in zip(texts, cut.first[:-1], cut.first[1:]):
        segments = [cut.distinct[i] for i in cut.index[a:b]]
        assert "".join(segments) == ("▁" + text.replace(" ", "▁") if text else "")
        assert sum(counts[s] for s in segments) == len(model.encode(text)), text


def test_count_tokens_rows(spark):
    out = count_tokens(documents(spark).withColumnRenamed("kept", "over_limit"), MODEL, limit=100)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in out.collect():
        text = r.text or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(model.encode(text))) and r.over_limit == (r.n_tokens > 100)
    assert count_tokens(documents(spark, []), MODEL).count() == 0


def all_paths(text, pieces):
    out = []

    def go(at, score, ids):
        if at == len(text):
            out.append((score, ids))
            return
        if text[at] not in pieces.ids:
            go(at + 1, score + pieces.lowest - piece_codec.UNKNOWN_PENALTY, ids + [pieces.byte_ids[b] for b in text[at].encode()])
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in pieces.ids:
                go(end, score + pieces.scores[text[at:end]], ids + [pieces.ids[text[at:end]]])

    go(0, 0.0, [])
    return sorted(out, key=lambda p: -p[0])


def test_n_best_against_all_paths(pieces):
    for text in ["▁hello", "▁▁the", "ation", "é日x\u0000", "▁thanred", "\n", "▁"]:
        paths, found = all_paths(text, pieces), n_best(text, pieces, 7)
        assert [s for s, _ in found] == [s for s, _ in paths[:7]]
        assert all(p in paths for p in found) and len({tuple(i) for _, i in found}) == len(found)


def test_decoding_of_any_ids(pieces):
    rng = random.Random(5)
    ids = [[rng.randrange(32000) for _ in range(rng.randrange(9))] for _ in range(500)] + [[28705], [1, 28705, 28705], [232, 131], []]
    assert decode_block(pa.array([*ids, None], pa.list_(pa.int32())), pieces).to_pylist() == [*(decode_ids(x, pieces.raw) for x in ids), None]
    assert decode_ids([], pieces.raw) == ""


def test_full_table_keeps_what_is_used(pieces):
    table = piece_codec.SegmentTable(pieces, 3, cache=8)
    words = [f"▁word{i}" for i in range(12)]
    rows = np.array([table[w] for w in words])
    table.settle()
    table.uses[rows[5:8]] += 4
    before = {w: (table.ids[table.start[table[w]] :][: table.count[table[w]]].tolist(), table.score[table[w]]) for w in words}
    table.shrink()
    assert sorted(table) == sorted(words[5:8])
    for w in words:
        row = table[w]
        table.settle()
        assert (table.ids[table.start[row] :][: table.count[row]].tolist(), table.score[row]) == before[w]


def test_encode_text_n_best_and_decode(spark, pieces):
    rng = random.Random(4)
    short = ["a the", "re st", "", "on\nin", "x日"] + [prose(rng, 3) for _ in range(5)]
    rows = [(i, t, "en", "a", 0, "", "old", "") for i, t in enumerate(short)]
    out = encode(documents(spark, rows), MODEL, n=5)
    for r in out.collect():
        marked = "▁" + r.text.replace(" ", "▁") if r.text else ""
        paths = all_paths(marked, pieces)
        got = [(r.score, list(r.ids)), *((x.score, apply_edits(r.ids, x.edits)) for x in r.next_best)]
        assert [s for s, _ in got] == pytest.approx([s for s, _ in paths[:5]])
        assert all(any(ids == p for _, p in paths) for _, ids in got) and len({tuple(i) for _, i in got}) == len(got)
        assert [x.n_pieces for x in r.next_best] == [len(ids) for _, ids in got[1:]] and r.n_pieces == len(r.ids)
    odd = documents(spark)
    back = decode(encode(odd, MODEL, decoded=True, cache=10).withColumnRenamed("decoded", "first"), MODEL)
    for r in back.collect():
        assert r.decoded == r.first == (r.text or "").replace("▁", " ")
    assert encode(documents(spark, []), MODEL).count() == 0


def test_long_and_rare_segments_leave_the_table(spark):
    """A long run of letters is encoded whole and not kept; lines of rare segments keep the table small."""
    import base64
    import random

    import public_tokenizers

    from pathfold.llm import piece_codec as pc
    from pathfold.llm.pieces import load

    rng = random.Random(9)
    pieces = load(public_tokenizers.path("piece_bpe_32k.model"))
    for text in ["▁" + "".join(rng.choices("abcdefghij", k=n)) for n in (1, 2, 5, 30, 300)] + ["▁aaaa", "▁日é", ""]:
        found = pc.n_best(text, pieces, 2)
        score, ids, loss = pc.best_path(text, pieces)
        assert ids == found[0][1] and score == found[0][0]
        assert len(found) == 1 and loss == float("inf") or abs(loss - (found[0][0] - found[1][0])) < 1e-9
    run = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=100_000))
    lines = [base64.b64encode(rng.randbytes(600)).decode() for _ in range(40)]
    docs = spark.createDataFrame([(1, run), (2, "\n".join(lines)), (3, run)], "doc_id long, text string").coalesce(1)
    out = {r.doc_id: r for r in pc.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=True, cache=50).collect()}
    assert out[1].decoded == run and out[1].ids == out[3].ids and out[2].decoded == "\n".join(lines)
    assert len(out[1].next_best) == 3 and out[1].next_best == out[3].next_best
    table = pc.SegmentTable(pieces, 4, 50)
    for s in ["▁" + line for line in lines] + ["▁a"] * 3:
        table[s]
        table.settle()
    table.uses[:] = 5
    table.shrink()
    assert set(table) == {"▁a"} and len(table.ids) < 3 and table.rows == 1
