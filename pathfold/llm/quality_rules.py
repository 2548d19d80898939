"""Quality rules whose cutoffs are certified on labelled documents.

Each rule measures one quantity of a text (:data:`RULES`) and rejects values from a cutoff up. For
every stratum and rule the cutoffs are tested from the laxest down, on the documents labelled good:
the hypothesis "this cutoff rejects more than its share of good documents" is dropped when a
binomial count as small as the observed one has an exact probability of at most the test's level.
Testing in this fixed order stops at the first cutoff that is not certified, which needs no
correction for the number of cutoffs; rules and strata share the level by Bonferroni. With
probability 1 - ``delta`` no stratum loses more than ``alpha`` of its good documents to the rules.
Of the certified cutoffs the one is used that rejects most bad documents, a rejected good one
counting ``GOOD_COST`` times.

Counts by (stratum, rule, bin) give each stratum with labels its own cutoffs in a grouped job, and
documents get theirs by a join, so strata may be any number; only that number goes to the driver.
"""

from __future__ import annotations

from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathfold.llm.batches import Texts, add_columns, mix, unused
from pathfold.session import cut_lineage, stored

BINS = 200
GOOD_COST = 20
# Rule -> width of a bin; the value of bin b is from b to b + 1 widths, the last bin is open.
RULES = {
    "symbols_per_word": 0.02,
    "duplicate_line_share": 0.01,
    "repeated_word_share": 0.01,
    "upper_share": 0.01,
    "chars_per_word": 0.25,
    "punctuation_share": 0.01,
}
WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags in each document."""
    below = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=below[1:])
    return below[offsets[1:]] - below[offsets[:-1]]


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and all lines with a word."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines)), len(lines)


def repeated_words(block: Texts, words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Words of each document that lie in a window of ``WINDOW`` words found twice or more in it."""
    total = len(words)
    covered = np.zeros(total + 1, np.int64)
    if total >= WINDOW:
        with np.errstate(over="ignore"):
            last = total - WINDOW + 1
            window = np.zeros(last, np.uint64)
            for j in range(WINDOW):
                window += mix(words[j : j + last] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            # The document's number makes equal windows of two documents differ.
            window = mix(window + doc[:last].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        inside = np.flatnonzero(doc[WINDOW - 1 :] == doc[:last])
        window = window[inside]
        order = np.argsort(window)
        same = window[order[1:]] == window[order[:-1]]
        twice = np.zeros(len(window), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        starts = inside[twice]
        covered[starts] += 1
        covered[starts + WINDOW] -= 1
    return per_doc(np.cumsum(covered)[:total] > 0, block.first)


def measure(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of each text, and its bins, a column for each rule."""
    block = Texts(texts)
    block.spans()
    words = block.word_hashes(lower=False)
    doc = block.doc_of_words()
    raw = block.bytes
    heads = (raw & 0xC0) != 0x80
    in_word = np.ones(len(raw), bool)
    in_word[(raw == 32) | ((raw >= 9) & (raw <= 13))] = False
    dup, lines = np.array([duplicate_lines(block.text(i)) for i in range(block.n)], np.int64).reshape(block.n, 2).T
    n = block.counts()
    m = {
        "n_words": n,
        "word_chars": per_doc(heads & in_word, block.offsets),
        "n_symbols": per_doc(SYMBOLS[raw], block.offsets),
        "n_dup_lines": dup,
        "n_repeat_words": repeated_words(block, words, doc),
    }
    m["base_failed"] = (n < 20) | (100 * m["n_repeat_words"] > 30 * n)
    some, chars = np.maximum(n, 1), np.maximum(m["word_chars"], 1)
    values = (
        m["n_symbols"] / some,
        dup / np.maximum(lines, 1),
        m["n_repeat_words"] / some,
        per_doc(UPPER[raw], block.offsets) / chars,
        m["word_chars"] / some,
        per_doc(PUNCTUATION[raw], block.offsets) / chars,
    )
    bins = np.stack([np.minimum(np.floor(v / w + 1e-9), BINS - 1) for v, w in zip(values, RULES.values())], axis=1)
    return m, bins.astype(np.int32)


def arrays(m: dict[str, np.ndarray]) -> list[pa.Array]:
    return [pa.array(v, pa.bool_() if k == "base_failed" else pa.int64()) for k, v in m.items()]


def binomial_below(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial count, exact but for rounding."""
    if k >= n:
        return 1.0
    return min(1.0, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * log(p) + (n - j) * log1p(-p)) for j in range(k + 1)))


def choose_cutoff(good: np.ndarray, bad: np.ndarray, share: float, level: float) -> int:
    """The bin from which to reject, or ``BINS`` for none, from counts by bin."""
    n = int(good.sum())
    best, cutoff = 0, BINS
    lost = caught = 0
    for b in range(BINS - 1, 0, -1):
        lost += int(good[b])
        caught += int(bad[b])
        if binomial_below(lost, n, share) > level:
            break
        gain = caught - GOOD_COST * lost
        if gain > best:
            best, cutoff = gain, b
    return cutoff


def stratum_of(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def certify(docs: DataFrame, labels: DataFrame, stratum: str, alpha: float, delta: float) -> DataFrame:
    """(stratum, cutoffs), a row for each stratum with labels, from all labelled documents."""

    def make():
        return lambda texts: [pa.FixedSizeListArray.from_arrays(pa.array(measure(texts)[1].ravel()), len(RULES)).cast(pa.list_(pa.int32()))]

    bins = add_columns(docs.select("doc_id", stratum_of(stratum).alias("stratum"), "text"), make, "bins array<int>", ["text"], ["doc_id", "stratum"])
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # Documents without a label drop out before anything else is done with them.
    counts = (
        bins.join(marks, "doc_id")
        .select("stratum", "quality", F.posexplode("bins").alias("rule", "bin"))
        .groupBy("stratum", "rule", "bin")
        .agg(F.sum(F.when(F.col("quality") >= 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") < 1, 1).otherwise(0)).alias("bad"))
    )
    counts = cut_lineage(counts)
    tests = max(1, counts.select("stratum").distinct().count()) * len(RULES)

    def choose(table: pa.Table) -> pa.Table:
        by_bin = np.zeros((len(RULES), 2, BINS), np.int64)
        rule, at = table["rule"].to_numpy(), table["bin"].to_numpy()
        by_bin[rule, 0, at], by_bin[rule, 1, at] = table["good"].to_numpy(), table["bad"].to_numpy()
        cutoffs = [choose_cutoff(good, bad, alpha / len(RULES), delta / tests) for good, bad in by_bin]
        return pa.table([table["stratum"].slice(0, 1), pa.array([cutoffs], pa.list_(pa.int32()))], names=["stratum", "cutoffs"])

    return stored(counts.groupBy("stratum").applyInArrow(choose, "stratum string, cutoffs array<int>"))


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    alpha: float = 0.05,
    delta: float = 0.05,
    stratum: str = "lang",
    keep: list[str] | None = None,
) -> DataFrame:
    """Add the measures of :data:`MEASURES` and ``kept``.

    ``kept`` is false if the base rule fails (fewer than 20 words, or more than 30 % of the words in
    repeated windows) or if a certified rule rejects. ``labels`` has doc_id and quality (0 or 1); of
    several labels of a document the lowest counts, null ones do not.

    Null and empty texts have no words and fail the base rule. A null stratum counts as the empty
    one. Strata without enough labels reject nothing beyond the base rule, as do missing labels.
    Equal rows are judged alike; an empty table gives an empty table. Input columns with the added
    names are replaced.
    """
    name, cutoffs = unused(docs.columns, "stratum", "cutoffs")
    certified = certify(docs, labels, stratum, alpha, delta).toDF(name, cutoffs)
    judged = docs.join(certified, stratum_of(stratum) == F.col(name), "left")
    none = [BINS] * len(RULES)

    def make():
        def compute(texts, limits):
            m, bins = measure(texts)
            limits = np.array([x or none for x in limits.to_pylist()], np.int32)
            rejected = (bins >= limits.reshape(len(bins), len(RULES))).any(axis=1)
            return [*arrays(m), pa.array(~(m["base_failed"] | rejected), pa.bool_())]

        return compute

    return add_columns(judged, make, MEASURES + ", kept boolean", ["text", cutoffs], docs.columns if keep is None else keep)
