"""Language identification by interpolated Kneser-Ney character models.

A text is its words, runs of letters in lower case, each predicted character by character up to
its end from the three characters before; words start from blank context. So a word has a fixed
log probability in each language, and a block scores each of its distinct words once.

Training counts come from a sample of labelled documents, bounded for each language
(:class:`Training`); every labelled language is learned. A model is a sorted array of n-gram hashes
for each order with a matrix of interpolated log probabilities, a column a language, and the like
for the weights that contexts give to the shorter order. A model holds up to :data:`GROUP` languages
and all models share one alphabet, so memory grows with the languages and not with their square.

The score is the probability of the best language after tempering; the temperature and the limits
of rejection come from other labelled documents than the counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathfold.llm.batches import add_columns, expand, lists, mix, span_hashes

START, END, OTHER = 1, 2, 3  # marks; characters beyond 16 bits fold into OTHER
GROUP = 32  # languages a model
TEMPERS = np.geomspace(0.01, 100, 41)
_letters: np.ndarray | None = None


@dataclass(frozen=True)
class Training:
    """Bounds of the sample that is fitted on: expected documents a language, and the longest text.

    A language all of whose texts are longer is fitted on those.
    """

    documents: int = 1200
    calibration: int = 400
    max_chars: int = 20_000
    accepted_accuracy: float = 0.99
    entropy_quantile: float = 0.999


def letters() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letters


class Words:
    """Distinct words of a block of texts, and which of them each text has."""

    def __init__(self, texts: pa.Array):
        low = [(x or "").lower() for x in texts.to_pylist()]
        points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.zeros(len(low) + 1, np.int64)
        np.cumsum([len(x) for x in low], out=offsets[1:])
        letter = letters()[points] if len(points) else np.empty(0, bool)
        edge = np.zeros(len(points) + 1, bool)
        if len(points):
            edge[1:-1] = letter[1:] != letter[:-1]
            edge[offsets] = True
        starts = np.flatnonzero(edge[:-1] & letter)
        ends = np.flatnonzero(edge[1:] & letter) + 1
        self.points = np.where(points > 0xFFFF, OTHER, points).astype(np.uint16)
        hashes = span_hashes(self.points, CODES, starts, ends)
        _, index, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        self.starts, self.lengths = starts[index], (ends - starts)[index]
        self.first = np.searchsorted(starts, offsets)
        self.n = len(low)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """The 4-grams of each distinct word, 16 bits a character, the last one lowest; word borders."""
        size = self.lengths + 1
        border = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=border[1:])
        place = np.arange(int(border[-1])) - np.repeat(border[:-1], size)  # within the word
        at = np.repeat(self.starts, size) + place
        last = place == np.repeat(self.lengths, size)
        out = np.zeros(len(at), np.uint64)
        for back in range(3, -1, -1):
            inside = np.clip(at - back, 0, max(0, len(self.points) - 1))
            char = self.points[inside].astype(np.uint64) if len(self.points) else np.zeros(0, np.uint64)
            char = np.where(place < back, np.uint64(START), char)
            if back == 0:
                char = np.where(last, np.uint64(END), char)
            out = out << np.uint64(16) | char
        return out, border

    def totals(self, values: np.ndarray) -> np.ndarray:
        """Sum over each text's words of a value (or row) of its distinct words."""
        each = values[self.word]
        below = np.zeros((len(each) + 1, *each.shape[1:]), np.float64)
        np.cumsum(each, axis=0, out=below[1:])
        return below[self.first[1:]] - below[self.first[:-1]]


CODES = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)


def group_sum(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    out = np.zeros((len(found), *values.shape[1:]))
    np.add.at(out, at, values)
    return found, out


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class Model:
    """Sorted hash arrays: for each order the n-grams' log probabilities and contexts' weights."""

    def __init__(self, languages: list[str], grams: np.ndarray, counts: np.ndarray, size: int | None = None):
        """``grams``: distinct 4-grams; ``counts``: their number in each language, a column each.

        ``size``: characters that any language has, and one; by default those of ``grams``.
        """
        self.languages = languages
        self.logp: list[tuple[np.ndarray, np.ndarray]] = []
        self.back: list[tuple[np.ndarray, np.ndarray]] = []
        tables = [(grams, counts)]
        for order in (3, 2, 1):  # continuation counts: distinct characters seen before the n-gram
            above, seen = tables[0]
            tables.insert(0, group_sum(above & np.uint64((1 << 16 * order) - 1), (seen > 0).astype(np.float64)))
        size = size or len(tables[0][0]) + 1
        self.unseen = np.full(len(languages), -np.log(size))
        below = None
        for order, (keys, seen) in enumerate(tables, start=1):
            once, twice = (seen == 1).sum(axis=0), (seen == 2).sum(axis=0)
            cut = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.95)
            context = keys >> np.uint64(16)
            heads, total = group_sum(context, seen)
            _, kinds = group_sum(context, (seen > 0).astype(np.float64))
            weight = np.where(total > 0, cut * kinds / np.maximum(total, 1e-300), 1.0)
            at = np.searchsorted(heads, context)
            lower = np.full_like(seen, 1 / size) if below is None else below[1][np.searchsorted(below[0], keys & np.uint64((1 << 16 * (order - 1)) - 1))]
            p = np.where(total[at] > 0, np.maximum(seen - cut, 0) / np.maximum(total[at], 1), 0) + weight[at] * lower
            below = keys, p
            for out, k, v in ((self.logp, keys, p), (self.back, heads, weight)):
                hashed = mix(k + np.uint64(order))
                sort = np.argsort(hashed)
                out.append((hashed[sort], np.log(np.maximum(v[sort], 1e-12)).astype(np.float32)))

    def score(self, grams: np.ndarray) -> np.ndarray:
        """Log probability of each 4-gram's last character, a column a language."""
        out = np.zeros((len(grams), len(self.languages)))
        left = np.arange(len(grams))
        for order in (4, 3, 2, 1):
            if not len(left):
                return out
            now = grams[left] & np.uint64((1 << 16 * order) - 1)
            keys, values = self.logp[order - 1]
            at, hit = find(keys, mix(now + np.uint64(order)))
            out[left[hit]] += values[at[hit]]
            left, now = left[~hit], now[~hit]
            keys, values = self.back[order - 1]
            at, hit = find(keys, mix((now >> np.uint64(16)) + np.uint64(order)))
            out[left[hit]] += values[at[hit]]
        out[left] += self.unseen
        return out


class Models:
    """Models of up to ``GROUP`` languages each; absent n-grams and zero counts have equal scores."""

    def __init__(self, languages: list[str], lang: np.ndarray, grams: np.ndarray, n: np.ndarray):
        """``n`` of each language index and 4-gram, each pair once."""
        self.languages = languages
        size = len(np.unique(grams & np.uint64(0xFFFF))) + 1
        self.parts = []
        for start in range(0, len(languages), GROUP):
            own = languages[start : start + GROUP]
            rows = np.flatnonzero((lang >= start) & (lang < start + len(own)))
            keys, at = np.unique(grams[rows], return_inverse=True)
            counts = np.zeros((len(keys), len(own)))
            counts[at, lang[rows] - start] = n[rows]
            self.parts.append(Model(own, keys, counts, size))


def text_scores(models: Models, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Total log probability of each text in each language, and its number of predicted characters."""
    words = Words(texts)
    grams, border = words.grams()
    totals = [np.zeros((words.n, 0))]
    for part in models.parts:
        each = part.score(grams)
        below = np.zeros((len(each) + 1, each.shape[1]))
        np.cumsum(each, axis=0, out=below[1:])
        totals.append(words.totals(below[border[1:]] - below[border[:-1]]))
    return np.concatenate(totals, axis=1), words.totals((words.lengths + 1).astype(np.float64))


@dataclass
class Identifier:
    model: Models
    temper: float
    limit: float
    worst: np.ndarray

    def judge(self, texts: pa.Array):
        """(language index or -1, score, length-normalised cross-entropy, rejected) of each text."""
        total, n = text_scores(self.model, texts)
        some = n > 0
        entropy = -total / np.maximum(n, 1)[:, None]
        best = entropy.argmin(axis=1) if total.shape[1] else np.zeros(len(n), np.int64)
        score = tempered(entropy, n, self.temper).max(axis=1) if total.shape[1] else np.zeros(len(n))
        lowest = entropy.min(axis=1) if total.shape[1] else np.zeros(len(n))
        rejected = (score < self.limit) | (lowest > self.worst[best]) if total.shape[1] else np.ones(len(n), bool)
        return np.where(some & (total.shape[1] > 0), best, -1), np.where(some, score, 0.0), lowest, rejected | ~some


def tempered(entropy: np.ndarray, n: np.ndarray, temper: float) -> np.ndarray:
    """Probabilities of the languages: cross-entropies weighed by the root of the length."""
    x = -entropy * np.sqrt(np.maximum(n, 1))[:, None] * temper
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def sample(docs: DataFrame, langs: dict[str, tuple[int, int]], size: int, max_chars: int, salt: int) -> DataFrame:
    """Rows, about ``size`` of each language, chosen by a hash of their doc_id.

    ``langs``: the rows of each language of up to ``max_chars`` characters, and all. A language
    without shorter rows has a sample of the longer ones.
    """
    shares = [(lang, min(1.0, size / max(1, short or n)), not short) for lang, (short, n) in langs.items()]
    table = docs.sparkSession.createDataFrame(shares, "lang string, share double, any_length boolean")
    u = F.shiftrightunsigned(F.xxhash64(F.lit(salt), "doc_id"), 11) / F.lit(float(1 << 53))
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(table), "lang")
    return rows.filter((u < F.col("share")) & (F.col("any_length") | (F.length("text") <= max_chars)))


def train(docs: DataFrame, learn: Column, calibrate: Column, bounds: Training = Training()) -> Identifier:
    """Fit on rows (doc_id, text, lang) where ``learn``; calibrate on rows where ``calibrate``.

    Every language of a row to learn from is fitted. The sample of each is bounded by
    :class:`Training`. Only n-gram counts and a row of figures for each calibrating document reach
    the driver.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    short = F.length("text") <= bounds.max_chars
    ways = {"a": learn & short, "a_all": learn, "b": calibrate & short, "b_all": calibrate}
    counted = known.groupBy("lang").agg(*[F.count_if(x).alias(k) for k, x in ways.items()]).filter("a_all > 0").collect()
    langs = sorted(r["lang"] for r in counted)
    number = {x: i for i, x in enumerate(langs)}

    def make():
        def compute(texts, names):
            out: dict[str, list] = {"lang": [], "gram": [], "n": []}
            names = np.array([number[x] for x in names.to_pylist()])
            for lang in np.unique(names):
                words = Words(texts.take(pa.array(np.flatnonzero(names == lang))))
                grams, border = words.grams()
                times = np.bincount(words.word, minlength=len(words.starts))
                found, n = group_sum(grams, np.repeat(times, np.diff(border)).astype(np.float64))
                out["lang"].append(np.full(len(found), lang))
                out["gram"].append(found.view(np.int64))
                out["n"].append(n)
            return {k: pa.array(np.concatenate(v), pa.int64()) for k, v in out.items()}

        return compute

    picked = sample(known.filter(learn), {r["lang"]: (r["a"], r["a_all"]) for r in counted}, bounds.documents, bounds.max_chars, 1)
    grams = expand(picked, make, "lang long, gram long, n long", ["text", "lang"])
    table = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    model = Models(langs, table["lang"].to_numpy(), table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy())

    def make_scores():
        def compute(texts, names):
            total, n = text_scores(model, texts)
            entropy = -total / np.maximum(n, 1)[:, None]
            truth = np.array([number[x] for x in names.to_pylist()], np.int64)
            row, counts = np.arange(len(n)), np.full(len(n), len(TEMPERS))
            each = [tempered(entropy, n, t) for t in TEMPERS]
            return {
                "lang": pa.array(truth),
                "n": pa.array(n),
                "own": pa.array(entropy[row, truth]),
                "right": pa.array(entropy.argmin(axis=1) == truth),
                "true": lists(np.stack([p[row, truth] for p in each], axis=1).ravel(), counts, pa.float64()),
                "top": lists(np.stack([p.max(axis=1) for p in each], axis=1).ravel(), counts, pa.float64()),
            }

        return compute

    held = sample(known.filter(calibrate), {r["lang"]: (r["b"], r["b_all"]) for r in counted}, bounds.calibration, bounds.max_chars, 2)
    scored = "lang long, n double, own double, right boolean, true array<double>, top array<double>"
    rows = expand(held, make_scores, scored, ["text", "lang"]).filter("n > 0").toArrow()
    worst = np.full(len(langs), np.inf)
    if not len(rows):
        return Identifier(model, 1.0, 0.0, worst)
    own_all = rows["own"].to_numpy()
    truth, right = rows["lang"].to_numpy(), rows["right"].to_numpy()
    true, top = (rows[x].combine_chunks().flatten().to_numpy().reshape(len(rows), -1) for x in ("true", "top"))
    best = min(range(len(TEMPERS)), key=lambda k: -np.log(np.maximum(true[:, k], 1e-12)).mean())
    temper, score = TEMPERS[best], top[:, best]
    # The lowest score from which on the accepted share is as accurate as asked.
    order = np.argsort(-score, kind="stable")
    accuracy = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(accuracy >= bounds.accepted_accuracy)
    limit = float(score[order[good[-1]]]) if len(good) else 1.0
    for k in range(len(langs)):
        own = own_all[truth == k]
        if len(own):
            worst[k] = np.quantile(own, bounds.entropy_quantile)
    return Identifier(model, float(temper), limit, worst)


def identify(docs: DataFrame, identifier: Identifier, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected``.

    The language of the lowest cross-entropy per predicted character over the whole text; of equal
    ones the first by name. ``rejected``: the score, or the fit to any language, is worse than the
    calibration allows; the language is given all the same. Null texts, and texts without a letter,
    are ``und`` with score 0, null cross-entropy, rejected; so are all without any learned language.
    Equal texts have equal results. Input columns with the added names are replaced.
    """

    def make():
        names = [*identifier.model.languages, "und"]

        def compute(texts):
            best, score, entropy, rejected = identifier.judge(texts)
            none = best < 0
            return [
                pa.array([names[i] for i in best.tolist()], pa.string()),
                pa.array(np.where(none, 0.0, score)),
                pa.array(entropy, pa.float64(), mask=none),
                pa.array(rejected | none),
            ]

        return compute

    return add_columns(docs, make, "lang_pred string, score double, cross_entropy double, rejected boolean", [text], keep)
