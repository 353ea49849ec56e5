"""Toxicity by a counterfactually regularised classifier.

A logistic model over the distinct words of a text.  Besides the labelled texts it sees,
for every text that names a group, the text with the group's terms swapped for those of
a counterpart; the squared difference of the two scores (in log odds) is penalised, so
that naming a group doesn't move the score.  An L1 penalty keeps other words that tell
nothing out of the model; terms for groups are left to the penalty on score changes alone,
and are features however rare they are.  The log odds are scaled to probabilities on part of
the training rows, and shifted so that the wanted precision is met where the score is 0.7.

``swap_report`` tells, for texts, how much scores change when groups are swapped.

Fitting uses a bounded sample of labelled rows (``max_rows``, chosen by a hash of
doc_id); scoring covers all rows and whole texts.

Nulls and edge cases: null and empty texts get the score of a text without words; rows
without a label aren't learned from; rows repeated in documents or labels count as often
as they pair; with no labels of both kinds every score is the share of label 1 (0.5 when
there are none); other columns are kept as they are, and where one has the name of the
score's column already, that becomes score_2, or the first such name that is free.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.names import free_name
from pairloom.plans.staging import bound_batches

#: Terms for groups of people, in English, German, French and Spanish; each is swapped for the next one of its row.
IDENTITY_TERMS = (
    ("he", "she"), ("him", "her"), ("his", "hers"), ("man", "woman"), ("men", "women"), ("boy", "girl"), ("boys", "girls"),
    ("father", "mother"), ("son", "daughter"), ("brother", "sister"), ("husband", "wife"), ("male", "female"),
    ("gay", "straight"), ("lesbian", "heterosexual"), ("transgender", "cisgender"), ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american"), ("immigrant", "native"), ("immigrants", "natives"), ("old", "young"), ("disabled", "blind", "deaf"),
    ("mann", "frau"), ("männer", "frauen"), ("junge", "mädchen"), ("vater", "mutter"), ("schwul", "heterosexuell"), ("christ", "muslim", "jude"), ("christen", "muslime", "juden"), ("schwarze", "weiße"), ("ausländer", "einheimische"),
    ("homme", "femme"), ("hommes", "femmes"), ("garçon", "fille"), ("père", "mère"), ("homosexuel", "hétérosexuel"), ("chrétien", "musulman", "juif"), ("chrétiens", "musulmans", "juifs"), ("noir", "blanc", "arabe"), ("immigré", "natif"),
    ("hombre", "mujer"), ("hombres", "mujeres"), ("niño", "niña"), ("padre", "madre"), ("homosexual", "heterosexual"), ("cristiano", "musulmán", "judío"), ("cristianos", "musulmanes", "judíos"), ("negro", "blanco"), ("inmigrante", "nativo"),
)
#: A term of two rows keeps its counterpart in the first.
SWAP = {a: row[(k + 1) % len(row)] for row in reversed(IDENTITY_TERMS) for k, a in enumerate(row)}
_WORD = re.compile(r"[^\W\d_]+")
_BITS = 20
_BLOCK = 1 << 20


def words_of(text: str | None) -> set[str]:
    """The distinct words of a whole text, lower-cased; marks within or around words are passed over."""
    found: set[str] = set()
    text = text or ""
    at = 0
    while at < len(text):
        end = min(len(text), at + _BLOCK)
        while end < len(text) and not text[end].isspace():  # not within a word
            end += 1
        found.update(_WORD.findall(text[at:end].lower()))
        at = end
    return found


def feature_of(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 11) >> (64 - _BITS)


@dataclass
class ToxicityModel:
    """``weights``: of features that count; ``bias``; ``scale`` and ``shift`` calibrate the log odds."""

    weights: dict[int, float]
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    known: dict[str, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        known, z = self.known, 0.0
        got = []
        for word in words_of(text):
            w = known.get(word)
            if w is None:
                w = self.weights.get(feature_of(word), 0.0)
                if len(known) < 300_000:
                    known[word] = w
            if w:
                got.append(w)
        z = self.scale * (self.bias + float(sum(sorted(got)))) + self.shift
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "scale": self.scale, "shift": self.shift, "known": {}}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Sparse:
    """Rows of distinct feature numbers."""

    def __init__(self, rows: list[np.ndarray], columns: int):
        self.n, self.columns = len(rows), columns
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.concatenate(rows) if rows else np.empty(0, dtype=np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n)

    def t_dot(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=v[self.row], minlength=self.columns)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], l1: float = 0.0015, fairness: float = 1.0, rounds: int = 150, min_docs: int = 4, precision: float = 0.9) -> ToxicityModel:
    """``rows``: features, features of the swapped text (empty if it names no group), label."""
    labels = np.array([y for *_, y in rows], dtype=float)
    if not len(labels) or labels.min() == labels.max():
        share = 0.5 if not len(labels) else float(np.clip(labels.mean(), 0.01, 0.99))
        return ToxicityModel({}, float(np.log(share / (1 - share))))
    df = np.bincount(np.concatenate([f for f, _, _ in rows] + [s for _, s, _ in rows]), minlength=1 << _BITS)
    terms = np.zeros(1 << _BITS, dtype=bool)
    terms[[feature_of(w) for w in SWAP]] = True
    kept = np.flatnonzero((df >= min_docs) | (terms & (df > 0)))
    penalty = np.where(terms[kept], 0.0, l1)
    place = np.full(1 << _BITS, -1)
    place[kept] = np.arange(len(kept))
    narrow = lambda f: (p := place[f])[p >= 0]
    x = _Sparse([narrow(f) for f, _, _ in rows], len(kept))
    # what the swap changes; the words that both have cancel out
    pairs = [(narrow(np.setdiff1d(f, s)), narrow(np.setdiff1d(s, f))) for f, s, _ in rows if len(s)]
    a, b = _Sparse([p[0] for p in pairs], len(kept)), _Sparse([p[1] for p in pairs], len(kept))
    check = np.arange(len(rows)) % 5 == 0
    fit_rows = ~check if len(rows) >= 200 else np.ones(len(rows), dtype=bool)

    def descend(use: np.ndarray) -> tuple[np.ndarray, float]:
        """FISTA with per-feature steps and restarts."""
        w, z, bias, zb, t, before = np.zeros(len(kept)), np.zeros(len(kept)), 0.0, 0.0, 1.0, np.inf
        freq = df[kept] / max(1, len(rows))
        swaps = (a.t_dot(np.ones(a.n)) + b.t_dot(np.ones(b.n))) / max(1, len(pairs))
        step = 1.0 / (4.0 * fairness * swaps + 0.25 * np.sqrt(freq * max(1.0, float(np.mean(np.bincount(x.row, minlength=x.n))))) + 1e-3)
        n = use.sum()
        for _ in range(rounds):
            p = _sigmoid(x.dot(z) + zb)
            loss = -float((labels * np.log(p + 1e-12) + (1 - labels) * np.log(1 - p + 1e-12))[use].mean())
            if loss > before:
                t, z, zb = 1.0, w.copy(), bias
            before = loss
            err = np.where(use, p - labels, 0.0) / n
            grad = x.t_dot(err)
            if len(pairs):
                gap = (a.dot(z) - b.dot(z)) * (2 * fairness / len(pairs))
                grad += a.t_dot(gap) - b.t_dot(gap)
            new = z - step * grad
            new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
            new_bias = zb - 4.0 * err.sum()
            t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
            z, zb = new + (t - 1) / t_next * (new - w), new_bias + (t - 1) / t_next * (new_bias - bias)
            w, bias, t = new, new_bias, t_next
        return w, bias

    w, bias = descend(fit_rows)
    scale, shift = 1.0, 0.0
    margin = x.dot(w) + bias
    held = check if len(rows) >= 200 else np.ones(len(rows), dtype=bool)
    scale, shift = _calibrated(margin[held], labels[held])
    margin = scale * margin + shift
    order = np.argsort(-margin[held], kind="stable")
    hits = np.cumsum(labels[held][order])
    good = np.flatnonzero(hits / np.arange(1, len(order) + 1) >= precision)
    if len(good):  # 0.7 is where the wanted precision ends, halfway to the next lower score
        z = margin[held][order]
        last = int(good[-1])
        cut = (z[last] + z[last + 1]) / 2 if last + 1 < len(z) else z[last] - 1e-6
        # but nothing that is likelier 0 than 1
        shift += float(np.log(0.7 / 0.3) - max(cut, 0.0))
    return ToxicityModel({int(k): float(v) for k, v in zip(kept, w) if v}, float(bias), scale, shift)


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Factor (above 0) and shift that turn log odds ``z`` into calibrated ones: Newton steps on log loss."""
    if y.min() == y.max():
        return 1.0, 0.0
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * z + b)
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - y) * z).sum() + 1e-3 * (a - 1), (p - y).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - float(move[0]), b - float(move[1])
    return float(np.clip(a, 0.1, 20.0)), float(np.clip(b, -30.0, 30.0))


def swapped(text: str) -> str:
    """A text with every term for a group swapped for that of its counterpart, in lower case."""
    return _WORD.sub(lambda m: SWAP.get(m[0].lower(), m[0]), text)


def swap_report(model: ToxicityModel, texts: list[str], threshold: float = 0.7) -> dict[str, float]:
    """For texts that name a group: mean change of score when groups are swapped, and the share whose side of the threshold changes."""
    named = [t for t in texts if not SWAP.keys().isdisjoint(words_of(t))]
    pairs = [(model.score(t), model.score(swapped(t))) for t in named]
    n = max(1, len(pairs))
    return {"texts": len(pairs), "mean_change": sum(abs(a - b) for a, b in pairs) / n, "flips": sum((a >= threshold) != (b >= threshold) for a, b in pairs) / n, "flagged": sum(a >= threshold for a, _ in pairs) / n}


def fit(docs: DataFrame, labels: DataFrame, use: Column, label: str = "toxic", max_rows: int = 8000, **options) -> ToxicityModel:
    """Learn ``label`` from labelled rows where ``use`` (over doc_id) holds, about ``max_rows`` of them."""
    bound_batches(docs.sparkSession)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y is not null").where(use)
    n = marked.count()
    part = min(1.0, max_rows / max(1, n))
    marked = marked.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(5)), 11) / F.lit(float(1 << 53)) < part)
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("text"))
    rows = texts.join(marked, texts["d"] == marked["doc_id"]).select("doc_id", "text", "y")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def coded(words: set[str]) -> bytes:
            return np.unique(np.fromiter(map(feature_of, words), dtype="<u4", count=len(words))).tobytes()

        for batch in batches:
            sets = [words_of(x.as_py()) for x in batch.column(1)]
            swapped = [coded({SWAP.get(w, w) for w in s}) if not SWAP.keys().isdisjoint(s) else b"" for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coded(s) for s in sets], pa.binary()), pa.array(swapped, pa.binary()), batch.column(2)], names=["doc_id", "f", "s", "y"])

    got = sorted((r["doc_id"], bytes(r["f"]), bytes(r["s"]), int(r["y"] > 0)) for r in rows.mapInArrow(features, "doc_id long, f binary, s binary, y int").collect())
    read = lambda b: np.frombuffer(b, "<u4").astype(np.int64)
    return train([(read(f), read(s), y) for _, f, s, y in got], **options)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", to: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``to`` (or the first such name that is free): the score, 0 to 1."""
    bound_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def apply(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([round(model.score(x.as_py()), 6) for x in batch], pa.float64())

    return docs.withColumn(free_name(docs.columns, to), apply(F.col(text).cast("string")))
