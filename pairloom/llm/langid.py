"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text becomes counts of its hashed 1- to 3-grams over letters and word gaps, damped
(1 + log), weighted by inverse document frequency and normalised.  Each language has
several centroids, from spherical k-means over its training vectors.  The language of
the nearest centroid by cosine is predicted; a text whose cosine distance to it exceeds
the radius of that centroid's language is rejected.

Radii come from held-out distances: centroids fitted without a fold of the sample meet
that fold's texts.  Short texts lie farther from any centroid, so a radius is kept for
each class of length, with prefixes of the held-out texts standing for short ones.

Fitting uses a bounded sample: about ``per_language`` documents of each language, chosen
by a hash of their id; document frequencies, centroids and radii come from it.  Prediction
covers all rows and whole texts.

Nulls and edge cases: null texts and texts without a letter get ``und``, score 0 and are
rejected; rows without a language aren't learned from; with nothing to learn from, every
text is ``und``; a language with few texts takes the distances of all; with no held-out
text at all, nothing with a letter is rejected; repeated rows are predicted alike; other
columns are kept as they are, and where one is called prediction, the result is prediction_2.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.names import free_name
from pairloom.plans.staging import bound_batches

_BITS = 14
DIM = 1 << _BITS
#: The whole text and its prefixes of so many characters give held-out distances.
_CUTS = (None, 256, 64, 16)
#: Texts of less than 2 ** k n-grams have a radius for each k; those of 2 ** (_CLASSES - 1) or more share one.
_CLASSES = 10
#: A language with fewer held-out distances of whole texts takes those of all languages.
_FEW = 20
#: Characters counted at a time: bounds the memory of one very long text.
_BLOCK = 1 << 20
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams of a whole text, None without a letter. What isn't a letter is a gap; gaps run together."""
    table, counts, found, tail = letter_table(), np.zeros(DIM, dtype=np.int64), False, np.array([32], dtype=np.uint64)
    for at in range(0, len(text or ""), _BLOCK):
        codes = np.frombuffer(text[at : at + _BLOCK].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        is_letter = table[codes]
        found = found or bool(is_letter.any())
        codes = np.where(is_letter, codes, 32).astype(np.uint64)
        codes = np.concatenate([tail, codes])
        new = len(tail)
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
        keep[:new] = True
        codes = codes[keep]
        one = codes * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD) + one[1:]
        three = (two[:-1] ^ np.uint64(0xA0761D6478BD642F)) * np.uint64(0xC4CEB9FE1A85EC53) + one[2:]
        # n-grams that end among the new characters
        for grams, n in ((one, 1), (two, 2), (three, 3)):
            fresh = grams[max(0, new - n + 1) :]
            counts += np.bincount(((fresh * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - _BITS)).astype(np.int64), minlength=DIM)
        tail = codes[-2:]
    return counts if found else None


def _length_class(counts: np.ndarray) -> int:
    return min(int(counts.sum()).bit_length(), _CLASSES)


@dataclass
class CentroidModel:
    """``centroids``: unit rows; ``language``: of each row; ``radius``: cosine distance up to which it accepts, by length class."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    language: np.ndarray
    radius: np.ndarray

    def vector(self, counts: np.ndarray) -> np.ndarray:
        x = np.zeros(DIM, dtype=np.float32)
        at = np.flatnonzero(counts)
        x[at] = (1 + np.log(counts[at])) * self.idf[at]
        return x / max(np.float32(np.sqrt(x @ x)), np.float32(1e-9))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine (0 to 1) and whether the text is rejected."""
        counts = ngram_counts(text) if text and self.languages else None
        if counts is None:
            return "und", 0.0, True
        cosines = self.centroids @ self.vector(counts)
        best = int(cosines.argmax())
        # sums of the same numbers in another order may differ in the last digits
        score = round(min(1.0, max(0.0, float(cosines[best]))), 5)
        return self.languages[self.language[best]], score, 1 - score > self.radius[best, _length_class(counts)]


def _kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means, started in turn from points farther from those before than nine tenths of all: the farthest are strays."""
    mean = x.mean(axis=0)
    chosen = [x[int((x @ mean).argmax())]]
    while len(chosen) < min(k, len(x)):
        chosen.append(x[int(np.max(x @ np.array(chosen).T, axis=1).argsort(kind="stable")[len(x) // 10])])
    centers = np.array(chosen)
    for _ in range(rounds):
        near = (x @ centers.T).argmax(axis=1)
        sums = np.array([x[near == c].sum(axis=0) if (near == c).any() else centers[c] for c in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centers.astype(np.float32)


def _radii(held_out: list[tuple[float, int, bool]], quantile: float, margin: float) -> np.ndarray:
    """Radius by length class from (cosine, class, whole text or not): a class accepts what the next longer one does and more."""
    out = np.ones(_CLASSES + 1)
    longest = [x for x, k, whole in held_out if whole and k == _CLASSES] or [x for x, _, whole in held_out if whole]
    if not longest:
        return out
    least = np.inf
    for k in range(_CLASSES, -1, -1):
        cosines = longest if k == _CLASSES else [x for x, c, _ in held_out if c == k]
        if cosines:
            least = min(least, (1 - margin) * float(np.quantile(cosines, 1 - quantile, method="lower")))
        out[k] = 1 - least
    return out


def fit(docs: DataFrame, use: Column, per_language: int = 400, clusters: int = 3, quantile: float = 0.995, margin: float = 0.1, folds: int = 4) -> CentroidModel:
    """Learn from rows where ``use`` holds and neither text nor lang is null.

    A text is rejected when its cosine is below that of all but 1 - ``quantile`` of the
    held-out texts of its length, less the part ``margin``.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), use.alias("use"))
    rows = rows.where("use and text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return CentroidModel([], np.zeros(DIM, dtype=np.float32), np.zeros((0, DIM), dtype=np.float32), np.zeros(0, dtype=int), np.zeros((0, _CLASSES + 1)))
    part = F.element_at(F.create_map(*[F.lit(v) for k, n in sorted(sizes.items()) for v in (k, min(1.0, per_language / n))]), F.col("lang"))
    sample = rows.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(3)), 11) / F.lit(float(1 << 53)) < part)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, places, numbers = [], [], []
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                text = text.as_py()
                found = [c for cut in _CUTS if (cut is None or cut < len(text)) and (c := ngram_counts(text[:cut])) is not None]
                if found:
                    at = [np.flatnonzero(c) for c in found]
                    langs.append(lang)
                    places.append([p.astype("<u2").tobytes() for p in at])
                    numbers.append([c[p].astype("<u4").tobytes() for c, p in zip(found, at)])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(places, pa.list_(pa.binary())), pa.array(numbers, pa.list_(pa.binary()))], names=["lang", "place", "n"])

    def dense(place: bytes, n: bytes) -> np.ndarray:
        counts = np.zeros(DIM, dtype=np.int64)
        counts[np.frombuffer(place, "<u2")] = np.frombuffer(n, "<u4")
        return counts

    # of each text the whole and its prefixes
    got = sorted((r["lang"], [bytes(p) for p in r["place"]], [bytes(n) for n in r["n"]]) for r in sample.select("text", "lang").mapInArrow(count, "lang string, place array<binary>, n array<binary>").collect())
    languages = sorted({g[0] for g in got})
    model = CentroidModel(languages, np.zeros(DIM, dtype=np.float32), np.zeros((0, DIM), dtype=np.float32), np.zeros(0, dtype=int), np.zeros((0, _CLASSES + 1)))
    df = np.zeros(DIM)
    for _, place, _ in got:
        df[np.frombuffer(place[0], "<u2")] += 1
    model.idf = (np.log((1 + len(got)) / (1 + df)) + 1).astype(np.float32)
    fold = [zlib.crc32(place[0] + n[0]) % folds for _, place, n in got]  # equal texts are held out together
    # centers of each language: without each fold in turn, and last with all
    centers: list[list[np.ndarray]] = [[] for _ in range(folds + 1)]
    owner: list[list[int]] = [[] for _ in range(folds + 1)]
    for k, lang in enumerate(languages):
        own = [i for i, g in enumerate(got) if g[0] == lang]
        x = np.array([model.vector(dense(got[i][1][0], got[i][2][0])) for i in own])
        for without in range(folds + 1):
            left = np.array([fold[i] != without for i in own])
            if left.any():
                found = _kmeans(x[left], clusters)
                centers[without] += list(found)
                owner[without] += [k] * len(found)
    held_out: list[list[tuple[float, int, bool]]] = [[] for _ in languages]
    for without in range(folds):
        if centers[without]:
            c = np.array(centers[without])
            for _, places, ns in (g for g, f in zip(got, fold) if f == without):
                for part, (place, n) in enumerate(zip(places, ns)):
                    counts = dense(place, n)
                    cosines = c @ model.vector(counts)
                    best = int(cosines.argmax())
                    held_out[owner[without][best]].append((float(cosines[best]), _length_class(counts), part == 0))
    every = [x for one in held_out for x in one]
    radius = [_radii(one if sum(x[2] for x in one) >= _FEW else every, quantile, margin) for one in held_out]
    model.centroids, model.language = np.array(centers[folds]), np.array(owner[folds])
    model.radius = np.array([radius[k] for k in owner[folds]])
    return model


def predict(docs: DataFrame, model: CentroidModel, text: str = "text", to: str = "prediction") -> DataFrame:
    """All columns of ``docs`` and ``to`` (or the first such name that is free): struct of lang_pred, score and rejected."""
    bound_batches(docs.sparkSession)

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def apply(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = [model.predict(x.as_py()) for x in batch]
            columns = list(zip(*rows)) or [()] * 3
            yield pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())], names=["lang_pred", "score", "rejected"])

    return docs.withColumn(free_name(docs.columns, to), apply(F.col(text).cast("string")))


def drop_rejected(docs: DataFrame, use: Column, **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose text isn't rejected."""
    return predict(docs, fit(docs, use, **options), to="__pl_lang").where("not __pl_lang.rejected").drop("__pl_lang")
