"""Language of a text by the nearest of several centroids per language, over normalised TF-IDF vectors of n-grams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 4096
SAMPLE_PER_LANGUAGE = 250
CENTROIDS = 4
UNKNOWN = "und"
# Texts with under 2^TINY_BITS different cells (about 32 bytes) hold too little to judge.
TINY_FLOOR, TINY_BITS = 0.02, 7
# A floor is this quantile of the cosines of at least so many training rows, each to centroids learnt without its fold.
FLOOR_QUANTILE, FLOOR_ROWS, FOLDS = 0.005, 50, 4
# Letters, and signs for numbers such as halves and squares, which are told apart below.
LETTER_OR_SIGN = re.compile(r"[^\W\d_]")
# Documents in one block of vectors, and bytes of text in it (a longer text makes a block of its own).
BLOCK_ROWS, BLOCK_BYTES = 64, 256 << 10
GRAMS = (1, 2, 3, 4)
FACTORS = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)


@dataclass(frozen=True)
class LanguageModel:
    """``centroids`` holds CENTROIDS unit vectors per language, at most; ``owner`` the language of each.

    ``floors[i, b]`` is the cosine to the nearest centroid, one of language i, under which a text with 2^b to 2^(b+1)
    different cells is too far. Cells tell how much a text says: many bytes of a repeated word fill few of them.
    """

    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray

    def nearest(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, cosine to its nearest centroid, and whether that is under the floor, per text."""
        points = vectors(texts, self.idf)
        cosine = points @ self.centroids.T
        best = np.argmax(cosine, axis=1)
        language, top = self.owner[best], cosine[np.arange(len(texts)), best]
        return language, top, top < self.floors[language, bands(points)]


def has_letter(text: str | None) -> bool:
    return any(m.group().isalpha() for m in LETTER_OR_SIGN.finditer(text or ""))


def bands(points: np.ndarray) -> np.ndarray:
    """The b of 2^b <= number of different cells < 2^(b+1); 0 for none."""
    return np.log2(np.maximum((points > 0).sum(axis=1), 1)).astype(int)


def gram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed byte n-grams (1 to 4) per text."""
    gap = b"\0" * (max(GRAMS) - 1)
    data = np.frombuffer(gap.join(texts) + gap, np.uint8).astype(np.uint32)
    sizes = np.array([len(t) + len(gap) for t in texts])
    row = np.repeat(np.arange(len(texts)) * DIMENSIONS, sizes)
    total = np.zeros(len(texts) * DIMENSIONS, np.int64)
    code = np.zeros(len(data), np.uint32)
    for n in GRAMS:
        code = code[: len(data) - n + 1] + data[n - 1:] * FACTORS[n - 1]
        slot = (code * np.uint32(2654435769)) >> np.uint32(32 - 12)
        total += np.bincount(row[: len(slot)] + slot, minlength=len(total))
    return total.reshape(len(texts), DIMENSIONS)


def vectors(texts: list[bytes], idf: np.ndarray | None = None) -> np.ndarray:
    found = np.log1p(gram_counts(texts)).astype(np.float32)
    if idf is not None:
        found *= idf
        found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)
    return found


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").lower().encode()
        if held and (len(held) == BLOCK_ROWS or size + len(raw) > BLOCK_BYTES):
            yield start, held
            start, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield start, held


def clusters(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, each further one the point farthest from all so far."""
    k = min(k, len(points))
    centres = [points.mean(axis=0)]
    while len(centres) < k:
        near = np.max(points @ (np.array(centres) / np.linalg.norm(centres, axis=1, keepdims=True)).T, axis=1)
        centres.append(points[int(np.argmin(near))])
    for _ in range(rounds):
        unit = np.array(centres) / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        own = np.argmax(points @ unit.T, axis=1)
        centres = [points[own == c].mean(axis=0) if (own == c).any() else unit[c] for c in range(k)]
    return (np.array(centres) / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def floors(points: np.ndarray, labels: np.ndarray, languages: list[str], centroids: int) -> np.ndarray:
    """A low quantile of the cosines of training rows to centroids that were learnt without them, per language and band.

    A band with too few rows of the language takes those of all languages, and if these are too few as well, the bands around
    it. Equal texts are in one fold.
    """
    fold = np.array([zlib.crc32(p.tobytes()) % FOLDS for p in points])
    cosines = np.full(len(points), np.nan)
    for language in languages:
        for f in range(FOLDS):
            own = labels == language
            learnt, asked = own & (fold != f), own & (fold == f)
            if learnt.any() and asked.any():
                cosines[asked] = np.max(points[asked] @ clusters(points[learnt], centroids).T, axis=1)
    judged = ~np.isnan(cosines)
    band = bands(points)
    found = np.full((len(languages), DIMENSIONS.bit_length()), TINY_FLOOR)
    if not judged.any():
        return found
    for b in range(TINY_BITS, found.shape[1]):
        for i, language in enumerate(languages):
            rows = judged & (labels == language) & (band == b)
            for around in range(found.shape[1]):
                if rows.sum() >= FLOOR_ROWS:
                    break
                rows = judged & (np.abs(band - b) <= around)
            found[i, b] = np.quantile(cosines[rows], FLOOR_QUANTILE)
    return found


def fit(labelled: DataFrame, *, per_language: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS) -> LanguageModel:
    """Learn from (doc_id, text, lang): about ``per_language`` rows of each language, chosen by a hash of the id.

    That sample is the documented bound of what reaches the driver: one vector of DIMENSIONS floats per row of it.
    Rows without a label or a text teach nothing. Without any row the model knows no language and rejects all.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageModel([], np.zeros(0, int), np.zeros((0, DIMENSIONS), np.float32), np.ones(DIMENSIONS, np.float32), np.zeros((0, 0)))
    pick = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30))
    share = F.lit(0)
    for language, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == language, F.lit(min(1 << 30, (per_language << 30) // n))).otherwise(share)

    def taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = batch.column(1).to_pylist()
            for start, held in blocks(batch.column(0).to_pylist()):
                rows = vectors(held)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(languages[start: start + len(held)]), pa.array([r.tobytes() for r in rows], pa.binary()),
                    ],
                    names=["lang", "vector"],
                )

    rows = usable.where(pick < share).select("text", "lang").mapInArrow(taught, "lang string, vector binary").collect()
    languages = sorted({r["lang"] for r in rows})
    points = np.array([np.frombuffer(r["vector"], np.float32) for r in rows])
    labels = np.array([r["lang"] for r in rows])
    idf = (np.log((1 + len(points)) / (1 + (points > 0).sum(axis=0))) + 1).astype(np.float32)
    points *= idf
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
    found = [clusters(points[labels == language], centroids) for language in languages]
    owner = np.concatenate([[i] * len(c) for i, c in enumerate(found)]).astype(int)
    return LanguageModel(languages, owner, np.concatenate(found), idf, floors(points, labels, languages, centroids))


def identify(docs: DataFrame, model: LanguageModel, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of ``docs``, from the whole text alone.

    ``score`` is the cosine to the nearest centroid (0 to 1). A text is rejected when that cosine is under the floor of
    that language for texts with as many different n-gram cells (see ``floors``). A null text or one without a letter is ``und`` with score 0 and rejected. Repeated rows give repeated
    rows, an empty table none; further columns are not looked at. A model without languages answers ``und``.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, scores, rejected = [], [], []
            for start, held in blocks(texts):
                if model.languages:
                    language, cosine, far = model.nearest(held)
                for i in range(len(held)):
                    text = texts[start + i]
                    if not model.languages or not has_letter(text):
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        rejected.append(True)
                    else:
                        names.append(model.languages[language[i]])
                        scores.append(float(min(1.0, max(0.0, cosine[i]))))
                        rejected.append(bool(far[i]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    slim = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return slim.mapInArrow(named, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def held_out(id_column: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text is a multiple of 5 (a null id counts as empty)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with all their columns; the texts are not shuffled."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns
    at = columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            stays = []
            for start, held in blocks(texts):
                far = model.nearest(held)[2] if model.languages else np.ones(len(held), bool)
                stays += [not far[i] and has_letter(texts[start + i]) for i in range(len(held))]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
