"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of labelled texts by language in `buckets` hashed buckets. A language with more than
`train_docs` labelled documents is represented by those whose hashed id falls below the share that makes about train_docs
(a bounded sample of labelled rows, drawn alike at every size); each of them counts with its whole text. The matrix of log
probabilities (buckets x languages; its size is checked before use) is broadcast; texts are scored in batches, as sparse
bucket counts times the matrix. An n-gram is n characters in a row of the lower-cased text, where each run of characters
that are not letters counts as one space.

A score is the posterior of the predicted language at `evidence` n-grams: the text's mean log likelihood a gram, times the
smaller of its grams and `evidence`, so that a long text doesn't count as certain by its length alone.

Defined results: a null text, or one without a letter, is `und` with score 0; ties go to the language first in order;
rows with a null language don't train; without labelled rows every text is `und`. A text of any length counts whole, slice by
slice. Rows that repeat count each. Empty tables give no rows. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, prepare, slices

_TABLE: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    global _TABLE
    if _TABLE is None:
        table = np.full(0x110000, 32, np.uint32)
        for point in range(0x110000):
            c = chr(point)
            if c.isalpha():
                low = c.lower()
                table[point] = ord(low) if len(low) == 1 else point
        _TABLE = table
    return _TABLE


#: So many characters of a text are looked at at once: a long text is counted slice by slice, whole, in bounded memory.
SLICE = 1 << 18


def normalised(text: str, slice_: int = SLICE):
    """The code points of the text's letters, with one space before, between and after, slice by slice."""
    last = np.uint32(0)
    for at in range(0, len(text), slice_):
        points = _letters()[np.frombuffer(text[at : at + slice_].encode("utf-32-le", "surrogatepass"), np.uint32)]
        if not at:
            points = np.concatenate(([np.uint32(32)], points))
        if at + slice_ >= len(text):
            points = np.concatenate((points, [np.uint32(32)]))
        points = points[~((points == 32) & (np.concatenate(([last], points[:-1])) == 32))]
        if len(points):
            last = points[-1]
            yield points


def grams(points: np.ndarray, sizes: tuple[int, ...], buckets: int, seen: int = 0) -> np.ndarray:
    """The buckets of the n-grams that go beyond the first `seen` points; buckets is a power of two."""
    out, shift = [], np.uint64(64 - (buckets.bit_length() - 1))
    points = points.astype(np.uint64)
    h = np.zeros(len(points), np.uint64)
    for n in range(1, max(sizes) + 1):
        if len(points) < n:
            break
        h = (h[: len(points) - n + 1] + points[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in sizes:
            out.append(((h[max(0, seen - n + 1) :] * np.uint64(0xBF58476D1CE4E5B9)) >> shift).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def counted(text: str, sizes: tuple[int, ...], buckets: int, slice_: int = SLICE) -> tuple[np.ndarray, np.ndarray, bool]:
    """A text as a sparse row: the buckets it has n-grams in, rising, and how many; and whether it has a letter."""
    total, tail, letters = None, np.empty(0, np.uint32), False
    for points in normalised(text, slice_=slice_):
        letters = letters or bool((points != 32).any())
        own = grams(np.concatenate((tail, points)), sizes, buckets, len(tail))
        tail = np.concatenate((tail, points))[-(max(sizes) - 1) :] if max(sizes) > 1 else tail
        if total is None and len(text) <= slice_ and 16 * len(own) < buckets:  # a short text: sorting is less than counting
            found, n = np.unique(own, return_counts=True)
            return found, n, letters
        n = np.bincount(own, minlength=buckets)
        total = n if total is None else total + n
    if total is None:
        return np.empty(0, np.int64), np.empty(0, np.int64), False
    found = np.flatnonzero(total)
    return found, total[found], letters


def _counted(sizes: tuple[int, ...], buckets: int):
    """Rows (lang, bucket, n) of each partition."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for rows in batches:
            for part in slices(rows, "text", 8 << 20):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if lang not in counts:
                        counts[lang] = np.zeros(buckets, np.int64)
                    found, n, _ = counted(text, sizes, buckets)
                    counts[lang][found] += n
        for lang, own in counts.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(own[some])], ["lang", "bucket", "n"])

    return run


class Model:
    def __init__(self, languages: list[str], log_p: np.ndarray, prior: np.ndarray, sizes: tuple[int, ...], evidence: int):
        self.languages, self.log_p, self.prior, self.sizes, self.evidence = languages, log_p, prior, sizes, evidence
        self.columns = [np.ascontiguousarray(log_p[:, i]) for i in range(len(languages))]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Sparse scoring of a batch: its texts are the rows of a sparse matrix of bucket counts (row ends, buckets, counts),
        which is multiplied with the matrix of log probabilities, a language at a time."""
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        usable, rows = [], []
        for i, text in enumerate(texts):
            if self.languages and text and (row := counted(text, self.sizes, len(self.log_p)))[2]:
                usable.append(i)
                rows.append(row)
        if not usable:
            return names, scores
        ends = np.cumsum([len(found) for found, _, _ in rows])
        buckets, counts = np.concatenate([found for found, _, _ in rows]), np.concatenate([n for _, n, _ in rows]).astype(np.float64)
        starts = np.concatenate(([0], ends[:-1]))
        sums = np.stack([np.add.reduceat(counts * column[buckets], starts) for column in self.columns], 1)
        lengths = np.add.reduceat(counts, starts)
        likely = sums * (np.minimum(lengths, self.evidence) / lengths)[:, None] + self.prior
        likely -= likely.max(1, keepdims=True)
        posterior = np.exp(likely)
        posterior /= posterior.sum(1, keepdims=True)
        for i, row in zip(usable, posterior, strict=True):
            best = int(np.argmax(row))
            names[i], scores[i] = self.languages[best], float(min(1.0, row[best]))
        return names, scores


def train(labelled: DataFrame, sizes: tuple[int, ...] = (1, 2, 3), buckets: int = 1 << 15, train_docs: int = 5000, smoothing: float = 0.5, evidence: int = 200, most_cells: int = 1 << 26) -> Model:
    """Learn from (doc_id, text, lang). What reaches the driver is the matrix: buckets x languages, most_cells at most."""
    prepare(labelled.sparkSession)
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes_by = {r.lang: r["count"] for r in labelled.groupBy("lang").count().limit(most_cells // buckets + 1).collect()}
    if len(sizes_by) * buckets > most_cells:
        raise ValueError(f"{len(sizes_by)} languages or more: the matrix would be too large to broadcast")
    languages = sorted(sizes_by)
    if not languages:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0), sizes, evidence)
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, train_docs / sizes_by[lang])))])
    drawn = F.coalesce(F.crc32(F.concat(F.lit("train-"), F.col("doc_id").cast("string"))), F.lit(0)) / F.lit(float(2**32))
    sample = labelled.where(drawn < F.element_at(share, F.col("lang")))
    counts = sample.select("text", "lang").mapInArrow(_counted(sizes, buckets), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    matrix = np.full((buckets, len(languages)), smoothing)
    place = {lang: i for i, lang in enumerate(languages)}
    for row in counts.toLocalIterator():
        matrix[row.bucket, place[row.lang]] += row.n
    matrix = np.log(matrix / matrix.sum(0)).astype(np.float32)
    total = sum(sizes_by.values())
    return Model(languages, matrix, np.log([sizes_by[lang] / total for lang in languages]), sizes, evidence)


def _predicted(model, names: list[str]):
    def run(batches):
        for rows in batches:
            for part in slices(rows, "text", 1 << 20):
                found, scores = model.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names)

    return run


def predict(docs: DataFrame, model: Model, lang: str | None = None, score: str | None = None) -> DataFrame:
    """docs, which needs text, with the language and its score besides, in columns of the given names: by default _lang and
    _score, with underscores more where docs has these."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    prepare(docs.sparkSession)
    own = free(docs, "_lang", "_score")
    lang, score = lang or own[0], score or own[1]
    out = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(_predicted(sent, out.names), out)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
