"""Operator 7, quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare


@dataclass(frozen=True)
class Discriminant:
    """pooled: weight of the common covariance in each class's. ridge: weight of its mean variance on the diagonal.
    folds, held: a row whose crc32 of the id modulo `folds` is `held` teaches nothing."""

    pooled: float = 0.1
    ridge: float = 0.02
    folds: int = 3
    held: int = 1


def held_out(doc_id: Column, folds: int, held: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == held


# -- statistics -------------------------------------------------------------------------------------

STATISTICS = (
    "log_words", "word_length", "word_length_spread", "distinct", "repeats_next", "top_word", "bigrams_distinct", "symbols", "bars", "junk", "digits", "capitals", "line_words", "lines_repeated", "short_words", "stops",
)
PLAIN = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def _logit(part: float, whole: float) -> float:
    """A share on an open scale; a half is added on each side, so none and all stay finite."""
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def statistics(text: str) -> list[float]:
    """STATISTICS of a whole text, each on a scale on which plain prose is about normal. Empty texts have them too."""
    words, lines = text.split(), text.split("\n")
    n, chars = len(words), len(text)
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    marks = {c: text.count(c) for c in PLAIN}
    symbols = sum(marks.values())
    filled = [x for x in lines if x.strip()]
    pairs = list(zip(words, words[1:], strict=False))
    digits = sum(map(text.count, "0123456789"))
    capitals = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return [
        float(np.log1p(n)),
        float(np.log1p(sizes.mean())) if n else 0.0,
        float(np.log1p(sizes.std())) if n else 0.0,
        _logit(len(counts), n),
        _logit(sum(a == b for a, b in pairs), len(pairs)),
        _logit(max(counts.values(), default=0), n),
        _logit(len(set(pairs)), len(pairs)),
        _logit(symbols, chars),
        _logit(marks["|"], chars),
        _logit(sum(marks[c] for c in "#$%&*@^~<>{}[]\\_=+"), chars),
        _logit(digits, chars),
        _logit(capitals, chars),
        float(np.log1p(n / max(1, len(filled)))),
        _logit(len(filled) - len(set(filled)), len(filled)),
        _logit(int((sizes <= 3).sum()), n),
        _logit(marks["."] + marks["!"] + marks["?"], n + marks["."] + marks["!"] + marks["?"]),
    ]


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x) for every row, x in the order of STATISTICS; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


# -- the discriminant -------------------------------------------------------------------------------


class Model:
    """Means, and the inverse Cholesky factors of the shrunk covariances: made once, kept for all scores."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], how: Discriminant):
        """sums: by label the number of rows, the sums of x and of its products."""
        self.parts = []
        known = {k: v for k, v in sums.items() if v[0] > 0}
        if len(known) < 2:
            return
        total = sum(v[0] for v in known.values())
        scatter = {k: (xx - np.outer(x, x) / n) for k, (n, x, xx) in known.items()}
        common = sum(scatter.values()) / total
        common += (1e-6 + 1e-3 * np.trace(common) / len(common)) * np.eye(len(common))
        for label in (0, 1):
            n, x, _ = known[label]
            own = scatter[label] / n
            weight = max(how.pooled, len(own) / (len(own) + n))  # few rows lean on all rows
            own = (1 - weight) * own + weight * common
            own = (1 - how.ridge) * own + how.ridge * np.diag(np.diag(common))
            factor = np.linalg.cholesky(own)
            self.parts.append((x / n, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()), float(np.log(n / total))))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; one half where no rows of a class were there to learn from."""
        if not self.parts:
            return np.full(len(x), 0.5)
        density = [prior - volume - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, volume, prior in self.parts]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def labelled(labels: DataFrame, column: str, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, label), one row per id: of several labels the largest. Rows without id or label are left out."""
    rows = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    return rows.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))


def fit(stats: DataFrame, labels: DataFrame, how: Discriminant = Discriminant()) -> Model:
    """Sums over all labelled rows that aren't held out, map-side combined: two rows come to the driver."""
    train = stats.where(~held_out(F.col("doc_id"), how.folds, how.held)).join(labels, "doc_id")
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(F.col("x")[i]) for i in range(d)] + [F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in pairs]
    out = {}
    for row in train.groupBy("label").agg(F.count("*").alias("n"), F.array(*sums).alias("s")).collect():
        s, square = np.array(row["s"]), np.zeros((d, d))
        for (i, j), v in zip(pairs, s[d:], strict=True):
            square[i, j] = square[j, i] = v
        out[row["label"]] = (row["n"], s[:d], square)
    return Model(out, how)


def quality_scores(docs: DataFrame, labels: DataFrame, how: Discriminant = Discriminant(), doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    score is the posterior of label 1 by the log-density difference of two Gaussians over document
    statistics, whose covariances are shrunk to the pooled one. Inputs are texts alone; labels of held-out
    rows are never read into the fit. Null and empty texts are scored by the statistics of an empty text.
    A null id is in the fold of the empty id and can't have a label. Repeated rows come out as often as they
    go in. Without labels of both classes every score is 0.5. Other columns play no part.
    """
    prepare(docs.sparkSession)
    stats = cut(document_statistics(docs, doc_id, text))
    model = fit(stats, labelled(labels, label), how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(STATISTICS))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = stats.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id"), how.folds, how.held).alias("held_out"), "score", "predicted")
