"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of each whole text are computed by Spark's own functions. Cosine features with random frequencies approximate a
Gaussian kernel over the standardised statistics. Each partition sums its share of the normal equations (Z'Z and Z'y), Spark
adds the shares, and the driver solves one small system. Scores are calibrated by isotonic regression over a fixed grid of
scores, so what reaches the driver is bounded by the number of features and of grid cells, not by the rows.

Nothing but the text goes into a score. NULL and empty texts have the statistics of an empty text and are scored like any
other. Labels that are NULL or belong to no document are ignored; of several labels of one document the lowest counts.
Repeated rows are scored each; all labelled rows of the training part are used. Without a usable label every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAK, cut, fresh

#: Cells of the calibration grid over raw scores from -0.5 to 1.5.
CELLS = 2000
#: What counts as a symbol (fixed value of the quality rules).
SYMBOLS = "#*$%&|<>"
_STATISTICS = (
    "log_chars", "word_length", "symbols", "capitals", "marks", "digits", "distinct_words", "repeated_neighbours",
    "distinct_lines", "line_length", "words_with_symbols", "longest_word",
)


def statistics(text: Column) -> list[Column]:
    """The statistics of a text, as doubles; shares are 0 where there is nothing to share."""
    text = F.coalesce(text, F.lit(""))
    chars = F.char_length(text)
    share = lambda part, whole: F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
    count = lambda of: chars - F.char_length(F.translate(text, of, ""))
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")
    n_words, n_lines = F.size(words), F.size(lines)
    repeated = F.size(F.filter(F.arrays_zip(F.slice(words, 2, F.greatest(n_words - 1, F.lit(0))).alias("a"), F.slice(words, 1, F.greatest(n_words - 1, F.lit(0))).alias("b")), lambda p: p["a"] == p["b"]))
    return [
        F.log1p(chars.cast("double")), share(chars - count(" "), n_words), share(count(SYMBOLS), chars),
        share(count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), chars), share(count("!?"), chars), share(count("0123456789"), chars),
        share(F.size(F.array_distinct(words)), F.sqrt(n_words.cast("double"))), share(repeated, n_words),
        share(F.size(F.array_distinct(lines)), n_lines), F.log1p(share(chars, n_lines)),
        share(F.size(F.filter(words, lambda w: F.translate(w, SYMBOLS, "") != w)), n_words),
        F.log1p(F.aggregate(words, F.lit(0), lambda a, w: F.greatest(a, F.char_length(w))).cast("double")),
    ]


@dataclass
class Model:
    """What scoring needs: a few small arrays."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    grid: np.ndarray = field(default_factory=lambda: np.zeros(0))
    calibrated: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.frequencies + self.phases
        return np.hstack([np.cos(z) * np.sqrt(2 / len(self.phases)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores between 0 and 1; a thousandth of the raw score keeps the order within calibrated steps."""
        if self.weights is None or not len(self.grid):
            return np.full(len(x), 0.5)
        raw = np.clip(self.raw(x), -0.5, 1.5)
        return 0.999 * np.interp(raw, self.grid, self.calibrated) + 0.001 * (raw + 0.5) / 2


def isotonic(weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The nondecreasing sequence nearest to ``means`` in weighted squares (pool adjacent violators)."""
    pools: list[list[float]] = []
    for w, m in zip(weights.tolist(), means.tolist()):
        pools.append([w, m, 1])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            w2, m2, n2 = pools.pop()
            w1, m1, n1 = pools[-1]
            pools[-1] = [w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2]
    return np.concatenate([np.full(int(n), m) for _, m, n in pools]) if pools else np.zeros(0)


def fit(train: DataFrame, x: str, y: str, features: int = 128, gamma: float = 0.05, ridge: float = 1e-3, seed: int = 7) -> Model:
    """Fits a model to all rows of ``train``: ``x`` is an array of doubles, ``y`` is 0 or 1."""
    n = len(_STATISTICS)
    row = train.agg(
        F.count(F.lit(1)).alias("n"), *(F.avg(F.col(x)[k]).alias(f"m{k}") for k in range(n)), *(F.stddev_pop(F.col(x)[k]).alias(f"s{k}") for k in range(n)),
    ).first()
    random = np.random.default_rng(seed)
    model = Model(
        np.array([row[f"m{k}"] or 0.0 for k in range(n)]), np.array([row[f"s{k}"] or 1.0 for k in range(n)]),
        random.normal(0, np.sqrt(2 * gamma), (n, features)), random.uniform(0, 2 * np.pi, features),
    )
    if not row["n"]:
        return model
    width = features + 2  # the features, the constant, and the label

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                z = np.hstack([model.features(np.stack(batch["x"].to_numpy())), batch["y"].to_numpy(dtype=float)[:, None]])
                total += z.T @ z
        yield pd.DataFrame({"i": range(width), "row": list(total)})

    shares = train.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y")).mapInPandas(sums, "i int, row array<double>")
    added = shares.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((width, width))
    for i, j, v in added:
        total[i, j] = v
    z, target = total[:-1, :-1], total[:-1, -1]
    model.weights = np.linalg.solve(z + ridge * row["n"] * np.diag([1.0] * features + [0.0]) / features + 1e-9 * np.eye(features + 1), target)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                raw = np.clip(model.raw(np.stack(batch["x"].to_numpy())), -0.5, 1.5)
                yield pd.DataFrame({"cell": np.round((raw + 0.5) / 2 * CELLS).astype(int), "y": batch["y"]})

    counted = (
        train.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y")).mapInPandas(cells, "cell int, y double")
        .groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean")).orderBy("cell").collect()
    )
    model.grid = np.array([c["cell"] for c in counted]) / CELLS * 2 - 0.5
    model.calibrated = isotonic(np.array([float(c["n"]) for c in counted]), np.array([c["mean"] for c in counted]))
    return model


def with_scores(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", score: str = "score", held_out: str = "held_out",
    threshold: float = 0.3, predicted: str = "predicted", keep_text: bool = True,
) -> DataFrame:
    """All columns of ``docs`` and ``held_out``, ``score``, ``predicted``; columns of these names are replaced.

    A document is held out if crc32 of its key as text leaves no remainder by 5 (a NULL key counts as empty text); labels of
    held-out documents are not used. The statistics are written to the checkpoint folder once, for fitting and, unless the
    texts are to be kept as well, for scoring; with the texts they are computed again while these are read again.
    """
    out = {c.lower() for c in (score, held_out, predicted)} | (set() if keep_text else {text.lower()})
    rest = [c for c in docs.columns if c.lower() not in out]
    (x,) = fresh(docs, "statistics")
    held = F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    stats = docs.select(*(f"`{c}`" for c in rest), F.array(*statistics(F.col(f"`{text}`"))).alias(x), held.alias(held_out))
    if not keep_text:
        stats = cut(stats)
    learn = stats.select(F.col(f"`{key}`").alias("k"), F.col(x).alias("x"), F.col(held_out).alias("h"))
    known_labels = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).where("k IS NOT NULL AND y IN (0, 1)").groupBy("k").agg(F.min("y").alias("y"))
    model = fit(cut(learn.where(~F.col("h")).join(known_labels, "k").select("x", "y")), "x", "y")

    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series(model.score(np.stack(values.to_numpy())) if len(values) else np.zeros(0))

    scored = stats.select(*(f"`{c}`" for c in rest), held_out, F.pandas_udf(apply, "double")(F.col(x)).alias(score))
    return scored.withColumn(predicted, F.when(F.col(score) >= threshold, 1).otherwise(0))
