"""Quality scores by Bradley-Terry pairwise ranking.

Preference pairs set every good document against every bad one; weights minimise
the logistic loss of the pairs' feature differences; a quantile of the scores is
the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import forget, materialize, training_rows, trimmed

N_FEATURES = 12
#: More labelled ids are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bins of the score and their width; the outermost take all beyond.
BINS, BIN = 1024, 1 / 16
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
_DIGITS = str.maketrans("", "", "0123456789")
_ENDS = str.maketrans("", "", ".,;:?")


def text_features(text: str) -> list[float]:
    """Shares and rates of the whole text, none of which depends on its language."""
    words = _WORD.findall(text)
    n, size = len(words), max(1, len(text))
    if not n:
        return [0.0] * (N_FEATURES - 1) + [1.0]
    lower, upper = text.lower(), text.upper()
    raised = 0.0 if lower == upper else sum(map(str.__ne__, text, lower)) / size if len(lower) == size else 0.0
    repeats = sum(map(str.__eq__, words, words[1:])) / n
    seen = len(set(zip(words, words[1:], words[2:])))
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        raised,
        (size - len(text.translate(_SYMBOLS))) / size,
        min(1.0, text.count("!") / n),
        repeats,
        1.0 - seen / max(1, n - 2) if n > 2 else 0.0,
        sum(w == "|" for w in words) / n,
        min(30.0, sum(map(len, words)) / n),
        (size - len(text.translate(_DIGITS))) / size,
        min(1.0, (size - len(text.translate(_ENDS))) / n),
        float(np.log1p(n)),
        1.0 - len(set(lines)) / max(1, len(lines)),
        0.0,
    ]


def _scores(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Row by row, so that a row's score is the same to the last digit in any batch."""
    return ((x - mean) / scale * w).sum(1)


@dataclass(frozen=True)
class Ranking:
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    threshold: float
    slope: float

    def probability(self, x: np.ndarray, at: float) -> np.ndarray:
        """Scores in 0..1; the threshold's score maps to ``at``."""
        z = _scores(x, np.array(self.mean), np.array(self.scale), np.array(self.weights))
        z = np.clip((z - self.threshold) * self.slope + np.log(at / (1 - at)), -30, 30)
        return 1 / (1 + np.exp(-z))


def with_features(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the text's ``_features``, which ``fit`` and ``score_quality`` then take in place of the text."""
    schema = rows.select(*keep).schema.add("_features", ArrayType(DoubleType()))
    names = [*keep, "_features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [text_features(t.as_py() or "") for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(x, pa.list_(pa.float64()))], names)

    return rows.select(*keep, F.col("text").cast("string").alias("_scored_text")).mapInArrow(trimmed(run), schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)


def _stable(x: np.ndarray) -> np.ndarray:
    """Ten digits: sums come in any order, results don't depend on it."""
    return np.array([float(f"{v:.9e}") for v in x])


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(good, _features)`` of every labelled document, written once for the passes below."""
    rows = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").alias("_id"), "quality").distinct()
    few = rows.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    body = "_features" if "_features" in docs.columns else "text"
    known = docs.select("doc_id", body).join(F.broadcast(rows) if few else rows, F.col("doc_id") == F.col("_id"))
    if body == "text":
        known = with_features(known, ["doc_id", "quality"])
    known = known.groupBy("doc_id", "quality").agg(F.min("_features").alias("_features"))
    return materialize(known.select((F.col("quality") > 0).alias("good"), "_features"), "labelled")


def _bins(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the good and of the bad rows, a line for each bin of the score: rows, sums of features, of their products."""
    upper = np.triu_indices(N_FEATURES)
    width = 1 + N_FEATURES + len(upper[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2 * BINS, width))
        for b in batches:
            z = (_matrix(b.column("_features")) - mean) / scale
            at = np.clip(np.floor((z @ w) / BIN) + BINS // 2, 0, BINS - 1).astype(int)
            at += BINS * b.column("good").to_numpy(zero_copy_only=False).astype(int)
            for j, x in enumerate((np.ones(len(z)), *z.T, *(z[:, i] * z[:, k] for i, k in zip(*upper)))):
                sums[:, j] += np.bincount(at, x, 2 * BINS)
        used = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(c) for c in sums[used].T)], ["bin", *(f"s{j}" for j in range(width))])

    parts = rows.mapInArrow(trimmed(run), ", ".join(["bin long", *(f"s{j} double" for j in range(width))]))
    got = parts.groupBy("bin").agg(*(F.sum(f"s{j}").alias(f"s{j}") for j in range(width))).toPandas().sort_values("bin").to_numpy()
    return got[got[:, 0] >= BINS, 1:], got[got[:, 0] < BINS, 1:]


def _pair_loss(good: np.ndarray, bad: np.ndarray, w: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian over all pairs of a good and a bad row; a bin's rows stand at their mean score."""
    n = N_FEATURES
    upper = np.triu_indices(n)
    (ng, zg, qg), (nb, zb, qb) = ((x[:, 0], x[:, 1 : n + 1], x[:, n + 1 :]) for x in (good, bad))
    d = np.clip((zg @ w / ng)[:, None] - (zb @ w / nb)[None, :], -500, 500)
    p = 1 / (1 + np.exp(d))
    pairs = ng.sum() * nb.sum()
    loss = ng @ np.logaddexp(0, -d) @ nb / pairs + ridge * (w @ w) / 2
    grad = -(zg.T @ (p @ nb) - zb.T @ (p.T @ ng)) / pairs + ridge * w
    q = p * (1 - p)
    squares = np.zeros((n, n))
    squares[upper] = qg.T @ (q @ nb) + qb.T @ (q.T @ ng)
    squares = squares + np.triu(squares, 1).T
    cross = zg.T @ q @ zb
    return loss, grad, (squares - cross - cross.T) / pairs + ridge * np.eye(n)


def order_statistics(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, wanted: list[tuple[bool | None, int]]) -> list[float]:
    """For each (label, or None for all; rank from 0) the score of that rank: counts by bins, then within the rank's bin."""
    span, found = [(-np.inf, np.inf)] * len(wanted), {}
    rank = [k for _, k in wanted]
    while len(found) < len(wanted):
        todo = [(t, wanted[t][0], *span[t]) for t in range(len(wanted)) if t not in found]

        def run(batches: Iterator[pa.RecordBatch], todo: list = todo) -> Iterator[pa.RecordBatch]:
            n = {t: np.zeros(BINS, np.int64) for t, *_ in todo}
            low, high = ({t: np.full(BINS, x) for t in n} for x in (np.inf, -np.inf))
            for b in batches:
                s = _scores(_matrix(b.column("_features")), mean, scale, w)
                good = b.column("good").to_numpy(zero_copy_only=False)
                for t, label, lo, hi in todo:
                    x = s[(s >= lo) & (s <= hi) & (True if label is None else good == label)]
                    at = np.floor(x / BIN) + BINS // 2 if np.isinf(lo) else (x - lo) / (hi - lo) * BINS
                    at = np.clip(at, 0, BINS - 1).astype(int)
                    np.add.at(n[t], at, 1)
                    np.minimum.at(low[t], at, x)
                    np.maximum.at(high[t], at, x)
            for t in n:
                used = np.flatnonzero(n[t])
                cols = (np.full(len(used), t), used, n[t][used], low[t][used], high[t][used])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["t", "bin", "n", "low", "high"])

        parts = rows.mapInArrow(trimmed(run), "t long, bin long, n long, low double, high double")
        got = parts.groupBy("t", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
        for t, *_ in todo:
            mine = got[got["t"] == t].sort_values("bin")
            to = mine["n"].cumsum().to_numpy()
            i = int(np.searchsorted(to, rank[t], side="right"))
            rank[t] -= int(to[i - 1]) if i else 0
            span[t] = float(mine["low"].iloc[i]), float(mine["high"].iloc[i])
            if span[t][0] == span[t][1]:
                found[t] = span[t][0]
    return [found[t] for t in range(len(wanted))]


def fit(docs: DataFrame, labels: DataFrame, steps: int = 50, ridge: float = 1e-3) -> Ranking:
    """Learn from every labelled row, by every pair of a good and a bad one.

    A step is one pass over the features.  As the loss of a pair depends on the two
    scores, rows are summed by bins of the score, a sixteenth wide, and the sums are
    paired: all pairs count, at the mean score of their bins.  Of documents that
    repeat an id the least features count, of labels that differ each teaches.  Rows
    with null labels teach nothing.  Where one label is missing there is no pair, and
    every document gets the weight of the label there is.
    """
    rows = _labelled(docs, labels)
    x = [F.col("_features")[i] for i in range(N_FEATURES)]
    n, n_good, *moments = rows.agg(F.count("*"), F.sum(F.col("good").cast("long")), *map(F.avg, x), *map(F.stddev_pop, x)).first()
    if not n or n_good in (0, n):
        forget(rows)
        return Ranking((0.0,) * N_FEATURES, (0.0,) * N_FEATURES, (1.0,) * N_FEATURES, 1.0 if n and not n_good else -1.0, 3.0)
    mean, scale = _stable(moments[:N_FEATURES]), _stable(moments[N_FEATURES:])
    scale[scale < 1e-9] = 1.0
    w, move = np.zeros(N_FEATURES), np.zeros(N_FEATURES)
    best = np.inf
    for _ in range(steps):  # Newton steps on the convex pair loss, halved where they lead up
        loss, grad, hess = _pair_loss(*_bins(rows, mean, scale, w), w, ridge)
        if loss > best * (1 + 1e-6):
            move = move / 2
            w = w + move
        else:
            best, move = loss, np.linalg.solve(hess, grad)
            w = w - move
        if np.abs(move).max() < 1e-3:
            break
    w = _stable(w)
    n_bad = n - n_good
    wanted = [(None, n_bad - 1), (None, n_bad), (True, (n_good - 1) // 2), (False, (n_bad - 1) // 2)]
    below, above, good, bad = order_statistics(rows, mean, scale, w, wanted)
    forget(rows)
    slope = 4.0 / max(1e-6, good - bad)
    return Ranking(tuple(w), tuple(mean), tuple(scale), (below + above) / 2, max(slope, 1e-3))


def score_quality(docs: DataFrame, ranking: Ranking, at: float = 0.3, with_text: bool = False) -> DataFrame:
    """``docs``' columns, ``score`` and ``predicted`` (score >= ``at``), in one pass.

    A null or blank text has no feature but the mark of emptiness and is scored by
    it.  Ids, languages and sources are no inputs.  Columns of these two names are
    replaced; repeated rows are scored alike; no row gives no row.
    """
    known = "_features" in docs.columns
    keep = [c for c in docs.columns if c not in ("score", "predicted", "_features") and (with_text or c != "text")]
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")
    # a text that is kept anyway travels once
    rows = docs.select(*keep, "_features") if known else docs.select(*keep) if dict(docs.select(*keep).dtypes).get("text") == "string" else docs.select(*keep, F.col("text").cast("string").alias("_scored_text"))
    scored = rows.columns.index("text") if rows.columns == keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(scored)) if known else np.array([text_features(t.as_py() or "") for t in b.column(scored)]).reshape(-1, N_FEATURES)
            p = ranking.probability(x, at)
            cols = [*(b.column(k) for k in keep), pa.array(p), pa.array((p >= at).astype("int32"))]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "score", "predicted"])

    return rows.mapInArrow(trimmed(run), schema)


def label_split(labels: DataFrame, modulus: int = 5) -> DataFrame:
    """The labelled rows that may be learned from."""
    return labels.where(training_rows("doc_id", modulus) != 0)
