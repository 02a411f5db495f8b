"""Quality classifier by positive-unlabelled learning.

A linear model over hashed byte trigrams and a few figures of a text's words
minimises the non-negative unbiased risk of trusted positives and unlabelled
text under a class prior that is itself estimated from the unlabelled text.
The logistic loss makes the margin a log odds, so its sigmoid is the score: no
labelled negative is used anywhere.

The fit uses bounded samples: at most SAMPLE rows each of positives and of
unlabelled text, those with the smallest hash of the id.  Everything else
covers every whole text.

Cases.  A null or empty text has only its bias and word figures and still gets
a score; a null id is held out by the empty text's crc32 and isn't learnt from;
repeated rows are scored alike, and of rows that share an id that with the
smallest text is learnt from; an id is positive if any of its labels is 1; with
no trusted positive there is nothing to learn and every score is 0.5; an empty
table gives an empty result.  Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tessera.llm.runtime import held_out, table, written

SAMPLE = 4000
BINS = 2048
DENSE = 6
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7


def features(text: str | None) -> np.ndarray:
    """BINS square roots of trigram counts at unit length, then DENSE word figures."""
    out = np.zeros(BINS + DENSE, np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) >= 3:
        h = ((b[:-2] * np.uint32(65599) + b[1:-1]) * np.uint32(65599) + b[2:]) * np.uint32(2654435761) >> np.uint32(21)
        grams = np.sqrt(np.bincount(h, minlength=BINS))
        out[:BINS] = grams / np.linalg.norm(grams)
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    upper = np.count_nonzero((b >= 65) & (b <= 90)) / size
    marks = np.count_nonzero((b > 32) & (b < 48) | (b > 57) & (b < 65) | (b > 90) & (b < 97) | (b > 122) & (b < 127)) / size
    repeated = sum(map(eq, words, words[1:])) / max(1, n - 1)
    out[BINS:] = repeated, 1 - len(set(words)) / max(1, n) ** 0.9, upper, marks, 1 / (1 + n), np.log1p(n) / 10
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def pu_gradient(positive: np.ndarray, unlabelled: np.ndarray, prior: float, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
    """Gradient of the risk in weights and bias; of minus its second term while that is negative.

    Risk: prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]), l the logistic loss.
    """
    zp, zu = positive @ w + b, unlabelled @ w + b
    sp, su = sigmoid(zp), sigmoid(zu)
    gp, gu = -prior * sp / len(positive), su / len(unlabelled)
    if np.logaddexp(0, zu).mean() < prior * np.logaddexp(0, zp).mean():
        gp, gu = -gp, -gu
    else:
        gp = gp + prior * (sp - 1) / len(positive)
    return gp.astype(np.float32) @ positive + gu.astype(np.float32) @ unlabelled, float(gp.sum() + gu.sum())


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 20.0, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative risk, by gradient steps of falling pace."""
    w, b = np.zeros(positive.shape[1], np.float32), 0.0
    for step in range(steps):
        gw, gb = pu_gradient(positive, unlabelled, prior, w, b)
        pace = rate / (1 + step / 100)
        w -= pace * (gw + decay * w)
        b -= 0.1 * pace * gb
    return w, b


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, folds: int = 2) -> float:
    """Share of positives among the unlabelled, by the best bin.

    On held-out folds of a first classifier's margins: above any threshold the
    unlabelled text holds at least prior times the positives' share, so the
    ratio of the two shares bounds the prior from above.  The threshold taken
    has the least ratio once a margin for its sampling error is added.
    """
    found = []
    for fold in range(folds):
        p, u = (np.arange(len(x)) % folds == fold for x in (positive, unlabelled))
        w, b = fit_pu(positive[~p], unlabelled[~u], 0.5)
        zp, zu = np.sort(positive[p] @ w + b), np.sort(unlabelled[u] @ w + b)
        cut = np.quantile(zp, np.linspace(0, 0.95, 200))
        own, all_ = 1 - np.searchsorted(zp, cut) / len(zp), 1 - np.searchsorted(zu, cut) / len(zu)
        error = (np.log(40) / 2) ** 0.5 * (len(zp) ** -0.5 + len(zu) ** -0.5)
        at = int(np.argmin((all_ + error) / own))
        found.append(all_[at] / own[at])
    return float(np.clip(np.mean(found), 0.03, 0.97))


def feature_rows(texts: pa.Array) -> np.ndarray:
    return np.stack([features(t.as_py()) for t in texts]) if len(texts) else np.zeros((0, BINS + DENSE), np.float32)


def _features_of(rows: DataFrame) -> DataFrame:
    """rows(text, kind) -> their features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [row.tobytes() for row in feature_rows(b.column(0)).astype(np.float16)]
            yield pa.record_batch([pa.array(x, pa.binary()), b.column(1)], ["x", "kind"])

    return rows.mapInArrow(run, "x binary, kind int")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float] | None:
    """The model from rows outside the held-out fold; None without a trusted positive."""
    ids = docs.where(~held_out(id_col, FOLDS, HELD_OUT)).select(F.col(id_col).alias("id")).where("id is not null").distinct()
    trusted = labels.where(F.col(label_col).cast("int") == 1).select(F.col(id_col).alias("id")).distinct().join(ids, "id", "left_semi")
    # kinds 1: a trusted positive; 0: unlabelled text
    trusted = trusted.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(sample).select("id", F.lit(1).alias("kind"))
    unlabelled = ids.orderBy(F.xxhash64("id", F.lit(13)), "id").limit(sample).select("id", F.lit(0).alias("kind"))
    wanted = written(trusted.unionAll(unlabelled), "wanted")
    # 2 * sample ids at most: small whatever the tables hold; one row of each, however often it is repeated
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(wanted), "id")
    got = _features_of(rows.groupBy("id", "kind").agg(F.min("text").alias("text")).select("text", "kind")).toArrow()
    kind = got["kind"].to_numpy()
    if not (kind == 1).any():
        return None
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(-1, BINS + DENSE).astype(np.float32)
    order = np.lexsort((x @ np.cos(np.arange(BINS + DENSE, dtype=np.float32)), kind))  # what follows doesn't depend on the order of arrival
    x, kind = x[order], kind[order]
    mixed = np.random.default_rng(3).permutation(len(x))  # so that folds aren't cut along the order
    positive, unlabelled = x[mixed][kind[mixed] == 1], x[mixed][kind[mixed] == 0]
    prior = estimate_prior(positive, unlabelled) if min(len(positive), len(unlabelled)) > 1 else 0.5
    return fit_pu(positive, unlabelled, prior)


def score_column(docs: DataFrame, model: tuple[np.ndarray, float] | None, text_col: str = "text", score: str = "score") -> DataFrame:
    """docs with a last column score."""
    if model is None:
        return docs.withColumn(score, F.lit(0.5))
    w, bias = model[0].astype(np.float64), model[1]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = sigmoid(feature_rows(b.column(at)).astype(np.float64) @ w + bias)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, score])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(score, DoubleType()))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row of docs."""
    scored = score_column(docs.select(id_col, text_col), fit(docs, labels, id_col=id_col, text_col=text_col), text_col)
    return scored.select(id_col, held_out(id_col, FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are predicted good; all of them if there is nothing to learn from."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    if model is None:
        return docs
    score = "score_" + "_".join(docs.columns)  # no column of docs has that name
    return score_column(docs, model, text_col, score).where(F.col(f"`{score}`") >= THRESHOLD).select(docs.columns)


def op4_pu_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
