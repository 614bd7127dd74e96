"""Quality classifier by co-training on two views of a document.

The text view sees the text only: hashed byte trigrams. The metadata view sees the fields beside the text and never the
text: source, language, both together, and the length that the table states. Each view is a logistic regression, fitted on
labelled rows and calibrated (Platt) on labelled rows that take no part in training. In every round both views score all documents
without a label, as a Spark job; each labels the ``PER_ROUND`` it is surest of, for each class in proportion to the
classes, and hands them to the other view. A view is sure where its calibrated probability is ``SURE`` or more, and would
be if classes were equally frequent: a view that knows nothing, or just which class is frequent, hands on nothing. At the
end the calibrated log odds of both are combined by a third regression on those rows. All documents are scored.

Fitting uses ``LABELLED`` labelled rows at most, half of each class as far as there are (the smallest hashes of their
ids); calibration weighs them back to the shares of all labels. With what the rounds hand over, a fit has
``LABELLED + 2 * ROUNDS * PER_ROUND`` rows in one task, whatever the input.

Defined results
---------------
* Scores are probabilities of quality 1. A null text is the empty text. A null source, language or length is a value of
  its own; a table without such a column has nulls.
* Several labels of one document count as the one that most of them give (1 on a tie). Null labels are ignored. Of rows
  that repeat a labelled doc_id one is learned from: that with the smallest hash of its text.
* With fewer than ten labels of either class every score is the share of quality 1 among the labels (0.5
  without labels).
* Ties between equally sure documents go to the smaller doc_id; sureness counts to six digits.
* Whole texts are read, however long. Each row is scored, repeated rows alike; extra columns are left out; no documents
  give no rows.
"""

from __future__ import annotations

import pickle
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .minhash_dedup import mix64

LABELLED = 8000
ROUNDS = 3
PER_ROUND = 400
#: A view only hands on what it is this sure of.
SURE = 0.9
TEXT_DIMS = 2048
_SOURCES, _LANGS, _BOTH, _SIZES = 32, 16, 64, 16
META_DIMS = _SOURCES + _LANGS + _BOTH + _SIZES + 2


def text_features(raw: bytes) -> np.ndarray:
    """Square roots of hashed byte-trigram counts, of unit length."""
    data = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(TEXT_DIMS, np.float32)
    grams = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761) >> np.uint32(21)
    counts = np.sqrt(np.bincount(grams, minlength=TEXT_DIMS)).astype(np.float32)
    return counts / np.linalg.norm(counts)


def _slot(value: str | None, slots: int) -> int:
    raw = b"\0" if value is None else value.encode()
    folded = sum((b + 1) * pow(31, i, 1 << 32) for i, b in enumerate(raw[:64])) % (1 << 32)
    return int(mix64(np.array([folded], np.uint64))[0] % np.uint64(slots))


def meta_features(source: str | None, lang: str | None, n_chars: float | None) -> np.ndarray:
    """What the fields beside the text say."""
    out = np.zeros(META_DIMS, np.float32)
    at = 0
    both = None if source is None and lang is None else f"{source}\n{lang}"
    for value, slots in ((source, _SOURCES), (lang, _LANGS), (both, _BOTH)):
        out[at + _slot(value, slots)] = 1
        at += slots
    if n_chars is None or not n_chars >= 0:
        out[-1] = 1
    else:
        size = min(np.log2(1 + n_chars), _SIZES - 1)
        out[at + int(size)] = 1
        out[-2] = size / 10
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 80, rate: float = 0.3) -> np.ndarray:
    """Weights and, last, the bias; classes count alike. Adam on all rows."""
    w = np.zeros(x.shape[1] + 1, np.float64)
    m, v = np.zeros_like(w), np.zeros_like(w)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for t in range(1, steps + 1):
        off = weight * (sigmoid(x @ w[:-1].astype(x.dtype) + w[-1]) - y)
        grad = np.append(off.astype(x.dtype) @ x + penalty * w[:-1], off.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1].astype(x.dtype) + w[-1]


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slope and offset of calibrated log odds, with smoothed targets; Newton steps that never overshoot."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    unit = max(float(np.std(z)), 1e-9)
    x, a = np.stack([z / unit, np.ones_like(z)], 1), np.zeros(2)

    def loss(a):
        m = x @ a
        return (weight * (np.logaddexp(0, m) - target * m)).sum() + 0.05 * a[0] ** 2

    for _ in range(30):
        p = sigmoid(x @ a)
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([0.1, 1e-6])
        step = np.linalg.solve(hessian, x.T @ (weight * (p - target)) + np.array([0.1 * a[0], 0.0]))
        while loss(a - step) > loss(a) and np.abs(step).max() > 1e-9:
            step = step / 2
        a = a - step
    return a / np.array([unit, 1.0])


def calibration_rows(y: np.ndarray) -> np.ndarray:
    """Every fifth labelled row of each class: for calibration, not for training."""
    check = np.zeros(len(y), bool)
    for c in (0, 1):
        check[np.flatnonzero(y == c)[::5]] = True
    return check


def fit_views(views, y: np.ndarray, handed: np.ndarray, shares: tuple[float, float]) -> dict:
    """Weights and calibration of both views. ``y``: labels; ``handed``: the view a row was handed to, or -1 for labelled
    rows; ``shares``: those of the classes among all labels."""
    check = calibration_rows(np.where(handed < 0, y, -1))
    rows = [~check & ((handed < 0) | (handed == v)) for v in (0, 1)]
    weights = [fit_logistic(x[r], y[r].astype(np.float64)) for x, r in zip(views, rows)]
    of = y[check]
    weight = np.where(of == 1, shares[1] / (of == 1).mean(), shares[0] / (of == 0).mean())
    scales = [platt(log_odds(x[check], w), of, weight) for x, w in zip(views, weights)]
    both = np.stack(calibrated(views, weights, scales), 1)[check]
    joint = fit_logistic(both, of.astype(np.float64), penalty=1e-2, steps=200, rate=0.05)
    return {"weights": weights, "scales": scales, "joint": joint, "last": platt(log_odds(both, joint), of, weight), "shares": shares}


def calibrated(views, weights, scales) -> list[np.ndarray]:
    """The calibrated log odds of each view."""
    return [log_odds(x, w).astype(np.float64) * s[0] + s[1] for x, w, s in zip(views, weights, scales)]


def sureness(views, model: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each view how sure it is of class 0 and of class 1, to six digits."""
    prior = np.log(model["shares"][1] / model["shares"][0])
    out = []
    for z in calibrated(views, model["weights"], model["scales"]):
        p, even = sigmoid(z), sigmoid(z - prior)
        out.append((np.round(1 - np.maximum(p, even), 6), np.round(np.minimum(p, even), 6)))
    return out


def score(model: dict, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, text view's score, metadata view's score)."""
    if "weights" not in model:
        same = np.full(len(text), model["share"])
        return same, same, same
    both = np.stack(calibrated((text, meta), model["weights"], model["scales"]), 1)
    z = log_odds(both, model["joint"])
    return sigmoid(z * model["last"][0] + model["last"][1]), sigmoid(both[:, 0]), sigmoid(both[:, 1])


def _views(texts, sources, langs, sizes) -> tuple[np.ndarray, np.ndarray]:
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    text = np.array([text_features(r) for r in raws]).reshape(-1, TEXT_DIMS)
    return text, np.array(list(map(meta_features, sources, langs, sizes))).reshape(-1, META_DIMS)


_FIELDS = ["text", "source", "lang", "n_chars"]


def _fields(docs: DataFrame, id_col: str) -> DataFrame:
    """(doc_id, text, source, lang, n_chars)."""
    kinds = {"text": "string", "source": "string", "lang": "string", "n_chars": "double"}
    has = set(docs.columns)
    return docs.select(F.col(id_col).alias("doc_id"), *((F.col(c) if c in has else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))


def _features(rows: DataFrame, schema: str) -> DataFrame:
    """(doc_id, y, handed) of ``rows`` with the features of both views, one row for each doc_id."""
    one = rows.groupBy("doc_id", "y", "handed").agg(F.min_by(F.struct(*_FIELDS), F.xxhash64("text")).alias("f"))

    def run(batches):
        for part in chain.from_iterable(map(slices, batches)):
            columns = [part.column(i).to_pylist() for i in range(3, 7)]
            features = [pa.array([row.tobytes() for row in x], pa.binary()) for x in _views(*columns)]
            yield pa.RecordBatch.from_arrays([*map(part.column, range(3)), *features], ["doc_id", "y", "handed", "t", "m"])

    return one.select("doc_id", "y", "handed", "f.*").mapInArrow(run, schema)


def _fitted(train: DataFrame, make) -> object:
    """What ``make(views, y, handed)`` gives for the rows of ``train``, a bounded number, in one task."""

    def run(batches):
        rows = pd.concat(list(batches)).sort_values(["handed", "doc_id"])
        views = [np.frombuffer(b"".join(rows[c]), np.float32).reshape(len(rows), -1) for c in ("t", "m")]
        yield pd.DataFrame({"model": [pickle.dumps(make(views, rows["y"].to_numpy(), rows["handed"].to_numpy()))]})

    return pickle.loads(train.repartition(1).mapInPandas(run, "model binary").first().model)


def _sure(rows: DataFrame, model: dict) -> DataFrame:
    """(doc_id, text_hash, s00, s01, s10, s11): how sure each view is of each class, for every document."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in chain.from_iterable(map(slices, batches)):
            found = sureness(_views(*(part.column(i).to_pylist() for i in range(2, 6))), shared.value)
            columns = [pa.array(s) for view in found for s in view]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["doc_id", "text_hash", "s00", "s01", "s10", "s11"])

    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, text_hash long, s00 double, s01 double, s10 double, s11 double"
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), *_FIELDS).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> dict:
    """The model; ``docs`` as :func:`_fields` gives it and ``labels`` doc_id, quality."""
    known = written(
        labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y")),
        "quality-labels",
    )
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    few = [known.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max(labelled // 2, labelled - counts.get(1 - c, 0))) for c in (0, 1)]
    few = few[0].unionByName(few[1]).withColumn("handed", F.lit(-1))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, y int, handed int, t binary, m binary"
    train = written(_features(docs.join(F.broadcast(few), "doc_id"), schema), "quality-rows")  # labelled rows at most
    by_class = {r.y: r.n for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(by_class.get(0, 0), by_class.get(1, 0)) < 10:
        return {"share": share}
    shares = (1 - share, share)

    def views_of(views, y, handed):
        return fit_views(views, y, handed, shares)

    model, picked = _fitted(train, views_of), known.select("doc_id").limit(0).withColumn("handed", F.lit(0))
    for _ in range(rounds):
        sure = _sure(docs.where("doc_id is not null"), model).where(f"greatest(s00, s01, s10, s11) >= {SURE}")
        sure = written(sure.join(known.hint("merge"), "doc_id", "left_anti"), "quality-sure")
        picks = None
        for view in (0, 1):
            free = sure.join(F.broadcast(picked.where(F.col("handed") == 1 - view)), "doc_id", "left_anti")
            for c in (0, 1):
                s = F.col(f"s{view}{c}")
                best = free.where(s >= SURE).groupBy("doc_id").agg(F.max(F.struct(s.alias("s"), "text_hash")).alias("b"))
                best = best.orderBy(F.desc("b.s"), "doc_id").limit(max(1, round(per_round * shares[c])))
                best = best.select("doc_id", "b.text_hash", F.lit(c).alias("y"), F.lit(1 - view).alias("handed"))
                picks = best if picks is None else picks.unionByName(best)
        picks = written(picks, "quality-picks")  # 2 * per_round rows or so
        if not picks.head(1):
            break
        picked = picked.unionByName(picks.select("doc_id", "handed"))
        chosen = docs.withColumn("text_hash", F.xxhash64("text")).join(F.broadcast(picks), ["doc_id", "text_hash"])
        train = train.unionByName(written(_features(chosen, schema), "quality-rows"))
        model = _fitted(train, views_of)
    return {"share": share} | model


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", labelled: int = LABELLED, rounds: int = ROUNDS, per_round: int = PER_ROUND
) -> DataFrame:
    """(doc_id, score, text_score, meta_score, kept) of every row of ``docs``; ``kept``: the score is 0.5 or more."""
    rows = _fields(docs, id_col)
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, labelled, rounds, per_round))  # TEXT_DIMS + META_DIMS weights

    def run(batches):
        for part in chain.from_iterable(map(slices, batches)):
            found = score(shared.value, *_views(*(part.column(i).to_pylist() for i in range(1, 5))))
            columns = [part.column(0), *(pa.array(x.astype(np.float64)) for x in found), pa.array(found[0] >= 0.5)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "text_score", "meta_score", "kept"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, text_score double, meta_score double, kept boolean")
