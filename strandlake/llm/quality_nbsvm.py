"""Document quality by a naive Bayes support vector machine.

A text becomes the set of its n-grams: tokens are runs of letters, of digits or of other visible bytes; n-grams are
single tokens and pairs (lower-cased A-Z), pairs and triples of token shapes, and a mark for a token that comes twice
in a row. Each n-gram is hashed to one of DIM places. A place's value is the ratio of its smoothed log counts in the
two classes, divided by the root of the set's size; a linear model is fitted to these by dual coordinate descent on the
hinge loss, and its margin becomes a score by a logistic curve fitted to rows that the descent did not see.

The model learns from a sample of the labelled rows, drawn by a hash of the id and bounded by TRAIN_ROWS; scoring
covers every row. Null and empty texts have no n-grams and get the score of the bias alone. Rows with a null label
teach nothing; with labels of one class only, that class's share decides for every row; an id with several labels has the
greatest. Repeated rows are scored each and, where labelled, learned each; ties of score are left as they are; extra
columns are ignored, texts of any length are read whole, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.bytesets import LOWER, SPACE, U, Texts, mix, span_hashes, texts

DIM = 1 << 18
#: Labelled rows at most that the model is fitted on (in expectation).
TRAIN_ROWS = 6000
EPOCHS = 12
COST = 1.0
_CLASS = np.full(256, 3, np.uint8)
_CLASS[SPACE] = 0
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2
_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1


def ngram_sets(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places of each text's n-grams, and offsets by text."""
    kind = _CLASS[t.data]
    change = np.ones(len(kind), bool)
    change[1:] = kind[1:] != kind[:-1]
    edge = t.offs[1:-1]
    change[edge[edge < len(kind)]] = True
    at = np.flatnonzero(change)
    end = np.append(at[1:], len(kind))
    ok = kind[at] > 0
    start, end = at[ok], end[ok]
    first = np.searchsorted(start, t.offs)
    h = span_hashes(LOWER[t.data], start, end)
    caps = np.concatenate([[0], np.cumsum(_UPPER[t.data])])
    caps, size = caps[end] - caps[start], end - start
    shape = np.where(kind[start] > 1, kind[start].astype(np.int64) + 3, np.where(caps == 0, 0, np.where((caps == size) & (size > 1), 1, np.where(caps == 1, 2, 3)))).astype(U)
    doc = np.searchsorted(first, np.arange(len(start)), "right") - 1
    two = np.flatnonzero(doc[1:] == doc[:-1])
    three = two[:-1][two[1:] == two[:-1] + 1] if len(two) > 1 else two[:0]
    grams = [
        (doc, h),
        (doc[two], mix(h[two] * U(31) + h[two + 1])),
        (doc[two], mix(U(1) + shape[two] * U(64) + shape[two + 1])),
        (doc[three], mix(U(2) + (shape[three] * U(64) + shape[three + 1]) * U(64) + shape[three + 2])),
    ]
    again = two[h[two] == h[two + 1]]
    grams.append((doc[again], np.full(len(again), 3, U)))
    owner = np.concatenate([a for a, _ in grams])
    place = np.concatenate([(b >> U(40)).astype(np.int64) % DIM for _, b in grams])
    key = np.unique(owner * DIM + place)
    return (key % DIM).astype(np.int32), np.searchsorted(key, np.arange(t.n + 1) * DIM)


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, places: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = np.diff(offs)
        full = np.flatnonzero(n)
        margin = np.full(len(n), self.bias)
        if len(full):
            margin[full] += np.add.reduceat(self.weight[places], offs[full], dtype=np.float64) / np.sqrt(n[full])
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def descend(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss; the bias is a constant column."""
    w, bias = np.zeros(DIM), 0.0
    alpha = np.zeros(len(rows))
    values = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    square = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(8)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), COST)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve by Newton steps; targets are smoothed, so separable rows do no harm."""
    up = (y > 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (len(y) - up + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, q = p - target, p * (1 - p) + 1e-9
        ga, gb = (d * margin).sum() + 1e-3 * a, d.sum()
        haa, hab, hbb = (q * margin * margin).sum() + 1e-3, (q * margin).sum(), q.sum() + 1e-9
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    return (a, b) if a > 0 and np.isfinite([a, b]).all() else (1.0, 0.0)


def fit_rows(rows: list[np.ndarray], label: np.ndarray) -> Model:
    y = np.where(label > 0, 1.0, -1.0)
    if not len(y) or (y > 0).all() or (y < 0).all():
        share = 0.5 if not len(y) else float((y > 0).mean())
        return Model(np.zeros(DIM, np.float32), 0.0, 1.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    check = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    learn = np.flatnonzero(~check)
    counts = [1.0 + np.bincount(np.concatenate([rows[i] for i in learn if y[i] == side] or [np.zeros(0, np.int32)]), minlength=DIM) for side in (1.0, -1.0)]
    ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    w, bias = descend([rows[i] for i in learn], ratio, y[learn])
    weight = (w * ratio).astype(np.float32)
    probe = np.flatnonzero(check) if check.any() else learn
    margin = np.array([weight[rows[i]].sum(dtype=np.float64) / np.sqrt(max(1, len(rows[i]))) + bias for i in probe])
    return Model(weight, bias, *logistic(margin, y[probe]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Model:
    """Fits on at most about train_rows of the labelled documents given; what is gathered has that bound."""
    known = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg(F.max(label_col).alias("label"))
    share = min(1.0, train_rows / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(picked), "id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch.column(1)):
                places, offs = ngram_sets(t)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[t.first : t.first + t.n], batch.column(2)[t.first : t.first + t.n], pa.array([places[a:b].tobytes() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], pa.binary())],
                    ["id", "label", "places"],
                )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((i, y, p) for b in batches for i, y, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
        m = fit_rows([np.frombuffer(p, np.int32) for _, _, p in got], np.array([y for _, y, _ in got]))
        yield pa.RecordBatch.from_arrays([pa.array([m.weight.tobytes()], pa.binary()), *(pa.array([x], pa.float64()) for x in (m.bias, m.slope, m.shift))], ["weight", "bias", "slope", "shift"])

    rows = sample.select("id", "text", F.col("label").cast("int").alias("label")).mapInArrow(sets, f"id {dict(sample.dtypes)['id']}, label int, places binary")
    got = rows.repartition(1).mapInArrow(train, "weight binary, bias double, slope double, shift double").first()
    return Model(np.frombuffer(got["weight"], np.float32), got["bias"], got["slope"], got["shift"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score. Nothing is shuffled; the broadcast model has DIM weights, whatever the input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch.column(1), 1 << 19):
                yield pa.RecordBatch.from_arrays([batch.column(0)[t.first : t.first + t.n], pa.array(shared.value.scores(*ngram_sets(t)))], [id_col, "score"])

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double")
