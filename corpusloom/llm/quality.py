"""Operator 8: a quality classifier learnt from trusted positives and unlabelled text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import map_rows

#: Bounds of the sample the classifier is fitted on: trusted positives, and documents without regard to a label.
POSITIVES, UNLABELLED = 6000, 12000
#: Steps, step size, hidden units and weight decay of the fit.
STEPS, RATE, HIDDEN, DECAY = 800, 0.005, 12, 3e-3

_BYTE = np.zeros(256, dtype=np.int64)
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n\r", b".", b",", b"!?", b"|", b"#$%&*@^~=<>+", b"-_:;/\\", b"'\"()[]{}"), 1):
    _BYTE[list(_set)] = _k
_BYTE[128:] = 13
CLASSES = 14
FEATURES = CLASSES + 16


def features(text: str | None) -> np.ndarray:
    """Figures of a whole text: shares of kinds of bytes, and of words and lines that repeat or look odd."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_BYTE, weights=counts, minlength=CLASSES)
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n, m, size = max(len(words), 1), max(len(lines), 1), max(len(data), 1)
    distinct = set(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    per_line = np.array([len(x) for x in lines] or [0])
    ends = [w[-1:] for w in words]
    out = np.empty(FEATURES)
    out[:CLASSES] = kinds / size
    shares = counts[counts > 0] / size
    out[CLASSES:] = (
        np.log1p(len(data)), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        len(distinct) / n, np.log1p(len(distinct)), len(set(lines)) / m, np.log1p(per_line.mean()), per_line.max() / size,
        sum(map(bytes.isalpha, ends)) / n, sum(map(bytes.isupper, words)) / n, sum(map(bytes.istitle, words)) / n,
        (lengths <= 2).mean(), -(shares * np.log(shares)).sum(),
    )
    return out


def feature_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text}` text").mapInArrow(run, "doc_id long, x array<double>")


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are kept for testing."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    """One hidden layer on standardised figures."""

    def __init__(self, mean, scale, w1, b1, w2, b2):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2 = mean, scale, w1, b1, w2, b2

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.tanh(self.standard(x) @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7) -> Model:
    """Minimise the non-negative unbiased risk: prior * E+[l(+)] + max(0, Eu[l(-)] - prior * E+[l(-)]).

    l is the sigmoid loss. Where the bracket falls below zero the step goes the other way on it alone,
    so that the unlabelled part is not fitted to less than no negatives.
    """
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, d = np.clip(np.array([prior]), 0.01, 0.99)[0], positive.shape[1]
    m = Model(mean, scale, rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    xp, xu = m.standard(positive), m.standard(unlabelled)
    names, first, second = ("w1", "b1", "w2", "b2"), {}, {}
    for step in range(1, STEPS + 1):
        i, j = rng.integers(0, len(xp), 1024), rng.integers(0, len(xu), 1024)
        x = np.concatenate([xp[i], xu[j]])
        hidden = np.tanh(x @ m.w1 + m.b1)
        s = 1 / (1 + np.exp(-np.clip(hidden @ m.w2 + m.b2, -30, 30)))
        slope, k = s * (1 - s), len(i)
        rest = s[k:].mean() - p * s[:k].mean()  # Eu[l(-)] - prior * E+[l(-)], as l(-) = s and l(+) = 1 - s
        grad = np.zeros(len(x))
        if rest >= 0:
            grad[:k], grad[k:] = -2 * p * slope[:k] / k, slope[k:] / (len(x) - k)
        else:
            grad[:k], grad[k:] = p * slope[:k] / k, -slope[k:] / (len(x) - k)
        back = np.outer(grad, m.w2) * (1 - hidden**2)
        grads = {"w1": x.T @ back + DECAY * m.w1, "b1": back.sum(0), "w2": hidden.T @ grad + DECAY * m.w2, "b2": grad.sum()}
        for n in names:
            first[n] = 0.9 * first.get(n, 0) + 0.1 * grads[n]
            second[n] = 0.999 * second.get(n, 0) + 0.001 * grads[n] ** 2
            setattr(m, n, getattr(m, n) - RATE * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8))
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED,
          id_col: str = "doc_id", text: str = "text") -> Model | None:
    """Fit on at most ``positives`` trusted and ``unlabelled`` other rows, the first by a hash of their ids.

    The class prior is the share of ones among all labels that may be learnt from. None if there are
    no positives to learn from.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).alias("y")).filter(F.col("y").isNotNull())
    known = known.filter(~held_out("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y"))
    n, ones = known.agg(F.count("y"), F.sum("y")).first()
    if not ones:
        return None
    open_docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    ids = open_docs.select("doc_id").distinct()
    turn = F.xxhash64("doc_id", F.lit(11))
    trusted = known.filter("y = 1").join(ids, "doc_id", "left_semi").orderBy(turn, "doc_id").limit(positives).select("doc_id", F.lit(True).alias("p"))
    other = ids.orderBy(F.xxhash64("doc_id", F.lit(12)), "doc_id").limit(unlabelled).select("doc_id", F.lit(False).alias("p"))
    chosen = trusted.unionByName(other).groupBy("doc_id").agg(F.max("p").alias("p"), F.min("p").alias("q"))  # at most positives + unlabelled rows
    some = open_docs.join(F.broadcast(chosen), "doc_id")
    parts = {r.doc_id: r for r in chosen.collect()}
    rows = feature_rows(some).dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r.doc_id)
    xp = np.array([r.x for r in rows if parts[r.doc_id].p])
    xu = np.array([r.x for r in rows if not parts[r.doc_id].q])
    return fit(xp, xu, ones / n) if len(xp) and len(xu) else None


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", **sample) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    The score depends on the whole text alone. A null text counts as empty and is scored like one;
    without a label to learn from all scores are 0.5. Repeated rows are scored alike, other columns
    left out; an empty table gives an empty one. Labels without a document or a value are passed over,
    and several labels of a document count as one, the highest.
    """
    fitted = train(docs, labels, label, id_col=id_col, text=text, **sample)
    model = docs.sparkSession.sparkContext.broadcast(fitted)  # a few thousand numbers

    def run(batches):
        m = model.value
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)]).reshape(-1, FEATURES)
            score = m.score(x) if m is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text}` text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", **sample) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose whole text the classifier takes for good; all without a label to learn from."""
    fitted = train(docs, labels, label, id_col=id_col, text=text, **sample)
    if fitted is None:
        return docs
    model, at = docs.sparkSession.sparkContext.broadcast(fitted), docs.columns.index(text)

    def run(batches):
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(at)]).reshape(-1, FEATURES)
            yield batch.filter(pa.array(model.value.score(x) >= 0.5))

    return map_rows(docs, run)
