"""Language ID: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text is the mean of the embeddings of its hashed byte n-grams; a linear layer and a softmax follow.
As the mean and the layer are linear, prediction needs only the product of both matrices: one row of
class scores for each hash bucket.

Rejection is calibrated on a part of the labelled sample that the training doesn't see, and on strangers: languages are
left out of the training in turn, and what a model without them says of their texts is known to be wrong. A score is the
chance to be right that the lead of the best class over the next gives, and the threshold lies where nearly no right
prediction does. With fewer than three languages there are no strangers, and only texts without letters are rejected.

Defined results: null text, and text without a letter, gives `und` with score 0, rejected. Without any
labelled row every text gives `und`. Repeated rows are predicted alike and each returned; ties between
classes go to the first in alphabetical order; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bound of the labelled sample that the model is fitted on: the rows with the smallest hashes of doc_id.
SAMPLE = 3000
BUCKETS = 1 << 16
DIMS = 16
GRAMS = (2, 3, 4)
#: The threshold stands at SAFETY times the lead below which this part of right predictions on calibration rows lies.
REJECT, SAFETY = 0.001, 0.65
#: Classes that are left out in turn to see what strangers score, and rows of a model without one.
LEFT_OUT, LEFT_ROWS = 8, 1000
#: Bytes hashed at once, which bounds the memory of a task whatever the texts' lengths.
CHUNK = 1 << 18


def gram_ids(data: bytes) -> Iterator[np.ndarray]:
    """Buckets of the byte n-grams of the lower-cased text between two spaces, CHUNK places at a time."""
    whole = np.frombuffer(b" " + data + b" ", np.uint8)
    for at in range(0, len(whole), CHUNK):
        b = whole[at : at + CHUNK + max(GRAMS) - 1].astype(np.uint32)
        for n in GRAMS:
            m = min(CHUNK, len(b) - n + 1)
            if m > 0:
                h = np.full(m, 2166136261 + n, np.uint32)
                for k in range(n):
                    h = (h ^ b[k : m + k]) * np.uint32(16777619)
                yield (h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's buckets and the share of each."""
    total = np.zeros(BUCKETS, np.int64)
    for ids in gram_ids(text.lower().encode("utf-8", "replace")):
        total += np.bincount(ids, minlength=BUCKETS)
    ids = np.flatnonzero(total)
    return ids, (total[ids] / max(total.sum(), 1)).astype(np.float32)


@dataclass
class Model:
    """A text's score is the chance that its best class is right, a logistic function of how far that class leads the next one."""

    classes: list[str]
    scores: np.ndarray  # (BUCKETS, classes): embedding times layer
    bias: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.classes)), 0
        for ids in gram_ids(text.lower().encode("utf-8", "replace")):
            total += self.scores[ids].sum(axis=0, dtype=np.float64)
            n += len(ids)
        return total / max(n, 1) + self.bias

    def score(self, lead: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * lead + self.offset, -50, 50))))

    def predict(self, text: str) -> tuple[str, float]:
        z = self.logits(text)
        return self.classes[int(z.argmax())], self.score(float(lead(z[None])[0]))


def lead(z: np.ndarray) -> np.ndarray:
    """By row, the largest value less the second; of a single class without bound."""
    if z.shape[1] < 2:
        return np.full(len(z), np.inf)
    top = np.partition(z, -2, axis=1)
    return top[:, -1] - top[:, -2]


def descend(bags: list, y: np.ndarray, classes: int, fit: np.ndarray, rng: np.random.Generator, epochs: int, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding, layer and bias after stochastic gradient descent over the rows `fit`."""
    embed = rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32)
    layer, bias = np.zeros((DIMS, classes), np.float32), np.zeros(classes, np.float32)
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for i in rng.permutation(fit):
            ids, share = bags[i]
            if not len(ids):
                continue
            mean = share @ embed[ids]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            down = layer @ p
            layer -= step * np.outer(mean, p)
            bias -= step * 0.1 * p
            # a bucket's share of a long text is small, so its own step is scaled up to its size
            embed[ids] -= (step * np.sqrt(len(ids)) * share)[:, None] * down
    return embed, layer, bias


def _logits(bags: list, rows: np.ndarray, embed: np.ndarray, layer: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.array([bags[i][1] @ embed[bags[i][0]] for i in rows]).reshape(-1, DIMS) @ layer + bias


def strangers(bags: list, y: np.ndarray, fit: np.ndarray, held: np.ndarray, classes: int, rng: np.random.Generator, epochs: int, rate: float) -> np.ndarray:
    """Leads that texts of a class get from a model that never saw it: LEFT_OUT classes are left out in turn."""
    found = [np.empty(0)]
    for c in range(min(classes, LEFT_OUT)) if classes > 2 else ():
        rows = fit[y[fit] != c][:LEFT_ROWS]
        of_it = np.append(held[y[held] == c], fit[y[fit] == c])[:LEFT_ROWS]
        left = np.where(y > c, y - 1, y)
        found.append(lead(_logits(bags, of_it, *descend(bags, left, classes - 1, rows, rng, epochs, rate))))
    return np.concatenate(found)


def calibrated(inside: np.ndarray, outside: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic function that tells leads of right predictions from those of strangers, both sides weighing the same."""
    if not len(inside) or not len(outside) or not np.isfinite(inside).all():
        return 1.0, 0.0
    x = np.column_stack([np.append(inside, outside), np.ones(len(inside) + len(outside))])
    t = np.append(np.ones(len(inside)), np.zeros(len(outside)))
    w = np.append(np.full(len(inside), 0.5 / len(inside)), np.full(len(outside), 0.5 / len(outside)))
    b = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -50, 50)))
        # a little of the squared slope keeps it finite where the two sides don't overlap
        g = x.T @ (w * (p - t)) + [1e-3 * b[0], 0]
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-9])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        b -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def train(texts: list[str], labels: list[str], epochs: int = 4, rate: float = 0.5, seed: int = 7) -> Model | None:
    classes = sorted(set(labels))
    if not classes:
        return None
    y = np.array([classes.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, fit = (order[: len(y) // 5], order[len(y) // 5 :]) if len(y) >= 20 else (order, order)
    bags = [bag(t) for t in texts]
    embed, layer, bias = descend(bags, y, len(classes), fit, rng, epochs, rate)
    model = Model(classes, embed @ layer, bias.astype(np.float64))
    z = _logits(bags, held, embed, layer, bias)
    inside = lead(z)[z.argmax(axis=1) == y[held]]
    outside = strangers(bags, y, fit, held, len(classes), rng, epochs, rate)
    model.slope, model.offset = calibrated(inside, outside)
    if len(inside) and len(outside):
        model.threshold = model.score(float(np.quantile(inside, REJECT)) * SAFETY)
    return model


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on at most `sample` labelled rows that aren't held out; only text and lang are read of them."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~F.coalesce(held_out(), F.lit(True)))
    usable = usable.select("text", "lang", F.xxhash64("doc_id").alias("order"))
    # the hashes alone find the cut, so that only the sample's texts come to the driver
    cut = usable.select("order").orderBy("order").limit(sample).agg(F.max("order")).first()[0]
    if cut is None:
        return None
    rows = usable.filter(F.col("order") <= cut).orderBy("order", F.xxhash64("text")).limit(sample).collect()
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """Columns `keep` of docs, but for those named like a result, with lang_pred, score and accepted; the texts stay where the batches are."""
    keep = [c for c in keep if c not in ("lang_pred", "score", "accepted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(text: list, letters: list) -> list[list]:
        m = shared.value
        found = [m.predict(t) if m and ok else ("und", 0.0) for t, ok in zip(text, letters, strict=True)]
        return [[x[0] for x in found], [x[1] for x in found], [c != "und" and s >= m.threshold for c, s in found]]

    inputs = {"text": F.col("text"), "letters": F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))}
    return common.with_columns_by(docs, keep, inputs, run, "lang_pred string, score double, accepted boolean")


def language_id(docs: DataFrame, sample: int = SAMPLE, keep: list[str] | None = None) -> DataFrame:
    return predict(docs, fit(docs, sample), keep or ["doc_id"])


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return language_id(docs).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model rejects go: those without a letter (null and empty ones too) and those whose score is under the threshold.

    Without any labelled row nothing is known and nothing is rejected. Repeated rows are kept or go each.
    """
    names, model = docs.columns, fit(docs)
    if model is None:
        return docs
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    return predict(docs.select(row, "text"), model, ["row"]).filter("accepted").select("row.*")
