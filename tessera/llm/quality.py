"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Small trees are boosted on the statistics of a bounded sample of labelled rows. Every path from a root to a node below
it is a rule, the conjunction of its splits. A logistic regression with an L1 penalty weighs the rules, which leaves
most of them at zero; the few that remain are compiled into one Spark column expression, so that scoring is a
projection of the table of statistics. Only numbers of the sample come to the driver, never texts.

Statistics are taken of whole texts, in slices; memory grows with a text's number of words, 24 bytes each.

Defined results: null and empty texts have all statistics zero and get the score of those. Without labelled rows every
score is 0.5; with labels of one value only, it is near that value. Repeated rows are scored each. A doc_id with
several labels gives one row of the sample for each; null labels and null doc_ids give none. A null doc_id isn't held
out. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing

#: Bound of the labelled sample that the rules are fitted on: the rows with the smallest hashes of doc_id.
SAMPLE = 6000
TREES = 40
DEPTH = 3
BINS = 32
#: Fewest rows of the sample on either side of a split.
LEAF = 10
SLICE = 1 << 20

STATISTICS = (
    "bytes_log", "words_log", "word_bytes", "word_spread", "long_words", "short_words", "upper", "letters", "digits",
    "symbols", "stops", "commas", "marks", "brackets", "other_script", "words_a_line", "distinct_words", "repeated_triples",
    "word_again", "top_word",
)


def _bytes_in(text: bytes) -> np.ndarray:
    is_ = np.zeros(256, bool)
    is_[list(text)] = True
    return is_


_UPPER = _bytes_in(bytes(range(65, 91)))
_ASCII = _bytes_in(bytes(range(65, 91)) + bytes(range(97, 123)))
_HIGH = _bytes_in(bytes(range(128, 256)))
_DIGIT = _bytes_in(b"0123456789")
_SYMBOL = _bytes_in(b"#$%&*+/<=>@\\^_`{|}~")
_BRACKET = _bytes_in(b"()[]{}<>")
_SPACE = _bytes_in(b" \t\n\v\f\r")


def statistics_of(data: bytes) -> list[float]:
    """STATISTICS of a text."""
    if not data:
        return [0.0] * len(STATISTICS)
    b = np.frombuffer(data, np.uint8)
    count = sum(np.bincount(b[at : at + SLICE], minlength=256) for at in range(0, len(b), SLICE))
    ink = max(int(count[~_SPACE].sum()), 1)
    letters = int(count[_ASCII].sum() + count[_HIGH].sum())
    h, start, end = hashing.words(data, lower=True)
    n, size = len(h), end - start
    some = max(n, 1)
    _, times = np.unique(h, return_counts=True)
    triples = hashing.windows(h, 3)
    return [
        math.log1p(len(b)),
        math.log1p(n),
        float(size.mean()) if n else 0.0,
        float(size.std()) if n else 0.0,
        float((size > 20).sum() / some),
        float((size < 3).sum() / some),
        float(count[_UPPER].sum() / max(letters, 1)),
        letters / ink,
        float(count[_DIGIT].sum() / ink),
        float(count[_SYMBOL].sum() / ink),
        float(count[ord(".")] / some),
        float(count[ord(",")] / some),
        float((count[ord("!")] + count[ord("?")]) / some),
        float(count[_BRACKET].sum() / ink),
        float(count[_HIGH].sum() / ink),
        n / (1.0 + float(count[10])),
        len(times) / some,
        1.0 - len(np.unique(triples)) / len(triples) if len(triples) else 0.0,
        float((h[1:] == h[:-1]).sum() / some),
        float(times.max() / some) if n else 0.0,
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the STATISTICS of every text."""
    names = ["doc_id", *STATISTICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics_of(batch.column(1)[k].as_py()) for k in range(batch.num_rows)]
            table = np.array(rows, np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in table.T)], names=names)

    common.bounded_batches(docs.sparkSession)
    schema = "doc_id long, " + ", ".join(f"{x} double" for x in STATISTICS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text")).mapInArrow(run, schema)


#: A rule: for each of its splits the statistic's position, the threshold, and whether the value lies above it.
Rule = tuple[tuple[int, float, bool], ...]


@dataclass
class Rules:
    """weights of conjunctive rules over the statistics, with the intercept of their logistic sum."""

    intercept: float = 0.0
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self) -> Column:
        """The model as a Spark expression over the columns STATISTICS."""
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for k, threshold, over in rule:
                c = F.col(STATISTICS[k])
                holds = holds & (c > threshold if over else c <= threshold)
            total = total + F.when(holds, F.lit(float(weight))).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.intercept + covered(self.rules, x) @ np.array(self.weights, np.float64) if self.rules else np.full(len(x), self.intercept)
        return 1 / (1 + np.exp(-z))


def covered(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    """Which rule (column) holds for which row of statistics."""
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for k, threshold, over in rule:
            out[:, j] *= x[:, k] > threshold if over else x[:, k] <= threshold
    return out


def _splits(x: np.ndarray) -> list[np.ndarray]:
    """Candidate thresholds of each statistic: midpoints between neighbouring quantiles."""
    out = []
    for column in x.T:
        q = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)))
        out.append((q[1:] + q[:-1]) / 2)
    return out


def tree_rules(bins: np.ndarray, thresholds: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, depth: int, path: Rule = ()) -> list[tuple[Rule, np.ndarray]]:
    """The paths of a regression tree on residual: (rule, rows) of each node below the root."""
    if depth == 0 or len(rows) < 2 * LEAF:
        return []
    best, gain = None, 1e-9
    r = residual[rows]
    total, n = r.sum(), len(rows)
    for k, t in enumerate(thresholds):
        if not len(t):
            continue
        size = np.cumsum(np.bincount(bins[rows, k], minlength=len(t) + 1))[:-1]
        part = np.cumsum(np.bincount(bins[rows, k], weights=r, minlength=len(t) + 1))[:-1]
        ok = (size >= LEAF) & (n - size >= LEAF)
        value = np.where(ok, part**2 / np.maximum(size, 1) + (total - part) ** 2 / np.maximum(n - size, 1) - total**2 / n, 0)
        at = int(value.argmax())
        if value[at] > gain:
            best, gain = (k, at), value[at]
    if best is None:
        return []
    k, at = best
    out = []
    for over in (False, True):
        side, rule = rows[(bins[rows, k] > at) == over], (*path, (k, float(thresholds[k][at]), over))
        out += [(rule, side), *tree_rules(bins, thresholds, residual, side, depth - 1, rule)]
    return out


def simplified(rule: Rule) -> Rule:
    """A rule with at most one bound on each side of a statistic, in a fixed order."""
    bounds: dict[tuple[int, bool], float] = {}
    for k, t, over in rule:
        old = bounds.get((k, over), t)
        bounds[k, over] = max(old, t) if over else min(old, t)
    return tuple((k, t, over) for (k, over), t in sorted(bounds.items()))


def boosted_rules(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, trees: int = TREES, rate: float = 0.3) -> list[Rule]:
    """Distinct rules of trees that are each fitted to what those before leave, on half of the rows in turn."""
    thresholds = _splits(x)
    bins = np.stack([np.searchsorted(t, x[:, k], side="left") for k, t in enumerate(thresholds)], axis=1)
    z, found = np.zeros(len(y)), {}
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-z))
        rows = np.sort(rng.choice(len(y), max(len(y) // 2, min(len(y), 4 * LEAF)), replace=False))
        for rule, side in tree_rules(bins, thresholds, residual, rows, DEPTH):
            found.setdefault(simplified(rule))
        leaves = [(rule, side) for rule, side in tree_rules(bins, thresholds, residual, rows, 2)]
        for rule, side in leaves:
            step = residual[side].sum() / (np.abs(residual[side]) * (1 - np.abs(residual[side]))).sum().clip(1e-3)
            z += rate / 2 * np.clip(step, -4, 4) * covered([rule], x)[:, 0]
    return list(found)


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, start: tuple[float, np.ndarray] | None = None, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of the logistic regression on r under an L1 penalty, by accelerated proximal gradient."""
    n, (b, w) = len(y), start or (0.0, np.zeros(r.shape[1]))
    # the largest eigenvalue of r'r, by powers, bounds the curvature
    v = np.ones(r.shape[1] + 1)
    for _ in range(20):
        u = r @ v[1:] + v[0]
        v = np.append(u.sum(), r.T @ u)
        norm = np.linalg.norm(v)
        v /= max(norm, 1e-12)
    step = 4 * n / max(norm * 1.05, 1e-9)
    b0, w0, t = b, w, 1.0
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-(r @ w + b))) - y) / n
        nb, nw = b - step * g.sum(), w - step * (r.T @ g)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        moved = np.abs(nw - w0).max(initial=0) + abs(nb - b0)
        b, w = nb + (t - 1) / t2 * (nb - b0), nw + (t - 1) / t2 * (nw - w0)
        b0, w0, t = nb, nw, t2
        if moved < 1e-6:
            break
    return b0, w0


def loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Rules:
    """The penalty is the largest whose loss on a fifth of the rows is within a hundredth of the least."""
    if not len(y):
        return Rules()
    share = (y.sum() + 0.5) / (len(y) + 1)
    flat = Rules(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2 or len(y) < 4 * LEAF:
        return flat
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    rules = boosted_rules(x[fit], y[fit], rng)
    if not rules:
        return flat
    r = covered(rules, x)
    # of rules that hold for the same rows one is enough
    _, one = np.unique(r, axis=1, return_index=True)
    rules, r = [rules[j] for j in sorted(one)], r[:, sorted(one)]
    start, tried = None, []
    most = np.abs(r[fit].T @ (y[fit] - y[fit].mean())).max() / len(fit)
    for penalty in most * np.geomspace(0.5, 0.002, 9):
        start = lasso(r[fit], y[fit], penalty, start)
        tried.append((loss(r[held] @ start[1] + start[0], y[held]), penalty))
    least = min(x for x, _ in tried)
    penalty = next(p for x, p in tried if x <= least * 1.01 + 1e-4)
    b, w = lasso(r, y, penalty, rounds=1500)
    kept = np.flatnonzero(w)
    return Rules(float(b), [rules[j] for j in kept], [float(w[j]) for j in kept])


def bucket() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def sample(stats: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most `size` labelled rows that aren't held out, in the order of a hash."""
    usable = labels.filter(F.col("quality").isNotNull() & (bucket() != 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    first = usable.withColumn("order", F.xxhash64("doc_id", "quality")).orderBy("order", "doc_id").limit(size)
    # the chosen labels are few by the bound; so are the rows of the join, but for repeated doc_ids
    rows = stats.join(F.broadcast(first), "doc_id").orderBy("order", *STATISTICS).limit(size).select(*STATISTICS, "quality").collect()
    table = np.array([tuple(r) for r in rows], np.float64).reshape(-1, len(STATISTICS) + 1)
    return table[:, :-1], (table[:, -1] > 0).astype(np.float64)


def quality(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[DataFrame, Rules]:
    """doc_id, score and predicted of every row of docs (doc_id, text), and the rules behind them."""
    stats = common.written(statistics(docs))
    model = train(*sample(stats, labels, size))
    scored = stats.withColumn("score", model.score())
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), model


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(bucket() == 1, F.lit(False)).alias("held_out"), "score", "predicted")
