"""Fail-closed checks: registries of equivalence classes, completeness, lookups, and certified hull relations.

A check is a DataFrame of its violations; `must_be_empty` turns one into an error.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import settled


class CheckError(ValueError):
    """A check found violations."""


def must_be_empty(violations: DataFrame, what: str) -> None:
    rows = violations.limit(5).collect()
    if rows:
        raise CheckError(f"{what}: {[r.asDict() for r in rows]}")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def ordinals(df: DataFrame, by: str, *order: str) -> DataFrame:
    """df with place, from 0, of each row of `by`."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long") - 1)


def completeness(records: DataFrame, vectors: DataFrame, by: str, key: str) -> DataFrame:
    """by, records, vectors, missing, complete: how many records of each group have a vector."""
    x = records.select(by, key).join(vectors.select(key, F.lit(1).alias("__has")).distinct(), key, "left")
    out = x.groupBy(by).agg(F.count("*").alias("records"), F.count("__has").alias("vectors"))
    return out.withColumn("missing", F.col("records") - F.col("vectors")).withColumn("complete", F.col("missing") == 0)


def relation_faults(ids: DataFrame, pairs: DataFrame, complete: bool = True) -> DataFrame:
    """fault, a, b: what keeps pairs (a <= b, same) over ids (id) from being a complete equivalence relation; without `complete`, pairs that are absent count as not the same.

    Transitivity needs no triples: under an equivalence each id has the same smallest partner as all its
    partners, and a class of n has n (n + 1) / 2 pairs.
    """
    twice = duplicates(pairs, "a", "b").select(F.lit("duplicate").alias("fault"), "a", "b")
    odd = pairs.filter("a > b").select(F.lit("order").alias("fault"), "a", "b")
    loops = ids.select(F.col("id").alias("a"), F.col("id").alias("b")).join(pairs.filter("same").select("a", "b"), ["a", "b"], "left_anti").select(F.lit("reflexive").alias("fault"), "a", "b")
    n = ids.agg(F.count("*").alias("n"))
    size = pairs.select("a", "b").distinct().agg(F.count("*").alias("m")).crossJoin(n).filter("m <> n * (n + 1) / 2").select(F.lit("incomplete").alias("fault"), F.col("m").alias("a"), F.col("n").alias("b"))
    same = pairs.filter("same").select("a", "b").distinct()
    least = _least(same)
    split = same.join(least.toDF("a", "la"), "a").join(least.toDF("b", "lb"), "b").filter("la <> lb").select(F.lit("transitive").alias("fault"), "a", "b")
    full = same.join(least.toDF("a", "la"), "a").groupBy("la").agg(F.count("*").alias("m"))
    full = full.join(least.toDF("x", "la").groupBy("la").agg(F.count("*").alias("n")), "la").filter("m <> n * (n + 1) / 2")
    full = full.select(F.lit("transitive").alias("fault"), F.col("la").alias("a"), F.col("n").alias("b"))
    faults = twice.union(odd).union(loops).union(split).union(full)
    return faults.union(size) if complete else faults


def _least(same: DataFrame) -> DataFrame:
    both = same.union(same.select("b", "a"))
    return both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("rep")).toDF("id", "rep")


def registry(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, rep: the smallest equivalent id of each; call relation_faults first."""
    same = pairs.filter("same").select("a", "b")
    return ids.join(_least(same), "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))


def payload_faults(classes: DataFrame, payloads: DataFrame) -> DataFrame:
    """Payloads that stand in more than one class. classes: (id, rep); payloads: (id, payload)."""
    return classes.join(payloads, "id").groupBy("payload").agg(F.countDistinct("rep").alias("classes")).filter("classes > 1")


def lookup(queries: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """queries with their row of the table; a missing key raises."""
    must_be_empty(queries.join(table, key, "left_anti").select(key), f"no {key}")
    return queries.join(table, key)


def vector_checks(vectors: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """id, unit (length 1 within tolerance), finite of each vector (id, v)."""
    n = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))
    return vectors.select("id", (F.abs(n - 1) <= tolerance).alias("unit"), fine.alias("finite"))


def close_pairs(vectors: DataFrame, tolerance: float, axes: int = 3, seed: int = 5) -> DataFrame:
    """a < b, distance of the vectors (id, v) within tolerance of each other, without meeting all others.

    Points so close are as close along any direction: along a few fixed ones each falls into a cell of the tolerance's
    width, and only neighbouring cells meet. Equal vectors are one point; of each group its first id stands for it, and
    the others are given against that.
    """
    point = settled(vectors.select("id", "v").groupBy("v").agg(F.min("id").alias("a")))
    first = point.join(vectors.select(F.col("id").alias("b"), "v"), "v").filter("a < b").select("a", "b", F.lit(0.0).alias("distance"))
    size = vectors.agg(F.max(F.size("v"))).first()[0] or 1
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, min(axes, size))))[0].T.tolist()
    along = lambda w: F.aggregate(F.zip_with("v", F.lit(w), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    names = [f"c{k}" for k in range(len(turn))]
    cell = settled(point.select("a", *(F.floor(along(w) / tolerance).cast("long").alias(n) for n, w in zip(names, turn, strict=True))))
    near = cell.withColumnRenamed("a", "b")
    for n in names:
        near = near.withColumn(n, F.explode(F.array(F.col(n) - 1, F.col(n), F.col(n) + 1)))
    d = F.sqrt(F.aggregate(F.zip_with("v", "w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    # numbers of cells travel, and vectors only to the pairs that meet
    met = cell.join(near, names).filter("a < b").select("a", "b").join(point, "a").join(point.toDF("w", "b"), "b")
    met = met.select("a", "b", d.alias("distance")).filter(F.col("distance") <= tolerance)
    return first.unionByName(met)


def vector_faults(vectors: DataFrame, repeat: DataFrame, tokens: DataFrame, drift: float = 1e-6, length: float = 1e-10) -> DataFrame:
    """fault, a, b, value of an encoding (id, v): what speaks against it, none where it is sound.

    missing: no repeat, or no vector for one; nonfinite, nonunit: in either encoding; drift: an id's vector moved by
    more than `drift` in the repeat; collapse: two ids within max(drift, 10 x largest drift); tokens: two ids with equal
    token lists (id, tokens; null lists aside). Collapse and drift look at sound vectors only.
    """
    n = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fault = lambda df, name, a="id", b=None, value=None: df.select(F.lit(name).alias("fault"), F.col(a).alias("a"), (F.col(b) if b else F.lit(None)).cast("long").alias("b"), (value if value is not None else F.lit(None)).cast("double").alias("value"))
    # every check reads them, so they are made, looked at and measured once
    both = [x.select("id", F.transform("v", lambda c: c.cast("double")).alias("v")).withColumn("ok", F.coalesce(fine, F.lit(False))) for x in (vectors, repeat)]
    both = [settled(x.withColumn("length", F.when(F.col("ok"), n))) for x in both]
    gone = [fault(x.join(y, "id", "left_anti"), "missing") for x, y in (both, both[::-1])]
    wild = [fault(x.filter("NOT ok"), "nonfinite") for x in both]
    off = [fault(x.filter(F.abs(F.col("length") - 1) > length), "nonunit", value=F.col("length")) for x in both]
    x, y = (z.filter("ok").select("id", "v") for z in both)
    d = F.sqrt(F.aggregate(F.zip_with("v", "w", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, e: s + e))
    moved = settled(x.join(y.toDF("id", "w"), "id").select("id", d.alias("d")))
    most = moved.agg(F.max("d")).first()[0] or 0.0
    close = close_pairs(x, max(drift, 10 * most))
    # of a list its SHA-256 travels, never the list or all ids that have it
    plain = F.col("tokens") if dict(tokens.dtypes)["tokens"] == "string" else F.to_json(F.struct("tokens"))
    said = settled(tokens.filter("tokens IS NOT NULL").select(F.col("id").alias("b"), F.sha2(plain, 256).alias("h")))
    least = said.groupBy("h").agg(F.min("b").alias("a"), F.count("*").alias("n")).filter("n > 1")
    said = said.join(least, "h").filter("a <> b").select("a", "b")
    parts = [*gone, *wild, *off, fault(moved.filter(F.col("d") > drift), "drift", value=F.col("d")), fault(close, "collapse", "a", "b", F.col("distance")), fault(said, "tokens", "a", "b")]
    return reduce(DataFrame.unionByName, parts)


def _nearest_points(a: np.ndarray, b: np.ndarray, steps: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the convex combinations of a and of b nearest to each other, by pairwise conditional gradient.

    The best difference a_i - b_j along a direction is that of the two best points, so the set of differences is never
    made: a step costs one product with a and one with b. The pairs that carry weight are few, and kept by themselves.
    """
    i, j = int(np.argmin(((a - b.mean(0)) ** 2).sum(1))), 0
    j = int(np.argmin(((b - a[i]) ** 2).sum(1)))
    weight, x = {(i, j): 1.0}, a[i] - b[j]
    for _ in range(steps):
        p, q = a @ x, b @ x
        to = (int(np.argmin(p)), int(np.argmax(q)))
        off = max(weight, key=lambda e: p[e[0]] - q[e[1]])
        gap = (p[off[0]] - q[off[1]]) - (p[to[0]] - q[to[1]])
        d = (a[to[0]] - b[to[1]]) - (a[off[0]] - b[off[1]])
        size = float(d @ d)
        if gap <= 1e-15 * max(1.0, float(x @ x)) or size == 0:
            break
        step = min(weight[off], gap / size)
        weight[to] = weight.get(to, 0.0) + step
        weight[off] -= step
        if weight[off] <= 0:
            del weight[off]
        x = sum(w * (a[m] - b[n]) for (m, n), w in weight.items())
    u, v = np.zeros(len(a)), np.zeros(len(b))
    for (m, n), w in weight.items():
        u[m] += w
        v[n] += w
    return u, v


def hull_relation(a: np.ndarray, b: np.ndarray, tol: float = 1e-9) -> tuple[str, float]:
    """How the convex hulls of two point sets relate, with a certificate: `intersect` if convex weights of both meet
    within tol, `disjoint` if a direction separates all points by more than tol, else `unresolved`; and the distance found.

    The verdict rests on the certificate alone, never on the solver having converged.
    """
    a, b = np.atleast_2d(np.asarray(a, float)), np.atleast_2d(np.asarray(b, float))
    center = np.concatenate([a, b]).mean(0)
    scale = max(1.0, float(np.abs(np.concatenate([a, b]) - center).max()))
    a, b = (a - center) / scale, (b - center) / scale
    p, q = _nearest_points(a, b)
    x = p @ a - q @ b
    gap = float(np.linalg.norm(x))
    if gap * scale > tol:
        u = x / gap
        margin = float((a @ u).min() - (b @ u).max())
        if margin * scale > tol:
            return "disjoint", margin * scale
    meet = gap * scale
    if meet <= 1e-12 * scale:
        return "intersect", 0.0
    return "unresolved", meet


def hull_relations(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """left, right, relation, gap for each of the pairs (left, right) of objects; points: (object, v). One task takes one pair's points."""
    x = pairs.join(points.toDF("left", "v"), "left").select("left", "right", F.lit(0).alias("side"), "v")
    x = x.unionByName(pairs.join(points.toDF("right", "v"), "right").select("left", "right", F.lit(1).alias("side"), "v"))
    kind = dict(pairs.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.stack(pdf.loc[pdf["side"] == s, "v"].to_numpy()) if (pdf["side"] == s).any() else None for s in (0, 1))
        relation, gap = hull_relation(a, b) if a is not None and b is not None else ("unresolved", float("nan"))
        return pd.DataFrame({"left": [key[0]], "right": [key[1]], "relation": [relation], "gap": [round(gap, 9)]})

    return x.groupBy("left", "right").applyInPandas(run, f"left {kind['left']}, right {kind['right']}, relation string, gap double")


def contact_extent(a: np.ndarray, b: np.ndarray, tol: float = 1e-9) -> tuple[str, float]:
    """Whether two intersecting hulls meet in a point or further: width of the meeting set along the axes, by supporting points.

    Each axis is searched by bisection on the certified relation of the hulls cut at a plane; the widest extent decides.
    """
    if hull_relation(a, b, tol)[0] != "intersect":
        return "none", 0.0
    a, b = np.atleast_2d(np.asarray(a, float)), np.atleast_2d(np.asarray(b, float))
    widest = 0.0
    for axis in range(a.shape[1]):
        lo, hi = max(a[:, axis].min(), b[:, axis].min()), min(a[:, axis].max(), b[:, axis].max())
        ends = []
        for sign in (1, -1):
            far, near = (lo, hi) if sign == 1 else (hi, lo)
            for _ in range(30):
                mid = (far + near) / 2
                p, q = _cut(a, axis, mid, sign), _cut(b, axis, mid, sign)
                if len(p) and len(q) and hull_relation(p, q, tol)[0] == "intersect":
                    near = mid
                else:
                    far = mid
            ends.append(near)
        widest = max(widest, ends[1] - ends[0] if ends[1] > ends[0] else ends[0] - ends[1])
    return ("point", 0.0) if widest <= 1e-6 else ("extended", float(widest))


def _cut(points: np.ndarray, axis: int, at: float, sign: int) -> np.ndarray:
    """Points that span the part of the hull at or below `at` (sign 1) or at or above it (-1)."""
    side = sign * (points[:, axis] - at) <= 0
    inside, outside = points[side], points[~side]
    if not len(inside) or not len(outside):
        return inside
    t = (at - inside[:, None, axis]) / (outside[None, :, axis] - inside[:, None, axis])
    crossing = inside[:, None, :] + t[:, :, None] * (outside[None] - inside[:, None])
    return np.concatenate([inside, crossing.reshape(-1, points.shape[1])])


def fitting(records: DataFrame, length: str, limit: int, critical: DataFrame, key: str = "id") -> DataFrame:
    """records with `fits` (length within the limit); a record that critical (key) names and doesn't fit, or that has no length, raises."""
    x = records.withColumn("fits", F.coalesce(F.col(length) <= limit, F.lit(False)))
    must_be_empty(x.filter("NOT fits").select(key).join(critical.select(key), key, "left_semi"), f"critical but longer than {limit}")
    return x


#: The axioms that any proof may rest on.
FOUNDATIONS = ("propext", "Classical.choice", "Quot.sound")


def target_axioms(messages: DataFrame, allowed: tuple[str, ...] = FOUNDATIONS) -> DataFrame:
    """target, reports, axioms, outside, accepted of messages (target, data): what the reports on a target itself, no longer or other text, say it rests on.

    A target without a report isn't accepted.
    """
    said = F.trim("data")
    name = F.concat(F.lit("'"), F.col("target"), F.lit("'"))
    head, end = F.concat(name, F.lit(" depends on axioms: [")), F.lit("]")
    inner = F.expr("substring(trim(data), length(target) + 24, length(trim(data)) - length(target) - 24)")
    lists = said.startswith(head) & said.endswith(end) & ~F.contains(inner, F.lit("]"))
    none = said == F.concat(name, F.lit(" does not depend on any axioms"))
    names = F.filter(F.transform(F.split(inner, ","), lambda s: F.trim(s)), lambda s: s != "")
    x = messages.withColumn("__names", F.when(lists, names).when(none, F.array().cast("array<string>")))
    x = x.groupBy("target").agg(F.count("__names").alias("reports"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__names")))).alias("axioms"))
    outside = F.filter("axioms", lambda s: ~s.isin(*allowed))
    return x.withColumn("outside", outside).withColumn("accepted", (F.col("reports") > 0) & (F.size("outside") == 0))


def replay_faults(records: DataFrame, replays: DataFrame, environment: str | None = None, whole: str = "mathlib:") -> DataFrame:
    """proof_id, field: where a replay belongs to another source, target or environment than its record, or to none.

    records: (id, theorem_id, body, source_artifact); replays: (proof_id, theorem_id, body_sha256, environment,
    source_artifact). Theorems whose id begins with `whole` are replayed with all of their file, so the artifact counts.
    """
    r = records.select(F.col("id").alias("proof_id"), F.col("theorem_id").alias("__t"), F.sha2("body", 256).alias("__b"), F.col("source_artifact").alias("__s"))
    x = replays.join(r.withColumn("__has", F.lit(True)), "proof_id", "left")
    same = lambda a, b: F.col(a).eqNullSafe(b)
    checks = {"proof_id": F.coalesce("__has", F.lit(False)), "theorem_id": same("theorem_id", F.col("__t")), "body_sha256": same("body_sha256", F.col("__b"))}
    if environment is not None:
        checks["environment"] = same("environment", F.lit(environment))
    checks["source_artifact"] = ~F.coalesce(F.col("__t").startswith(whole), F.lit(False)) | same("source_artifact", F.col("__s"))
    wrong = F.array_compact(F.array(*(F.when(~ok, F.lit(field)) for field, ok in checks.items())))
    # a replay of no record has one fault
    wrong = F.when(F.col("__has"), wrong).otherwise(F.array(F.lit("proof_id")))
    return x.select("proof_id", F.explode(wrong).alias("field"))
