"""Quality classifier: a sparse rule ensemble, compiled into Spark columns.

Statistics of every text are built-in Spark expressions. On a bounded sample
of labelled rows, boosted shallow trees are grown; every path from a root to a
node is a rule, the conjunction of its conditions. A lasso logistic regression
over the rules keeps the few that matter. These become one Spark expression
per rule, so scoring all texts is a scan without user functions or shuffles.

Null texts count as empty; all statistics of an empty text are 0. Rows that
repeat are scored row by row. Labels that are null or have no text are not
learned from; of an id that has both labels, 1 counts. Without labels, or with
one class only, the score is constant. Other columns are never read. A table
without rows gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsheet.llm import common
from loomsheet.llm.quality_rules import SPACE, STOP_WORDS, SYMBOL, WORD

FEATURES = (
    "log_words", "word_length", "symbols", "stop_words", "duplicate_lines", "distinct_words", "upper", "digits", "stops", "marks", "line_words", "repeats",
)


@dataclass(frozen=True)
class Settings:
    """``rows``: labelled rows that are learned from, at most."""

    rows: int = 6000
    trees: int = 30
    depth: int = 3
    rate: float = 0.3
    bins: int = 48
    least: int = 10
    penalties: tuple[float, ...] = (0.0005, 0.002, 0.006)
    steps: int = 250


Condition = tuple[int, bool, float]  # feature, whether above the threshold (else at most it), threshold


@dataclass(frozen=True)
class Model:
    rules: tuple[tuple[Condition, ...], ...]
    weights: tuple[float, ...]
    bias: float


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and FEATURES (doubles, never null) of every row."""
    step = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    step = step.select("doc_id", "_t", F.array_remove(F.split("_t", SPACE), "").alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)).alias("_l"))
    words, lines, letters = F.size("_w"), F.size("_l"), F.length(F.array_join("_w", ""))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return step.select(
        "doc_id",
        F.log1p(words).alias("log_words"),
        share(letters, words).alias("word_length"),
        share(F.regexp_count("_t", F.lit(SYMBOL)), words).alias("symbols"),
        share(F.size(F.filter("_w", lambda w: w.isin(*STOP_WORDS))), words).alias("stop_words"),
        share(lines - F.size(F.array_distinct("_l")), lines).alias("duplicate_lines"),
        share(F.size(F.array_distinct("_w")), words).alias("distinct_words"),
        share(F.regexp_count("_t", F.lit("[A-Z]")), letters).alias("upper"),
        share(F.regexp_count("_t", F.lit("[0-9]")), letters).alias("digits"),
        share(F.regexp_count("_t", F.lit("[.;:?]")), words).alias("stops"),
        share(F.regexp_count("_t", F.lit("[!]")), words).alias("marks"),
        share(words, lines).alias("line_words"),
        share(F.size(F.filter("_w", lambda w, k: w == F.get(F.col("_w"), k + 1))), words).alias("repeats"),
    )


def _grow(x: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, slope: np.ndarray, curve: np.ndarray, s: Settings) -> tuple[list, np.ndarray]:
    """One tree on second-order loss: its nodes as paths, and its output for every row."""
    paths: list[tuple[Condition, ...]] = []
    out = np.zeros(len(x))

    def split(rows: np.ndarray, path: tuple[Condition, ...]) -> None:
        if path:
            paths.append(path)
        g, h = slope[rows].sum(), curve[rows].sum()
        best = (1e-6, -1, 0)
        if len(path) < s.depth and len(rows) >= 2 * s.least:
            for f in range(x.shape[1]):
                if not len(cuts[f]):
                    continue
                b = binned[rows, f]
                size = len(cuts[f]) + 1
                gs, hs, ns = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (slope[rows], curve[rows], None))
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < s.least) | (len(rows) - ns < s.least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        _, f, k = best
        if f < 0:
            out[rows] = -g / (h + 1)
            return
        above = binned[rows, f] > k
        cut = float(cuts[f][k])
        split(rows[~above], (*path, (f, False, cut)))
        split(rows[above], (*path, (f, True, cut)))

    split(np.arange(len(x)), ())
    return paths, out


def _merged(path: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """The path with one threshold at most for each feature and direction."""
    tight: dict[tuple[int, bool], float] = {}
    for f, above, cut in path:
        had = tight.get((f, above))
        tight[f, above] = cut if had is None else (max if above else min)(had, cut)
    return tuple(sorted((f, above, cut) for (f, above), cut in tight.items()))


def holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, above, cut in rule:
        ok &= (x[:, f] > cut) if above else (x[:, f] <= cut)
    return ok


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for the logistic loss; the bias isn't penalised."""
    n, width = z.shape
    w, bias = np.zeros(width), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, c, t = w.copy(), bias, 1.0
    rate = 4.0 / max(1e-9, np.linalg.norm(np.column_stack([z, np.ones(n)]), 2) ** 2 / n)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ v + c)))
        new = v - rate * (z.T @ (p - y) / n)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_bias = c - rate * float((p - y).mean())
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / later * (new - w), new_bias + (t - 1) / later * (new_bias - bias)
        w, bias, t = new, new_bias, later
    return w, bias


def learn(x: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Model:
    """``y``: 0 or 1. The penalty is chosen by the loss on every fifth row."""
    if not len(y) or y.min() == y.max():
        rate = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        return Model((), (), float(np.log(rate / (1 - rate))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, s.bins + 2)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    found: dict[tuple[Condition, ...], None] = {}
    score = np.zeros(len(y))
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-score))
        paths, out = _grow(x, cuts, binned, p - y, p * (1 - p), s)
        score += s.rate * out
        found.update(dict.fromkeys(map(_merged, paths)))
    distinct: dict[bytes, tuple[Condition, ...]] = {}
    for rule in sorted(found, key=len):
        distinct.setdefault(np.packbits(holds(rule, x)).tobytes(), rule)
    rules = list(distinct.values())
    z = np.column_stack([holds(r, x) for r in rules]).astype(np.float64)
    test = np.arange(len(y)) % 5 == 4
    tried = []
    for penalty in s.penalties:
        w, b = _lasso(z[~test], y[~test], penalty, s.steps)
        m = z[test] @ w + b
        tried.append((float(np.mean(np.logaddexp(0, m) - y[test] * m)), penalty))
    w, b = _lasso(z, y, min(tried)[1], s.steps)
    keep = np.flatnonzero(np.abs(w) > 1e-4)
    return Model(tuple(rules[k] for k in keep), tuple(float(w[k]) for k in keep), float(b))


def compiled(model: Model) -> Column:
    """The score as an expression over FEATURES."""
    total = F.lit(model.bias)
    for rule, weight in zip(model.rules, model.weights, strict=True):
        ok = F.lit(True)
        for f, above, cut in rule:
            c = F.col(FEATURES[f])
            ok = ok & ((c > cut) if above else (c <= cut))
        total = total + F.when(ok, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from at most ``rows`` labelled documents, chosen by a hash of their id; of an id with several texts, the one of the least hash."""
    ids = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    ids = ids.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.rows)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL").join(F.broadcast(ids), "doc_id")
    stats = statistics(chosen.select(F.struct("doc_id", "y", F.xxhash64("text").alias("h")).alias("k"), "text"), "k")
    one = stats.groupBy("doc_id.doc_id", "doc_id.y").agg(F.min(F.struct("doc_id.h", *FEATURES)).alias("s")).select("doc_id", "y", *(f"s.{f}" for f in FEATURES))
    rows = one.toPandas().sort_values(["doc_id", *FEATURES])
    return learn(rows[list(FEATURES)].to_numpy(np.float64), rows.y.to_numpy(np.float64), settings)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score, predicted, and the statistics."""
    out = statistics(docs, id_col, text_col).withColumn("score", compiled(model))
    return out.select("doc_id", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), *FEATURES)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op2_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out()))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op2_rule_ensemble": op2_rule_ensemble}
ORACLE: dict[str, str] = {}
