"""Quality scores by a sparse rule ensemble.

Statistics of each text are Spark columns. Boosted shallow trees are grown over the statistics of labelled
rows; every path from a root to a node is a conjunctive rule; lasso logistic regression keeps a few of the
rules with weights; the kept rules are compiled to one Spark column expression, by which all rows are
scored. The fit reads at most ``max_fit_rows`` labelled rows (those with the smallest id hashes);
statistics and scores cover every row.

Defined cases: a null text is empty, an empty text's statistics are 0, and it is scored by them as any other; rows
with the same id are scored each; a label counts for all rows with its id; labels without a document are
not used; with no labels, or labels of one class, the score is that class's share (0.5 with none); very long texts are counted whole; ties
in the sample go by id; an empty table gives an empty one; columns other than id and text aren't read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, id_text, least, stored

STATISTICS = ("chars", "words", "word_chars", "long_word", "distinct_words", "near_words", "distinct_lines", "lines", "letters", "capitals", "digits", "spaces", "stops", "commas", "bars", "marks", "runs")

#: Words among which near repetition is counted.
WINDOW = 200


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of ``doc_id, text`` rows."""
    none = F.array().cast("array<string>")
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = docs.select("doc_id", "text", F.when(flat == "", none).otherwise(F.split(flat, " ")).alias("w"), F.when(F.col("text") == "", none).otherwise(F.split("text", "\n")).alias("l"))
    n, words, lines = F.length("text"), F.size("w"), F.size("l")
    of = lambda x, y: F.coalesce(x / F.nullif(y, F.lit(0)), F.lit(0.0))
    without = lambda pattern: n - F.length(F.regexp_replace("text", pattern, ""))
    count = lambda c: n - F.length(F.replace(F.col("text"), F.lit(c), F.lit("")))
    # The share of distinct words in each run of WINDOW words, over all runs of the text.
    distinct = F.aggregate(F.sequence(F.lit(0), F.floor((F.greatest(words, F.lit(1)) - 1) / WINDOW).cast("int")), F.lit(0), lambda k, i: k + F.size(F.array_distinct(F.slice("w", i * WINDOW + 1, WINDOW))))
    cols = {
        "chars": F.log1p(n), "words": F.log1p(words), "word_chars": of(n, words), "long_word": F.log1p(F.array_max(F.transform("w", F.length))),
        "distinct_words": of(F.size(F.array_distinct("w")), words), "near_words": of(distinct, words), "distinct_lines": of(F.size(F.array_distinct("l")), lines), "lines": of(lines, words),
        "letters": of(without(r"\p{L}+"), n), "capitals": of(without(r"\p{Lu}+"), n), "digits": of(without(r"\p{N}+"), n), "spaces": of(words, n),
        "stops": of(count("."), words), "commas": of(count(","), words), "bars": of(count("|"), words), "marks": of(without(r"[^\p{L}\p{N}\s.,|]+"), n), "runs": of(without(r"([^\s\p{L}])\1{2,}"), n),
    }
    return rows.select("doc_id", *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in cols.items()))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, over?, bound) all of which must hold


@dataclass
class Rules:
    intercept: float = 0.0
    terms: list[tuple[Rule, float]] = field(default_factory=list)

    def column(self) -> Column:
        """The score as a column expression over STATISTICS."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.terms:
            holds = F.lit(True)
            for k, over, bound in rule:
                c = F.col(STATISTICS[k])
                holds = holds & ((c > F.lit(bound)) if over else (c <= F.lit(bound)))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def grow(x: np.ndarray, r: np.ndarray, cuts: list[np.ndarray], bins: np.ndarray, rows: np.ndarray, rule: Rule, depth: int, out: list[Rule], step: np.ndarray, least: int) -> None:
    """A regression tree of the residuals ``r``: its nodes' rules go to ``out``, its leaves' means to ``step``."""
    if rule:
        out.append(rule)
    total, n = r[rows].sum(), len(rows)
    best = (1e-9, -1, -1)
    if depth and n >= 2 * least:
        for k in range(x.shape[1]):
            if not len(cuts[k]):
                continue
            b = bins[rows, k]
            size, mass = np.bincount(b, minlength=len(cuts[k]) + 1), np.bincount(b, r[rows], len(cuts[k]) + 1)
            left, sums = np.cumsum(size)[:-1], np.cumsum(mass)[:-1]
            ok = (left >= least) & (n - left >= least)
            gain = np.where(ok, sums**2 / np.maximum(left, 1) + (total - sums) ** 2 / np.maximum(n - left, 1) - total**2 / n, 0)
            if gain[j := int(np.argmax(gain))] > best[0]:
                best = (float(gain[j]), k, j)
    if best[1] < 0:
        step[rows] = total / n
        return
    _, k, j = best
    for over in (False, True):
        side = rows[(bins[rows, k] > j) == over]
        grow(x, r, cuts, bins, side, (*rule, (k, over, float(cuts[k][j]))), depth - 1, out, step, least)


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for k, over, bound in rule:
        out &= (x[:, k] > bound) == over
    return out


def simple(rule: Rule) -> Rule:
    """The rule with the tightest bound for each statistic and side, in order."""
    tight: dict[tuple[int, bool], float] = {}
    for k, over, bound in rule:
        tight[k, over] = max(bound, tight.get((k, over), bound)) if over else min(bound, tight.get((k, over), bound))
    return tuple((k, over, b) for (k, over), b in sorted(tight.items()))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, penalty: float = 2e-3, rounds: int = 400) -> Rules:
    """Boosted trees, their rules, and lasso logistic weights by accelerated proximal gradient."""
    if len(y) == 0 or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return Rules(float(np.log(p / (1 - p))))
    cuts = [(u[:-1] + u[1:]) / 2 for u in (np.unique(np.quantile(x[:, k], np.linspace(0, 1, 65))) for k in range(x.shape[1]))]
    bins = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    z, found, least = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), [], max(2, len(y) // 500)
    for _ in range(trees):
        step, r = np.zeros(len(y)), y - 1 / (1 + np.exp(-z))
        grow(x, r, cuts, bins, np.arange(len(y)), (), depth, found, step, least)
        z += rate * 4 * step
    rules = sorted({simple(r) for r in found})
    a = np.stack([holds(x, r) for r in rules], axis=1).astype(np.float32)
    mean, sd = a.mean(0), a.std(0) + 1e-6
    a = (a - mean) / sd
    b0, b = float(np.log(y.mean() / (1 - y.mean()))), np.zeros(a.shape[1], dtype=np.float32)
    v = np.ones(a.shape[1], dtype=np.float32)  # the largest singular value, by powers
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    bound = 0.25 * (float(np.linalg.norm(a @ v)) ** 2 / len(y) + 1)
    y32, old, t, at = y.astype(np.float32), b, 1.0, b
    for _ in range(rounds):
        e = 1 / (1 + np.exp(-(a @ at + b0))) - y32
        new = at - (a.T @ e / len(y)) / bound
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / bound, 0)
        b0 -= float(e.mean()) / bound
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        at, old = new + (last - 1) / t * (new - old), new
    kept = np.flatnonzero(old)
    return Rules(b0 - float((old[kept] * mean[kept] / sd[kept]).sum()), [(rules[k], float(old[k] / sd[k])) for k in kept])


def train(stats: DataFrame, labels: DataFrame, label_col: str, max_fit_rows: int = 20_000) -> Rules:
    """``labels``: doc_id and a 0/1 column. Held-out ids are not read."""
    known = labels.filter(~held_out()).select("doc_id", F.col(label_col).cast("double").alias("label")).dropna().dropDuplicates(["doc_id"])
    rows = stats.join(known, "doc_id").withColumn("at", F.xxhash64("doc_id"))
    sample = rows.filter(F.col("at") <= least(rows.count(), max_fit_rows)).orderBy("at", "doc_id").limit(max_fit_rows)
    got = np.array([tuple(r) for r in sample.select(*STATISTICS, "label").collect()], dtype=float).reshape(-1, len(STATISTICS) + 1)
    return fit(got[:, :-1], got[:, -1])


def quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", max_fit_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    stats = stored(statistics(id_text(docs, id_col, text_col)), "statistics")
    rules = train(stats, labels, label_col, max_fit_rows)
    return stats.select("doc_id", held_out().alias("held_out"), rules.column().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
