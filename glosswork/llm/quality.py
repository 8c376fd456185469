"""Quality classifier: a sparse rule ensemble.

Trees on simple text statistics give conjunctive rules (the path to each node);
a lasso logistic regression keeps few of them; the rules compile into one Spark
column expression, so scoring is a projection.

Training reads at most SAMPLE labelled rows (the smallest hashes of their ids,
a documented bound; of rows that repeat an id, the one with the least statistics,
and of labels that differ, the least); the statistics, the trees' cut points and the weights come
from those, the lasso's strength from a quarter of them set aside; scoring covers every row. Labels, language, source and identifier
are never inputs.

Defined cases: null text counts as empty; empty texts have all statistics zero
and get a score like any other; labels are used from rows outside the held-out
fold alone; without labels of both classes the score is the share of label 1
(0.5 without any); repeated rows give repeated rows; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import table, text_of

SAMPLE, FOLDS, THRESHOLD = 8000, 5, 0.3
TREES, DEPTH, LEAF, BINS = 24, 3, 20, 24
#: Strengths of the lasso that are tried.
STRENGTHS = (2e-2, 1e-2, 5e-3, 2.5e-3, 1.25e-3)


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text, all doubles."""
    chars = F.length(text).cast("double")
    some = F.greatest(chars, F.lit(1.0))
    drop = lambda c: (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) / some
    words = F.split(F.trim(text), r"[ \n\t\r]+")
    n = F.greatest(F.size(words).cast("double"), F.lit(1.0))
    return {
        "chars": F.log1p(chars),
        "words": F.log1p(n),
        "word_chars": chars / n,
        "distinct": F.size(F.array_distinct(words)) / n,
        "upper": F.regexp_count(text, F.lit(r"[A-ZÀ-Þ]")) / some,
        "digits": F.regexp_count(text, F.lit("[0-9]")) / some,
        "shouts": drop("!"),
        "bars": drop("|"),
        "symbols": F.regexp_count(text, F.lit(r"[%*#$&@~^=<>{}\\]")) / some,
        "stops": drop("."),
        "commas": drop(","),
        "lines": drop("\n"),
        "odd": F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,;:!?'\"()-]")) / some,
    }


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0


def grow(x, y, rng, depth: int = DEPTH, leaf: int = LEAF):
    """Rules (tuples of (feature, is_at_most, cut)) of every node of one tree."""
    import numpy as np

    rules = []

    def split(rows, path):
        if path:
            rules.append(tuple(path))
        if len(path) == depth or len(rows) < 2 * leaf:
            return
        best = (1e-9, None, None)
        for f in rng.choice(x.shape[1], max(3, x.shape[1] // 2), replace=False):
            v, t = x[rows, f], y[rows]
            for cut in np.unique(np.quantile(v, np.linspace(0.02, 0.98, BINS))):
                low = v <= cut
                n = low.sum()
                if leaf <= n <= len(rows) - leaf:
                    a, b = t[low].mean(), t[~low].mean()
                    gain = n * (len(rows) - n) / len(rows) * (a - b) ** 2
                    if gain > best[0]:
                        best = (gain, f, cut)
        _, f, cut = best
        if f is None:
            return
        low = x[rows, f] <= cut
        split(rows[low], [*path, (int(f), True, float(cut))])
        split(rows[~low], [*path, (int(f), False, float(cut))])

    split(np.sort(rng.choice(len(y), len(y))), [])
    return rules


def applies(x, rule):
    import numpy as np

    out = np.ones(len(x), bool)
    for f, at_most, cut in rule:
        out &= (x[:, f] <= cut) == at_most
    return out


def lasso(z, y, strength: float, steps: int = 400):
    """(weights, bias) of L1 logistic regression by accelerated proximal steps."""
    import numpy as np

    n, k = z.shape
    mean = z.mean(axis=0)
    scale = np.maximum(z.std(axis=0), 0.05)
    s = (z - mean) / scale
    w, bias, v, vb, t = np.zeros(k), 0.0, np.zeros(k), 0.0, 1.0
    u = np.ones(k) / max(k, 1) ** 0.5
    for _ in range(20):
        u = s.T @ (s @ u)
        u /= np.linalg.norm(u) or 1.0
    step = 1 / (0.25 * np.linalg.norm(s @ u) ** 2 / n + 0.25)
    for _ in range(steps):
        err = 1 / (1 + np.exp(-np.clip(s @ v + vb, -30, 30))) - y
        new = v - step * (s.T @ err) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * strength, 0)
        new_b = vb - step * err.mean()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - bias)
        w, bias, t = new, new_b, t2
    return w / scale, bias - float((w * mean / scale).sum())


def log_losses(z, y, weights, bias):
    import numpy as np

    total = np.clip(z @ weights + bias, -30, 30)
    return np.logaddexp(0, total) - y * total


def chosen_strength(z, y, strengths=STRENGTHS, every: int = 4) -> float:
    """The strongest lasso whose loss on every fourth row, fitted on the others, is
    within one standard error of the least."""
    import numpy as np

    aside = np.arange(len(y)) % every == 0
    if y[~aside].min() == y[~aside].max():
        return max(strengths)
    losses = {s: log_losses(z[aside], y[aside], *lasso(z[~aside], y[~aside], s, steps=150)) for s in strengths}
    best = min(losses.values(), key=np.mean)
    limit = best.mean() + best.std() / len(best) ** 0.5
    return max(s for s, held in losses.items() if held.mean() <= limit)


def fit(x, y, seed: int = 7, trees: int = TREES, strength: float | None = None):
    """(rules with weights, bias); the lasso's strength is chosen on rows set aside unless given.

    However many rules the lasso keeps, all are compiled; there are at most
    2 ** (DEPTH + 1) - 2 a tree.
    """
    import numpy as np

    if len(y) == 0 or y.min() == y.max():
        share = 0.5 if len(y) == 0 else min(max(float(y.mean()), 0.01), 0.99)
        return [], float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    rules = sorted({r for _ in range(trees) for r in grow(x, y, rng)})
    rules = list({np.packbits(applies(x, r)).tobytes(): r for r in reversed(rules)}.values())  # one of those that hold for the same rows
    z = np.array([applies(x, r) for r in rules], np.float32).T
    w, bias = lasso(z, y, chosen_strength(z, y) if strength is None else strength)
    return [(r, float(c)) for r, c in zip(rules, w, strict=True) if abs(c) > 1e-6], float(bias)


def compile_rules(rules, bias: float, names: list[str]) -> Column:
    """The score as a column of the statistics' columns."""
    total = F.lit(bias)
    for rule, weight in rules:
        held = F.lit(True)
        for f, at_most, cut in rule:
            held = held & ((F.col(names[f]) <= cut) if at_most else (F.col(names[f]) > cut))
        total = total + F.when(held, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """(rules, bias, names) from at most sample labelled rows outside the held-out fold."""
    import numpy as np

    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("_label"))
    known = known.where(~held_out() & F.col("_label").isin(0.0, 1.0)).groupBy("doc_id").agg(F.min("_label").alias("_label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    stats = statistics(F.col("text"))
    rows = text_of(docs).join(F.broadcast(known), "doc_id").select("doc_id", F.struct("_label", *(c.alias(f"_{n}") for n, c in stats.items())).alias("_x"))
    # One row of those that repeat an id, so that at most sample rows reach the driver.
    rows = rows.groupBy("doc_id").agg(F.min("_x").alias("_x")).select("doc_id", "_x.*")
    got = np.array([list(r)[1:] for r in sorted(rows.collect(), key=lambda r: tuple(r))], float).reshape(-1, 1 + len(stats))
    rules, bias = fit(got[:, 1:], got[:, 0])
    return rules, bias, [f"_{n}" for n in stats]


def score(docs: DataFrame, model, carry: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted; with carry also _row, the row of docs."""
    rules, bias, names = model
    base = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")) if carry else text_of(docs)
    kept = ["doc_id", *(["_row"] if carry else [])]
    # A generator bounds the rewriting: a filter on the score would else be pushed
    # below and hold every statistic once for each condition of each rule.
    stats = F.struct(*(c.alias(n) for n, c in zip(names, statistics(F.col("text")).values(), strict=True)))
    rows = base.select(*kept, F.inline(F.array(stats)))
    rows = rows.select(*kept, F.coalesce(held_out(), F.lit(False)).alias("held_out"), compile_rules(rules, bias, names).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject, with all their columns."""
    return score(docs, train(docs, labels), carry=True).where("predicted = 1").select("_row.*")


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
