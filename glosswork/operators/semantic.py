"""Faithfulness of claims to evidence, and similarity of texts by token vectors.

Both take what judges a pair as a parameter: an entailment strategy (an
expression or an Arrow function of claim and evidence) and an embedding provider
(an Arrow function of tokens).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from glosswork.functions import text as T

# Words of a strategy's answer that mean support.
SUPPORTED = ("SUPPORTED", "ENTAILED", "TRUE", "YES")


def lexical(claim: Column, evidence: Column) -> Column:
    """Share of the claim's tokens, repeats included, that are among the evidence's; 0 without tokens."""
    words = claim["tokens"]
    hits = F.size(F.filter(words, lambda w: F.array_contains(evidence["tokens"], w)))
    return F.coalesce(F.try_divide(hits.cast("double"), F.size(words)), F.lit(0.0))


def coerced(pairs: DataFrame, name: str) -> Column:
    """A strategy's answer as a number from 0 to 1: booleans, numbers, words or numbers as text."""
    kind, value = pairs.schema[name].dataType.typeName(), F.col(name)
    if kind == "boolean":
        return F.coalesce(value.cast("double"), F.lit(0.0))
    number = value.try_cast("double")
    number = F.when(number.isNull() | F.isnan(number) | F.abs(number).isin(float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
    if kind == "string":
        number = F.when(F.upper(F.trim(value)).isin(*SUPPORTED), 1.0).otherwise(number)
    return number


def faithfulness(cases: DataFrame, key: Sequence[str], claims: str, evidence: str, strategy: Callable[[Column, Column], Column] = lexical, threshold: float = 0.8) -> DataFrame:
    """key, status, reason, claims_total, claims_supported, faithfulness, groundedness, unsupported (numbers of claims).

    claims: array of texts; evidence: array of structs with evidence_id and text.
    A strategy gets structs of text and tokens. Each claim meets the evidence of
    its own case; it is supported where the best score reaches the threshold.
    Faithfulness is the supported share, groundedness the mean of the best scores;
    both are null where a case has no evidence or no claims.
    """
    rows = cases.select(*key, F.coalesce(claims, F.expr("cast(array() as array<string>)")).alias("_claims"), evidence)
    named = [F.col(k).alias(f"_e_{k}") for k in key]
    whole = lambda text: F.struct(text.alias("text"), T.faithfulness_tokens(text).alias("tokens"))
    said = rows.select(*key, F.posexplode("_claims").alias("_n", "_text")).select(*key, "_n", whole(F.col("_text")).alias("_claim"))
    found = rows.select(*named, F.explode(evidence).alias("_x")).select(*(f"_e_{k}" for k in key), whole(F.col("_x.text")).alias("_evidence"))
    on = F.lit(True)
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_e_{k}"))
    pairs = said.join(found, on).select(*key, "_n", strategy(F.col("_claim"), F.col("_evidence")).alias("_score"))
    best = pairs.groupBy(*key, "_n").agg(F.max(coerced(pairs, "_score")).alias("_best"))
    lost = F.collect_list(F.when(F.col("_best") < threshold, F.col("_n")))
    sums = best.groupBy(*(F.col(k).alias(f"_e_{k}") for k in key)).agg(F.count_if(F.col("_best") >= threshold).alias("_supported"), F.round(F.avg("_best"), 12).alias("_mean"), F.array_sort(lost).alias("_lost"))
    met = rows.join(sums, on, "left")
    total = F.size("_claims")
    empty = F.coalesce(F.size(evidence), F.lit(0)) <= 0
    none = empty | (total == 0)
    return met.select(
        *key,
        F.when(none, "NOT_CALCULABLE").otherwise("CALCULATED").alias("status"),
        F.when(empty, "no_traceable_rag_context").when(total == 0, "no_claims").alias("reason"),
        total.alias("claims_total"),
        F.when(none, 0).otherwise(F.col("_supported")).cast("int").alias("claims_supported"),
        F.when(~none, F.col("_supported") / total).alias("faithfulness"),
        F.when(~none, F.col("_mean")).alias("groundedness"),
        F.when(~none, F.col("_lost")).alias("unsupported"),
    )


def hash_vectors(tokens: Sequence[str], dims: int = 32):
    """The default provider: byte i mod 32 of a token's SHA-256 over 127.5, less one."""
    import hashlib

    import numpy as np

    raw = np.frombuffer(b"".join(hashlib.sha256(t.encode()).digest() for t in tokens), np.uint8).reshape(-1, 32)
    return raw[:, np.arange(dims) % 32] / 127.5 - 1.0


def greedy_similarity(embed: Callable = hash_vectors, block: int = 1024):
    """A function of (tokens, weights) of candidate and reference: struct(precision, recall, f1).

    Each token takes its best cosine on the other side; the weighted means of the
    candidate's and the reference's are precision and recall. Products are made
    in blocks of tokens, so memory is that of a block and the vectors.
    """

    def unit(tokens):
        import numpy as np

        names = sorted(set(tokens))
        place = {t: i for i, t in enumerate(names)}
        v = np.asarray(embed(names), float)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        return v, np.array([place[t] for t in tokens])

    def mean(best, at, weights):
        import numpy as np

        w = np.asarray(weights, float)
        return float((best[at] * w).sum() / w.sum()) if w.sum() > 0 else float(best[at].mean())

    @pandas_udf("struct<precision double, recall double, f1 double>")
    def score(candidate, candidate_weights, reference, reference_weights):
        import numpy as np
        import pandas as pd

        out = []
        for c, cw, r, rw in zip(candidate, candidate_weights, reference, reference_weights, strict=True):
            if c is None or r is None or not len(c) or not len(r):
                out.append((None, None, None))
                continue
            (a, at), (b, bt) = unit(list(c)), unit(list(r))
            best_a, best_b = np.full(len(a), -1.0), np.full(len(b), -1.0)
            for i in range(0, len(a), block):
                for k in range(0, len(b), block):
                    near = a[i : i + block] @ b[k : k + block].T
                    best_a[i : i + block] = np.maximum(best_a[i : i + block], near.max(axis=1))
                    best_b[k : k + block] = np.maximum(best_b[k : k + block], near.max(axis=0))
            p, q = mean(best_a, at, cw), mean(best_b, bt, rw)
            out.append((p, q, 2 * p * q / (p + q) if p + q > 0 else 0.0))
        return pd.DataFrame(out, columns=["precision", "recall", "f1"], dtype="float64")

    return score


def _weighted(rows: DataFrame, side: str, weights: DataFrame | None) -> DataFrame:
    """_row, and the side's tokens with their weights in order."""
    words = rows.select("_row", F.posexplode(side).alias("_pos", "_token"))
    if weights is not None:
        words = words.join(weights, "_token", "left")
    weight = F.lit(1.0) if weights is None else F.col("_weight")
    listed = F.array_sort(F.collect_list(F.struct("_pos", "_token", weight.alias("_weight"))))
    words = words.groupBy("_row").agg(listed.alias("_l"))
    return words.select(F.col("_row").alias(f"_r{side}"), F.transform("_l", lambda x: x["_token"]).alias(f"_t{side}"), F.transform("_l", lambda x: x["_weight"]).alias(f"_w{side}"))


def bert_score(cases: DataFrame, key: Sequence[str], candidate: str, reference: str, embed: Callable = hash_vectors, idf: bool = True, block: int = 1024) -> DataFrame:
    """key, precision, recall, f1, status of texts by greedy similarity of token vectors.

    idf weighs a token by ln((n + 1) / (d + 1)), n references of which d hold it.
    Tokens are those of the semantic form between non-word characters. key names
    a case once. Without tokens on either side the scores are null.
    """
    tokens = lambda c: F.regexp_extract_all(T.semantic_form(F.col(c)), F.lit(r"(?U)\w+"), F.lit(0))
    rows = cases.select(F.struct(*key).alias("_row"), tokens(candidate).alias("c"), tokens(reference).alias("r"))
    weights = None
    if idf:
        n = rows.count()
        held = rows.select(F.explode(F.array_distinct("r")).alias("_token")).groupBy("_token").agg(F.count("*").alias("d"))
        # A token that no reference has counts most.
        asked = rows.select(F.explode(F.array_distinct(F.concat("c", "r"))).alias("_token")).distinct().join(held, "_token", "left")
        weights = asked.select("_token", F.log((F.lit(n) + 1.0) / (F.coalesce("d", F.lit(0)) + 1.0)).alias("_weight"))
    sides = [_weighted(rows, s, weights) for s in ("c", "r")]
    met = rows.select("_row").join(sides[0], F.col("_row").eqNullSafe(F.col("_rc")), "left").join(sides[1], F.col("_row").eqNullSafe(F.col("_rr")), "left")
    scored = met.select("_row.*", greedy_similarity(embed, block)("_tc", "_wc", "_tr", "_wr").alias("s"))
    return scored.select(*key, "s.*", F.when(F.col("s.f1").isNull(), "NOT_CALCULABLE").otherwise("CALCULATED").alias("status"))
