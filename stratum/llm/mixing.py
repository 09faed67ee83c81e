"""Operator 8: mixing to target weights with soft domain membership. Native."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import materialise, text_or_empty
from stratum.session import checkpoint_dir

#: The classifier is fitted on about this many labelled rows, chosen by a hash of their id; so the broadcast of
#: their ids and labels is bounded as well.
SAMPLE_ROWS = 20_000
WORD_SLOTS = 4096
#: Domains of the labels table and the shares of the tokens they should get.
TARGETS = {"high": 0.80, "low": 0.15, "toxic": 0.05}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table: toxic, else high or low by quality; rows without both labels say nothing."""
    return labels.where("doc_id is not null and quality is not null and toxic is not null") \
        .select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").otherwise("low").alias("domain"))


def _unit(key: Column, salt: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 30)) / float(1 << 30)


def _with_features(rows: DataFrame) -> DataFrame:
    """n_tokens (runs of letters and runs of other signs) and features: which token slots occur, and how often tokens repeat."""
    rows = rows.withColumn("_tokens", F.regexp_extract_all(F.lower("_text"), F.lit(r"\p{L}+|[^\p{L}\s]+"), F.lit(0)))
    rows = HashingTF(inputCol="_tokens", outputCol="_words", numFeatures=WORD_SLOTS, binary=True).transform(rows)
    rows = rows.withColumn("n_tokens", F.size("_tokens").cast("bigint")) \
        .withColumn("_distinct", F.size(F.array_distinct("_tokens")) / F.greatest(F.size("_tokens"), F.lit(1)))
    return VectorAssembler(inputCols=["_words", "_distinct"], outputCol="_features").transform(rows)


def domain_posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text",
                      sample_rows: int = SAMPLE_ROWS, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: ``id_col``, n_tokens, posterior (array in the order of ``domains``), ``carry``.

    ``labelled`` (doc_id, domain) may cover any part of the rows. With one domain among the labels everything belongs to it,
    without any the posterior is even. Null texts have no tokens."""
    carry = carry or {}
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"), *[v.alias(k) for k, v in carry.items()])
    known = labelled.where(F.col("domain").isin(domains)).select(F.col("doc_id").alias("_lid"), "domain")
    n = known.count()
    chosen = known.where(_unit(F.col("_lid"), "mixing") < min(1.0, sample_rows / max(n, 1)))
    train = _with_features(rows.join(F.broadcast(chosen), F.col("_id") == F.col("_lid"), "inner"))
    train = materialise(train.select("_features", (F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain")) - 1).cast("double").alias("label")), "op8-train")
    seen = sorted(int(r[0]) for r in train.select("label").distinct().collect())
    if len(seen) < 2:
        even = F.array(*[F.lit((1.0 if k in seen else 0.0) if seen else 1.0 / len(domains)) for k in range(len(domains))])
        return _with_features(rows).select(F.col("_id").alias(id_col), "n_tokens", even.alias("posterior"), *carry)
    model = LogisticRegression(featuresCol="_features", probabilityCol="_prob", family="multinomial", regParam=0.003, maxIter=40).fit(train)
    prob = vector_to_array("_prob")
    return model.transform(_with_features(rows)).withColumn("_p", prob).select(
        F.col("_id").alias(id_col), "n_tokens",
        F.array(*[F.coalesce(F.get("_p", F.lit(k)), F.lit(0.0)) for k in range(len(domains))]).alias("posterior"), *carry)


def fit_rates(rows: DataFrame, targets: list[float], budget: float | None = None, rounds: int = 60, tolerance: float = 1e-4,
              write_every: int = 10) -> DataFrame:
    """``rows`` (with n_tokens and posterior) plus rate: the nonnegative number of times each row should be read.

    Least squares over the rates by projected gradient: with a = n_tokens * posterior, the residual is sum(rate * a) minus
    the targets' shares of ``budget`` tokens (default: all there are). It is measured in the metric of the inverse of
    sum(a a'), where the step 1 is safe. From rate 1, each round is one sum of a few numbers over the rows and
    rate = max(0, rate - a . metric . residual); the rates are written to the shared folder every few
    rounds. Ends when the residual is below ``tolerance`` of the budget or stops shrinking. Rows without
    tokens keep rate 1."""
    k = len(targets)
    a = [F.col("n_tokens") * F.get("posterior", F.lit(i)) for i in range(k)]
    gram = rows.agg(F.sum("n_tokens"), *[F.sum(a[i] * a[j]) for i in range(k) for j in range(i, k)]).first()
    total = float(gram[0] or 0)
    state = rows.withColumn("rate", F.lit(1.0))
    if not total:
        return state
    goal = np.array(targets) / sum(targets) * (budget or total)
    g, at = np.zeros((k, k)), 1
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = gram[at]
            at += 1
    metric = np.linalg.pinv(g + np.eye(k) * 1e-9 * np.trace(g))
    last = np.inf
    for step in range(rounds):
        if step % write_every == write_every - 1:
            state = materialise(state, "op8-rates")
        sums = state.agg(*[F.sum(F.col("rate") * a[i]) for i in range(k)]).first()
        off = np.array([float(v) for v in sums]) - goal
        size = float(off @ metric @ off)
        if np.abs(off).sum() <= tolerance * goal.sum() or size >= last * (1 - 1e-9):
            break
        last = size
        pull = metric @ off
        slope = sum((a[i] * float(pull[i]) for i in range(1, k)), a[0] * float(pull[0]))
        state = state.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - slope))
    return state


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text",
        carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: ``id_col``, n_tokens, posterior, rate, copies, ``carry``.

    ``copies`` is the rate rounded up or down by a hash of the id, so that it is the rate on average. Repeated rows and null ids are rows
    of their own; an empty table gives an empty result. Sources or copies that make up much of the table need
    no care: every step is a sum over rows."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    targets = targets or TARGETS
    domains = sorted(targets)
    rows = materialise(domain_posteriors(docs, labelled, domains, id_col, text_col, carry={f"_c_{c}": v for c, v in (carry or {}).items()}), "op8-posteriors")
    rows = fit_rates(rows, [targets[d] for d in domains])
    up = _unit(F.col(id_col), "copies") < F.col("rate") - F.floor("rate")
    return rows.select(id_col, "n_tokens", "posterior", "rate", (F.floor("rate") + up.cast("int")).cast("int").alias("copies"),
                       *[F.col(f"_c_{c}").alias(c) for c in carry or {}])
