"""Soft-membership mixing, in DataFrame functions only: domain posteriors, then rates that meet target token totals.

A naive Bayes classifier over words, trained on the labelled table, gives each
document its posterior over the domains. A document's expected tokens in a
domain are its tokens times the posterior; nonnegative rates (expected uses of
each document) are fitted so that the domains' expected totals match their
targets: least squares over the domains, each residual measured against the
domain's size, by projected gradient from rate 1. Where documents may be used
``most`` times only, rates are projected onto 0 <= rate <= most, so the totals
fitted are those of the rates returned.

A document's gradient is its posteriors' share of one number per domain, so the
rounds add up to one number per domain: a document's rate is the projection of
1 - p . gradient, whatever the number of rounds, and documents of equal
posterior get equal rates. A round scales the domains' gaps by the inverse Gram
matrix of the documents between their bounds and tries three step lengths; totals
and matrix come from the same single aggregation of flat columns. Between rates
of equal totals those nearest to 1 are taken (a pull of weight ``RIDGE``).

Training reads about ``train_docs`` labelled documents, chosen by a hash of
doc_id, and keeps the ``features`` most telling words; totals, posteriors and
rates cover all documents.

Defined results: rows that share a doc_id are one document (a null doc_id
too). A null text has no tokens; a document without telling words has the
domains' shares among the labelled documents as its posterior. Equally telling
words are taken in alphabetical order. Without labels all posteriors are
equal. A target that cannot be met is met as closely as least squares allows.
An empty table gives no rows; extra columns are ignored (or kept, by
:func:`resample`). Texts are read whole.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import fresh, materialize

DOMAINS = ("high", "low", "toxic")
TRAIN_DOCS, FEATURES, SUPPORT, PRIOR_DOCS = 12_000, 3_000, 5, 10.0
#: Rounds end when no domain misses its target by more than this share of the target (of its size, where the target is 0), or
#: when two rounds running moved no total by more than the share SETTLED.
ROUNDS, TOLERANCE, SETTLED = 60, 5e-4, 2e-5
#: Step lengths that a round tries, and the weight of the pull towards rate 1.
STEPS, RIDGE = (3.0, 1.0, 0.25), 1e-7
#: Rates this near to a whole number are that number.
SNAP = 1e-5


def words(text: Column) -> Column:
    """Lower-cased words; consecutive separators leave empty strings."""
    text = F.lower(text)
    for c in "\t\r\f\v\n":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.split(text, " ")


def labelled_domains(labels: DataFrame) -> DataFrame:
    """``label_id, domain``: toxic if any label says so, else low if any says so, else high; null labels are none."""
    rows = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id"))
    domain = F.when(F.col("t") == 1, "toxic").when(F.col("q") == 0, "low").when(F.col("q") == 1, "high")
    return (rows.agg(F.max("toxic").alias("t"), F.min("quality").alias("q"))
            .select("label_id", domain.alias("domain")).filter("domain is not null"))


def train(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...] = DOMAINS, train_docs: int = TRAIN_DOCS,
          features: int = FEATURES) -> tuple[DataFrame, list[float]]:
    """``feature, weights`` (a log-likelihood ratio for each domain; at most ``features`` rows) and the domains' log-priors."""
    known = labelled_domains(labels)
    rate = min(1.0, train_docs / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < rate * 1_000_000)
    # about train_docs short rows, by the rate
    sample = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    sample = materialize(sample.select("domain", F.array_distinct(words(F.col("text"))).alias("ws")))
    sizes = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per domain
    n = [sizes.get(k, 0) for k in domains]
    counts = (sample.select("domain", F.explode("ws").alias("feature")).filter("feature <> ''").groupBy("feature")
              .agg(*[F.sum((F.col("domain") == k).cast("int")).alias(f"n{i}") for i, k in enumerate(domains)]))
    total = sum(F.col(f"n{i}") for i in range(len(domains)))
    overall = (total + 0.5) / F.lit(sum(n) + 1)
    # each domain's counts with PRIOR_DOCS more documents of the overall kind: few labels give weak evidence
    ratios = [F.log((F.col(f"n{i}") + PRIOR_DOCS * overall) / F.lit(n[i] + PRIOR_DOCS) / overall) for i in range(len(domains))]
    telling = sum(F.col(f"n{i}") * F.abs(r) for i, r in enumerate(ratios))
    model = (counts.filter(total >= SUPPORT).select("feature", F.array(*ratios).alias("weights"), telling.alias("telling"))
             .orderBy(F.desc("telling"), "feature").limit(features).drop("telling"))
    return materialize(model), [math.log((x + 1) / (sum(n) + len(n))) for x in n]


def posteriors(docs: DataFrame, model: DataFrame, priors: list[float]) -> DataFrame:
    """``doc_id, tokens, p``: one row per document, ``p`` its domain posteriors in the order of the priors."""
    found = docs.select("doc_id", F.explode_outer(words(F.col("text"))).alias("w"))
    found = found.join(F.broadcast(model), F.col("w") == F.col("feature"), "left")   # as many rows as the model has features
    k = range(len(priors))
    sums = found.groupBy("doc_id").agg(
        F.count(F.when(F.col("w") != "", 1)).alias("tokens"),
        *[F.coalesce(F.sum(F.get("weights", F.lit(i))), F.lit(0.0)).alias(f"s{i}") for i in k])
    logs = [F.col(f"s{i}") + F.lit(priors[i]) for i in k]
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    odds = [F.exp(x - top) for x in logs]
    return sums.select("doc_id", "tokens", F.array(*[o / sum(odds[1:], odds[0]) for o in odds]).alias("p"))


def _rate(p: list[Column], gradient: list[float], most: float) -> tuple[Column, Column]:
    """The point that the summed-up gradient leads to from rate 1, and its projection onto 0 <= rate <= most."""
    y = F.lit(1.0)
    for x, g in zip(p, gradient):
        y = y - x * F.lit(float(g))
    return y, F.least(F.greatest(F.lit(0.0), y), F.lit(float(most)))


def _measure(rows: DataFrame, k: int, gradients: list[list[float]], most: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each gradient, in one aggregation: the domains' totals, the Gram matrix of the documents between their bounds,
    and the tokens times the integral of the rate (what a step must not increase, but for the targets' part)."""
    p = [F.col(f"p{i}") for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    x, sums = rows, []
    for n, gradient in enumerate(gradients):
        y, rate = _rate(p, gradient, most)
        x = x.withColumn(f"y{n}", y)
        y, rate = F.col(f"y{n}"), F.least(F.greatest(F.lit(0.0), F.col(f"y{n}")), F.lit(float(most)))
        used, free = F.col("tokens") * rate, F.when((y > 0) & (y < most), F.col("tokens")).otherwise(0)
        area = F.when(y <= 0, 0.0).when(y >= most, y * most - F.lit(most * most / 2 if math.isfinite(most) else 0.0)).otherwise(y * y / 2)
        sums += [F.sum(used * c) for c in p] + [F.sum(free * p[i] * p[j]) for i, j in pairs] + [F.sum(F.col("tokens") * area)]
    found = [v or 0.0 for v in x.agg(*sums).first()]
    out, width = [], k + len(pairs) + 1
    for n in range(len(gradients)):
        own, gram = found[n * width:(n + 1) * width], np.zeros((k, k))
        for (i, j), v in zip(pairs, own[k:]):
            gram[i, j] = gram[j, i] = v
        out.append((np.array(own[:k]), gram, own[-1]))
    return out


def fit_gradient(rows: DataFrame, targets: list[float], rounds: int = ROUNDS, tolerance: float = TOLERANCE,
                 most: float = math.inf) -> list[float]:
    """The gradient, summed over the rounds, whose rates meet the targets. rows: tokens, p0, p1, ..."""
    k, target = len(targets), np.array(targets, dtype=float)
    [(total, gram, area)] = _measure(rows, k, [[0.0] * k], math.inf)                   # every rate is 1
    sizes, tokens = total, 2 * area
    own, scale = np.where(target > 0, target, sizes), np.where(sizes > 0, sizes, 1.0)
    # the pull towards rate 1 that decides between rates of equal totals, against the domains' squared gaps
    pull = RIDGE * scale**2 / max(tokens, 1.0)
    at = np.zeros(k)
    value, reach, still = area, 1.0, 0
    if most <= 1:
        # all documents stand at their bound: the first step sees them as free
        [(total, _, value)] = _measure(rows, k, [[0.0] * k], most)
    for _ in range(rounds):
        gaps = np.where(sizes > 0, np.abs(total - target), 0)
        if (gaps <= tolerance * own).all() or still == 2:
            break
        left = total - target - pull * at
        step = np.linalg.lstsq(gram + np.diag(pull + 1e-9 * max(tokens, 1.0)), left, rcond=None)[0]
        tries = [at + reach * s * step for s in STEPS]
        found = _measure(rows, k, [t.tolist() for t in tries], most)
        worth = [area + t @ target + (pull * t * t).sum() / 2 for t, (_, _, area) in zip(tries, found)]
        best = int(np.argmin(worth))
        if worth[best] > value + 1e-12 * abs(value):
            reach *= STEPS[-1] ** 2                         # all went too far
            continue
        still = still + 1 if (np.abs(found[best][0] - total) <= SETTLED * own).all() else 0
        at, value, reach = tries[best], worth[best], min(1.0, reach * 4)
        total, gram, _ = found[best]
    return at.tolist()


def fit_rates(documents: DataFrame, targets: list[float], rounds: int = ROUNDS, tolerance: float = TOLERANCE,
              most: float = math.inf) -> DataFrame:
    """``documents`` (doc_id, tokens, p) with ``rate``: expected domain totals as near to ``targets`` as rates from 0 to
    ``most`` allow."""
    k = len(targets)
    p = [F.get("p", F.lit(i)) for i in range(k)]
    gradient = fit_gradient(documents.select("tokens", *[x.alias(f"p{i}") for i, x in enumerate(p)]), targets, rounds, tolerance, most)
    rate = _rate(p, gradient, most)[1]
    near = F.round(rate)
    return documents.withColumn("rate", F.when(F.abs(rate - near) <= SNAP, near).otherwise(rate))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float | None], share: float = 1.0, train_docs: int = TRAIN_DOCS,
        most: float = math.inf) -> DataFrame:
    """``doc_id, tokens, p, rate``: rates whose expected domain totals are ``share`` of all tokens times ``weights``.

    A weight of None asks for as much of the domain as there is. No rate exceeds ``most``.
    """
    domains = tuple(weights)
    model, priors = train(docs, labels, domains, train_docs)
    documents = materialize(posteriors(docs, model, priors))
    row = documents.agg(*[F.sum(F.col("tokens") * F.get("p", F.lit(i))) for i in range(len(domains))]).first()
    sizes = [v or 0.0 for v in row]
    targets = [s if w is None else w * share * sum(sizes) for s, w in zip(sizes, weights.values())]
    return fit_rates(documents, targets, most=most)


def resample(docs: DataFrame, rates: DataFrame, most: float = math.inf) -> DataFrame:
    """Rows of ``docs`` as often as their document's rate (``most`` at most) says: its whole part, and once more with
    the chance of its fraction, drawn by a hash of doc_id. A rate within 1e-3 of a whole number is that number."""
    rate, own = fresh(docs, "rate"), fresh(docs, "own")
    of = F.least("rate", F.lit(float(most)))
    near = F.when(F.abs(of - F.round(of)) <= 1e-3, F.round(of)).otherwise(of)
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("draw")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = (F.floor(near) + (drawn < near - F.floor(near)).cast("int")).cast("int")
    used = rates.select(F.col("doc_id").alias(own), copies.alias(rate)).filter(F.col(rate) > 0)
    joined = docs.join(used, docs["doc_id"].eqNullSafe(F.col(own)))
    return joined.withColumn(rate, F.explode(F.sequence(F.lit(1), F.col(rate)))).drop(rate, own)
