import math

import numpy as np
from pyspark.sql import functions as F

from chalkline.llm import mixing
from tests.llm.conftest import docs_frame, with_clashes

LABELS = "doc_id long, quality int, toxic int"


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    tokens = rng.integers(0, 500, 300)
    rows = [(i, int(n), [float(v) for v in q]) for i, (n, q) in enumerate(zip(tokens, p))]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, p array<double>")
    sizes = tokens @ p
    for targets in (sizes * [0.5, 1.0, 0.8], sizes * [1.5, 0.7, 1.0], sizes):
        got = mixing.fit_rates(df, list(map(float, targets))).orderBy("doc_id").collect()
        x = np.array([r.rate for r in got])
        assert (x >= 0).all()
        assert np.abs((tokens * x) @ p - targets).max() <= mixing.TOLERANCE * max(sizes.sum(), targets.sum())


def test_rare_domain_meets_its_target(spark):
    """Each gap counts against its own domain: one with 0.02 % of the tokens is fitted too."""
    rows = [(i, 1000, [1.0, 0.0, 0.0]) for i in range(50)] + [(i, 1000, [0.0, 1.0, 0.0]) for i in range(50, 99)] + [(99, 20, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, p array<double>")
    rates = {r.doc_id: r.rate for r in mixing.fit_rates(df, [50_000.0, 49_000.0, 0.0]).collect()}
    assert rates[99] == 0 and all(rates[i] == 1 for i in range(99))


def test_rates_within_most_uses(spark):
    """With at most one use: the optimum found by plain projected gradient, and the totals that are drawn."""
    rng = np.random.default_rng(6)
    p = np.concatenate([rng.dirichlet([30, 2, 0.02], 600), rng.dirichlet([2, 30, 0.02], 300), rng.dirichlet([0.4, 0.4, 6], 100)])
    tokens = rng.integers(1, 200, 1000)
    rows = [(i, int(n), [float(v) for v in q]) for i, (n, q) in enumerate(zip(tokens, p))]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, p array<double>")
    sizes = tokens @ p
    targets, best = sizes * [1, 1, 0], np.ones(1000)
    for _ in range(20_000):
        best = np.clip(best - p @ (((tokens * best) @ p - targets) / sizes), 0, 1)
    found = mixing.fit_rates(df, list(map(float, targets)), most=1)
    x = np.array([r.rate for r in found.orderBy("doc_id").collect()])
    assert x.min() >= 0 and x.max() <= 1
    totals = (tokens * x) @ p
    assert np.abs(totals - (tokens * best) @ p).max() <= 2e-3 * sizes.sum()
    clean, toxic = p[:, 2] < 0.01, p[:, 2] > 0.9
    assert clean.sum() > 800 and (best[clean] == 1).all() and (x[clean] > 0.999).all()
    assert toxic.sum() > 40 and x[toxic].max() < 0.02
    docs = docs_frame(spark, [(i, "text") for i in range(1000)])
    drawn = np.zeros(1000)
    for r in mixing.resample(docs, found, 1).collect():
        drawn[r.doc_id] += 1
    assert drawn.max() == 1 and (drawn[clean] == 1).all() and np.abs((tokens * drawn) @ p - totals).max() <= 5e-3 * sizes.sum()


def test_few_rounds_and_one_form(spark):
    """Rates are the projection of 1 minus the posteriors' share of one number per domain, found in a few aggregations."""
    rng = np.random.default_rng(5)
    p, tokens = rng.dirichlet([0.8, 0.3, 0.3], 2000), rng.integers(1, 100, 2000)
    rows = [(i, int(n), [float(v) for v in q]) for i, (n, q) in enumerate(zip(tokens, p))]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, p array<double>")
    sizes = tokens @ p
    for targets, most in ((sizes * [1.0, 1.3, 0.0], math.inf), (sizes * [0.2, 1.4, 0.0], math.inf), (sizes * [0.9, 0.95, 0.8], 1.0)):
        flat = df.select("tokens", *[F.get("p", F.lit(i)).alias(f"p{i}") for i in range(3)])
        gradient = np.array(mixing.fit_gradient(flat, targets.tolist(), rounds=20, most=most))
        want = np.clip(1 - p @ gradient, 0, most)
        gaps = np.abs((tokens * want) @ p - targets)
        assert (gaps <= mixing.TOLERANCE * np.where(targets > 0, targets, sizes)).all()
        got = np.array([r.rate for r in mixing.fit_rates(df, targets.tolist(), rounds=20, most=most).orderBy("doc_id").collect()])
        assert np.abs(got - want).max() <= mixing.SNAP


def test_nearest_to_one_among_equal_totals(spark):
    """Of all rates with these totals, those of the least squared distance to 1 (tokens count): no other choice is nearer."""
    rng = np.random.default_rng(9)
    p, tokens = rng.dirichlet([0.5] * 3, 200), rng.integers(1, 50, 200)
    rows = [(i, int(n), [float(v) for v in q]) for i, (n, q) in enumerate(zip(tokens, p))]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, p array<double>")
    targets = (tokens @ p) * [0.6, 1.2, 0.9]
    x = np.array([r.rate for r in mixing.fit_rates(df, targets.tolist(), tolerance=1e-9).orderBy("doc_id").collect()])
    cost = (tokens * (x - 1) ** 2).sum()
    basis = np.linalg.svd(p.T * tokens)[2][3:]              # moves that leave the totals as they are
    for move in rng.standard_normal((200, len(basis))) @ basis * 0.01:
        other = x + move
        if (other >= 0).all():
            assert (tokens * (other - 1) ** 2).sum() >= cost - 1e-6 * cost


def test_posteriors_against_naive_bayes(spark):
    """The classifier's counts, ratios and posteriors, written again in Python."""
    texts = ["alpha beta beta", "beta gamma", "alpha delta delta", "gamma gamma beta", "delta", "", None, "alpha  beta\tGAMMA", "omega alpha"] * 3
    docs = docs_frame(spark, list(enumerate(texts)))
    labels = spark.createDataFrame([(i, [1, 0, 1, None][i % 4], int(i % 5 == 0)) for i in range(20)], LABELS)
    model, priors = mixing.train(docs, labels, features=4)
    domain = {r.label_id: r.domain for r in mixing.labelled_domains(labels).collect()}
    sets = {i: set((t or "").lower().replace("\t", " ").split()) for i, t in enumerate(texts)}
    n = [sum(d == k for d in domain.values()) for k in mixing.DOMAINS]
    counts = {w: [sum(w in sets[i] for i, d in domain.items() if d == k) for k in mixing.DOMAINS] for w in set().union(*sets.values())}
    weights = {}
    for w, c in counts.items():
        if sum(c) >= mixing.SUPPORT:
            base = (sum(c) + 0.5) / (sum(n) + 1)
            weights[w] = [math.log((x + mixing.PRIOR_DOCS * base) / (m + mixing.PRIOR_DOCS) / base) for x, m in zip(c, n)]
    telling = sorted(weights, key=lambda w: (-sum(x * abs(v) for x, v in zip(counts[w], weights[w])), w))[:4]
    got = {r.feature: list(r.weights) for r in model.collect()}
    assert set(got) == set(telling) and all(np.allclose(got[w], weights[w]) for w in got)
    assert np.allclose(priors, [math.log((m + 1) / (sum(n) + 3)) for m in n])
    for r in mixing.posteriors(docs, model, priors).collect():
        words = (texts[r.doc_id] or "").lower().replace("\t", " ").split()
        logs = np.array(priors) + sum((np.array(weights[w]) for w in words if w in got), np.zeros(3))
        odds = np.exp(logs - logs.max())
        assert r.tokens == len(words) and np.allclose(r.p, odds / odds.sum())


def test_classifier_finds_the_domains(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train_labels = labels.filter("doc_id % 3 <> 0")
    model, priors = mixing.train(docs, train_labels)
    assert model.count() <= mixing.FEATURES
    held = mixing.labelled_domains(labels.filter("doc_id % 3 = 0")).join(mixing.posteriors(docs, model, priors), F.col("label_id") == F.col("doc_id"))
    rows = held.select("domain", "p").collect()
    assert all(math.isclose(sum(r.p), 1, abs_tol=1e-9) for r in rows)
    right = [mixing.DOMAINS[int(np.argmax(r.p))] == r.domain for r in rows]
    assert np.mean(right) > 0.9


def test_messy(spark, messy, empty_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, None, 1), (7, 0, None), (8, 1, None), (9, None, None), (None, 1, 1), (99, 1, 0)], LABELS)
    assert {tuple(r) for r in mixing.labelled_domains(labels).collect()} == {(1, "low"), (5, "toxic"), (7, "low"), (8, "high"), (99, "high")}
    rows = mixing.mix(messy, labels, {"high": 0.5, "low": 0.5, "toxic": 0.0}).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == messy.select("doc_id").distinct().count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].tokens == by_id[3].tokens == 0 and by_id[10].tokens == 30_000
    assert all(r.rate >= 0 and math.isclose(sum(r.p), 1, abs_tol=1e-9) for r in rows)
    none = mixing.mix(messy, labels.limit(0), {"high": None, "low": None, "toxic": 0.1}).collect()
    assert all(np.allclose(r.p, 1 / 3) for r in none)
    assert mixing.mix(empty_docs, labels, {"high": 1.0, "low": 0.0}).count() == 0


def test_resample(spark):
    docs = with_clashes(docs_frame(spark, [(i, f"text {i}") for i in range(2000)] + [(None, "no id")]))
    rates = spark.createDataFrame([(i, [0.0, 1.0, 2.0, 0.25, 1.0004][i % 5]) for i in range(2000)] + [(None, 3.0)], "doc_id long, rate double")
    out = mixing.resample(docs, rates)
    assert out.columns == docs.columns
    n = {}
    for r in out.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert all(n.get(i, 0) == [0, 1, 2, None, 1][i % 5] for i in range(2000) if i % 5 != 3) and n[None] == 3
    assert 60 < sum(n.get(i, 0) for i in range(3, 2000, 5)) < 140
    assert max(r["count"] for r in mixing.resample(docs, rates, 1).groupBy("doc_id").count().collect()) == 1


def test_native_plan(spark, sample):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    plan = mixing.mix(sample, labels, {"high": None, "low": None, "toxic": 0.0})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
