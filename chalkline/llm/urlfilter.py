"""URL filters: listed rules first, else an empirical-Bayes reputation of the host.

A host's labelled pages are bad or good outcomes of a beta-binomial. The
suffix shrinks towards the whole table, the registered domain towards its
suffix, the host towards its domain; each level's prior strength is the
moment estimate over that level. A page is blocked where the lower posterior
bound of its host's bad rate reaches the limit: hosts that are only suspected,
or never labelled and of unremarkable domains, stay.

Defined results: a null url, or one without ``://``, has empty host and path,
fits no rule and is judged as host ''. Repeated rows are judged alike and each
counts as a page. A page is bad if any of its labels says so; null labels are
no outcome. Ties between rules of equal length go to the rule listed first.
Null page_ids are kept and have no outcome. Very long urls are read whole. An
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import materialize

Z = 1.645
LIMIT = 0.4
#: Bounds of the prior's strength in pages, and the strength where a level has nothing to estimate it from.
STRENGTHS, DEFAULT_STRENGTH = (1.0, 1000.0), 10.0
#: Suffixes of two labels under which names are registered; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br",
                      "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "or.jp", "org.au", "org.uk")

Rule = tuple[str, str, str]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path, both '' where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return ascii_lower(raw), path


def rule_columns(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule's text and action, null where none fits."""
    name = action = F.lit(None).cast("string")
    # built from the shortest (last asked) to the longest (first asked); among equals the first listed wins
    for act, h, p in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, h + p).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def host_levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user and port; an address is its own domain under suffix ''."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    labels = F.split(bare, r"\.")
    n = F.size(labels)
    two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
    width = F.when((n > 2) & two.isin(*TWO_LABEL_SUFFIXES), 2).otherwise(1)
    address = bare.rlike(r"^(\d+\.\d+\.\d+\.\d+|\[.*)$") | (n < 2)
    suffix = F.when(address, F.lit("")).otherwise(F.when(width == 2, two).otherwise(F.element_at(labels, -1)))
    domain = F.when(address, bare).otherwise(
        F.array_join(F.slice(labels, F.greatest(n - width, F.lit(1)), width + 1), "."))
    return domain, suffix


def _shrink(level: DataFrame, parents: DataFrame | None, up: str | None, overall: float) -> DataFrame:
    """Adds ``alpha`` and ``beta`` of each row's posterior.

    Its prior has the mean of the parent's posterior without the row's own
    outcomes, and the level's strength, or what the rest of the parent
    amounts to where that is less.
    """
    if parents is None:
        level = level.withColumns({"mean": F.lit(overall), "most": F.lit(STRENGTHS[1])})
    else:
        level = level.join(parents.select(F.col(up), F.col("alpha").alias("a0"), F.col("beta").alias("b0")), up)
        a0, most = F.col("a0") - F.col("bad"), F.col("a0") + F.col("b0") - F.col("n")
        level = level.withColumns({"mean": a0 / most, "most": most}).drop("a0", "b0")
    v = F.col("mean") * (1 - F.col("mean"))
    fit = level.filter("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("mean"), 2)).alias("s"),
        F.sum(v).alias("v"), F.sum(v * (F.col("n") - 1)).alias("w")).first()
    strength = DEFAULT_STRENGTH
    if fit["w"]:
        rho = (fit["s"] - fit["v"]) / fit["w"]
        strength = STRENGTHS[1] if rho <= 0 else min(max(1 / rho - 1, STRENGTHS[0]), STRENGTHS[1])
    k = F.least(F.lit(round(strength, 6)), F.col("most"))
    return (level.withColumn("alpha", k * F.col("mean") + F.col("bad"))
            .withColumn("beta", k * (1 - F.col("mean")) + F.col("n") - F.col("bad")).drop("mean", "most"))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """From ``host, n, bad`` (one row per host): ``host, labelled, bad, mean, sd`` of the posterior bad rate."""
    domain, suffix = host_levels(F.col("host"))
    hosts = outcomes.withColumns({"domain": domain, "suffix": suffix})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1.0)
    suffixes = _shrink(suffixes, None, None, overall)
    domains = _shrink(domains, suffixes, "suffix", overall)
    hosts = _shrink(hosts, domains, "domain", overall)
    a, b = F.col("alpha"), F.col("beta")
    return hosts.select("host", F.col("n").alias("labelled"), "bad", (a / (a + b)).alias("mean"),
                        F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1))).alias("sd"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[Rule], z: float = Z, limit: float = LIMIT) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_rate, bound`` for every row of ``pages``.

    ``labels`` (doc_id, quality, toxic) gives the outcomes: the label whose
    doc_id is the page_id; bad is quality 0 or toxic 1. ``rules`` is a short
    configured list of (action, host, path).
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    outcomes = (labels.filter("doc_id is not null and (quality is not null or toxic is not null)")
                .groupBy("doc_id").agg(F.max(bad.cast("int")).alias("bad")))
    by_host = (parts.join(outcomes, parts["page_id"] == outcomes["doc_id"], "left")
               .groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    by_host = materialize(by_host)                          # each level reads the host counts
    rep = host_reputation(by_host).select(F.col("host").alias("rep_host"), F.col("mean").alias("bad_rate"),
                                          F.round(F.col("mean") - F.lit(z) * F.col("sd"), 9).alias("bound"))
    name, action = rule_columns(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("bound") >= limit, "block").otherwise("allow")
    # a hot host's pages are split by adaptive execution: they only stream past one reputation row
    return (parts.join(rep, F.col("host") == F.col("rep_host"))
            .select("page_id", "host", "path", name.alias("rule"), F.coalesce(action, learned).alias("verdict"),
                    F.round("bad_rate", 9).alias("bad_rate"), "bound"))
