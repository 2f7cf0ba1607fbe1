"""Registered queries of this subpackage and their DuckDB equivalents.

Each ``opN`` applies its operator with production parameters to its whole
table and derives the digest columns that the result contract names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm import ann, fingerprint, langid, lexical, linededup, lm, mixing, neardup, negatives, packing, shards, urlfilter, warc
from chalkline.llm.common import materialize, unsigned_crc32
from chalkline.session import ensure_checkpoint_dir
from chalkline.sources.tables import read_table

NEIGHBOURS, QUERY_EVERY, ANCHOR_EVERY = 5, 50, 100
MIXTURE, MIXTURE_SHARE = {"high": 0.8, "low": 0.2, "toxic": 0.0}, 0.8
SHARDS = 24
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens."""
    pieces = packing.pack(read_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every text, learned from two of three folds."""
    docs = read_table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(langid.fold(F.col("doc_id")) != 1).select("doc_id", "text", "lang"))
    held_out = F.coalesce(langid.fold(F.col("doc_id")) == 1, F.lit(False))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model, ("lang_pred", "score")).drop("text")


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's stupid-backoff score under the counts of all other documents."""
    scored = lm.score(read_table(spark, sf_dir, "documents"))
    mean = F.when(F.col("words") > 0, F.round(F.col("log_score") / F.col("words"), 6))
    return scored.select("doc_id", "words", F.round("log_score", 4).alias("log_score"), mean.alias("mean_log_score"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of every 50th vector."""
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0, NEIGHBOURS)


def hex16(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and how many others lie within 3 bits."""
    pairs = materialize(fingerprint.fingerprint_pairs(read_table(spark, sf_dir, "documents")))
    near = fingerprint.neighbour_counts(pairs).select(F.col("fp").alias("found"), "near")
    return pairs.join(near, F.col("fp") == F.col("found"), "left").select(
        "doc_id", "n_chars", "edited_sha256", hex16("fp").alias("fingerprint"), hex16("edited_fp").alias("edited_fingerprint"),
        fingerprint.likeness("fp", "edited_fp").alias("near_edited"), fingerprint.likeness("fp", "next_fp").alias("near_next"),
        F.coalesce("near", F.lit(0)).cast("long").alias("near_fingerprints"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's domain posteriors and its rate under the target mixture."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    mixed = mixing.mix(docs, read_table(spark, sf_dir, "labels"), MIXTURE, MIXTURE_SHARE)
    return mixed.select("doc_id", "tokens", *[F.get("p", F.lit(i)).alias(f"p_{k}") for i, k in enumerate(MIXTURE)], "rate")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by the law ``rows``."""
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
                       unsigned_crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    placed = shards.assign_shards(rows, ["doc_id", "text_crc32", "size"], SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without lines that an earlier line of the corpus resembles."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs, linededup.THRESHOLD)


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's 3-word-shingle SimHash and its component over links of at most 2 bits."""
    found = neardup.near_duplicates(read_table(spark, sf_dir, "documents"), neardup.SHINGLE_WORDS, neardup.RADIUS)
    return found.select("doc_id", hex16("fp").alias("fingerprint"), "component_id")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or learned verdict for every page's url."""
    return urlfilter.judge_urls(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"), RULES)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 hardest negatives of every 100th vector's 5 best positives; labels at every 7th id are shifted first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % ANCHOR_EVERY == 0, label)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of archives in the shared checkpoint folder, read back from them."""
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(read_table(spark, sf_dir, "pages"), folder)
    found = warc.resolved(warc.read_archives(spark, folder))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 documents of highest score for each benchmark item."""
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), lexical.TOP)


QUERIES = {"op1_packing": op1_packing, "op2_langid": op2_langid, "op3_lm_scores": op3_lm_scores, "op4_nearest": op4_nearest, "op5_fingerprints": op5_fingerprints, "op6_mixing": op6_mixing, "op7_sharding": op7_sharding,
           "op8_linededup": op8_linededup, "op9_neardup": op9_neardup, "op10_url_filter": op10_url_filter, "op11_hard_negatives": op11_hard_negatives, "op12_warc": op12_warc, "op13_lexical_search": op13_lexical_search}

def _level_sql(name: str, rows: str, parent: str | None, up: str | None) -> str:
    """CTEs that give each row of ``rows`` its posterior, as ``urlfilter._shrink`` does."""
    mean = f"SELECT x.*, (a.bad + 0.5) / (a.n + 1.0) AS mean, {urlfilter.STRENGTHS[1]} AS most FROM {rows} x, t a" if parent is None else (
        f"SELECT x.*, (y.alpha - x.bad) / (y.alpha + y.beta - x.n) AS mean, y.alpha + y.beta - x.n AS most "
        f"FROM {rows} x JOIN {parent} y USING ({up})")
    low, high = urlfilter.STRENGTHS
    return f"""
        {name}_m AS ({mean}),
        {name}_f AS (
            SELECT sum(n * pow(bad / n - mean, 2)) AS s, sum(mean * (1 - mean)) AS v, sum(mean * (1 - mean) * (n - 1)) AS w
            FROM {name}_m WHERE n > 0),
        {name}_k AS (
            SELECT round(CASE WHEN coalesce(w, 0) = 0 THEN {urlfilter.DEFAULT_STRENGTH} WHEN s <= v THEN {high}
                         ELSE least(greatest(w / (s - v) - 1, {low}), {high}) END, 6) AS k FROM {name}_f),
        {name} AS (
            SELECT x.* EXCLUDE (mean, most), least(k, most) * mean + bad AS alpha, least(k, most) * (1 - mean) + n - bad AS beta
            FROM {name}_m x, {name}_k)"""


def _url_filter_sql() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, act) for act, h, p in rules]
    rule = " ".join(f"WHEN {f} THEN '{name}'" for f, name, _ in fits)
    action = " ".join(f"WHEN {f} THEN '{act}'" for f, _, act in fits)
    two = ", ".join(f"'{x}'" for x in urlfilter.TWO_LABEL_SUFFIXES)
    return rf"""
        WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        r AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
        p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM r),
        o AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels
              WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
        h0 AS (SELECT host, count(o.bad)::DOUBLE AS n, coalesce(sum(o.bad), 0)::DOUBLE AS bad FROM p LEFT JOIN o ON page_id = doc_id GROUP BY host),
        h1 AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '') AS bare FROM h0),
        h2 AS (SELECT *, string_split(bare, '.') AS ls FROM h1),
        h3 AS (SELECT *, len(ls) < 2 OR regexp_matches(bare, '^(\d+\.\d+\.\d+\.\d+|\[.*)$') AS address,
                      CASE WHEN len(ls) > 2 AND ls[-2] || '.' || ls[-1] IN ({two}) THEN 2 ELSE 1 END AS width FROM h2),
        hosts AS (SELECT host, n, bad,
                         CASE WHEN address THEN bare ELSE array_to_string(ls[greatest(len(ls) - width, 1):], '.') END AS domain,
                         CASE WHEN address THEN '' ELSE array_to_string(ls[len(ls) - width + 1:], '.') END AS suffix FROM h3),
        domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
        suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
        t AS (SELECT coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad FROM suffixes),
        {_level_sql("ps", "suffixes", None, None)},
        {_level_sql("pd", "domains", "(SELECT suffix, alpha, beta FROM ps)", "suffix")},
        {_level_sql("ph", "hosts", "(SELECT domain, alpha, beta FROM pd)", "domain")},
        q AS (SELECT host, alpha / (alpha + beta) AS mean, sqrt(alpha * beta / (pow(alpha + beta, 2) * (alpha + beta + 1))) AS sd FROM ph),
        b AS (SELECT page_id, p.host, path, round(mean, 9) AS bad_rate, round(mean - {urlfilter.Z} * sd, 9) AS bound FROM p JOIN q ON p.host = q.host)
        SELECT page_id, host, path, CASE {rule} END AS rule,
               coalesce(CASE {action} END, CASE WHEN bound >= {urlfilter.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, bad_rate, bound
        FROM b"""


ORACLES = {
    "op3_lm_scores": """
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        t AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
        g AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v, lag(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM t),
        c AS (
            SELECT *, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS c1,
                   count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY doc_id, v, w) AS c2,
                   count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY doc_id, u, v, w) AS c3,
                   count(*) OVER () - n AS others FROM g),
        h AS (SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS h1, lag(c2) OVER (PARTITION BY doc_id ORDER BY i) AS h2 FROM c),
        s AS (SELECT *, CASE WHEN c1 > 0 THEN c1 / greatest(others, 1)::DOUBLE ELSE 1 / (others + 1)::DOUBLE END AS s1 FROM h),
        b AS (SELECT *, CASE WHEN v IS NULL THEN s1 WHEN c2 > 0 THEN c2 / h1::DOUBLE ELSE 0.4 * s1 END AS s2 FROM s),
        r AS (SELECT doc_id, sum(ln(CASE WHEN u IS NULL THEN s2 WHEN c3 > 0 THEN c3 / h2::DOUBLE ELSE 0.4 * s2 END)) AS ls
              FROM b GROUP BY doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS words, round(coalesce(ls, 0), 4) AS log_score,
               CASE WHEN len(ws) > 0 THEN round(ls / len(ws), 6) END AS mean_log_score
        FROM d LEFT JOIN r USING (doc_id)""",
    "op4_nearest": """
        WITH v AS (
            SELECT vec_id, min(embedding::DOUBLE[]) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
            GROUP BY vec_id),
        n AS (SELECT *, sqrt(list_inner_product(e, e)) AS l FROM v),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) / (q.l * c.l) AS score
            FROM n q JOIN n c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_linededup": """
        WITH l AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
            FROM documents),
        s AS (
            SELECT doc_id, line, body, list_sort(list_distinct(list_filter(string_split(translate(
                       lower(body), chr(9) || chr(13) || chr(12) || chr(11), '    '), ' '), lambda w: w <> ''))) AS ws FROM l),
        c AS (
            SELECT ws, len(ws) AS n, min((doc_id, line)) AS first, row_number() OVER () AS id FROM s WHERE len(ws) > 0 GROUP BY ws),
        w AS (SELECT id, n, first, unnest(ws) AS w FROM c),
        f AS (SELECT w, count(*) AS df FROM w GROUP BY w),
        o AS (SELECT w.*, row_number() OVER (PARTITION BY id ORDER BY df, w) AS place FROM w JOIN f USING (w)),
        x AS (SELECT * FROM o WHERE place <= n - (4 * n + 4) // 5 + 1),
        m AS (
            SELECT DISTINCT a.id AS a, b.id AS b FROM x a JOIN x b ON a.w = b.w AND a.first < b.first
            WHERE 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
        v AS (
            SELECT DISTINCT m.b AS id FROM m JOIN c p ON p.id = m.a JOIN c q ON q.id = m.b
            WHERE 5 * len(list_intersect(p.ws, q.ws)) >= 4 * (p.n + q.n - len(list_intersect(p.ws, q.ws)))),
        g AS (
            SELECT s.*, c.id IS NOT NULL AND (v.id IS NOT NULL OR c.first <> (s.doc_id, s.line)) AS gone
            FROM s LEFT JOIN c USING (ws) LEFT JOIN v ON v.id = c.id),
        t AS (
            SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY line) FILTER (NOT gone), '') AS text, count(*) AS lines,
                   count(*) FILTER (gone) AS removed_lines FROM g GROUP BY doc_id)
        SELECT d.doc_id, t.text, coalesce(lines, 0)::INT AS lines, coalesce(removed_lines, 0)::INT AS removed_lines
        FROM documents d LEFT JOIN t USING (doc_id)""",
    "op10_url_filter": _url_filter_sql(),
    "op11_hard_negatives": """
        WITH u AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        v AS (SELECT vec_id, label, x FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY label, x) AS i FROM u) WHERE i = 1),
        s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.x, c.x)::BIGINT AS score
            FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.x) = len(c.x) WHERE a.vec_id % 100 = 0),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
                   row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
        n AS (
            SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
            FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
            WHERE place <= 5)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op12_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to, true AS intact FROM f""",
    "op13_lexical_search": r"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(
                coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
        q AS (
            SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(
                coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS w FROM benchmark),
        s AS (SELECT count(*) FILTER (len(ws) > 0) AS n_docs, sum(len(ws))::BIGINT AS total FROM d),
        t AS (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS w FROM d),
        p AS (SELECT r, doc_id, n, w, count(*) AS tf FROM t WHERE w IN (SELECT w FROM q) GROUP BY ALL),
        f AS (SELECT w, count(*) AS df FROM p GROUP BY w),
        x AS (
            SELECT r, doc_id, w, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)::DOUBLE))::BIGINT
                   * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // total)))) AS impact
            FROM p JOIN f USING (w), s),
        g AS (SELECT item_id, r, doc_id, sum(impact)::BIGINT AS score FROM q JOIN x USING (w) GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM g WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10""",
}
