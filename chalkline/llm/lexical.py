"""Ranked lexical search over a length-stratified index.

A document's normaliser m, 100 - 90 + (90 n N) div L for its n terms, depends
on its length alone, so documents of equal m form a stratum, inside which a
term's impact is a function of its occurrences tf. The index holds, for each
stratum, a term's postings ordered by tf. A query term's impact is computed
once for each (stratum, term, tf) and used for all documents behind it; the
largest impact of each term, summed over a query's terms, bounds the scores of
the whole stratum. A query visits strata from the largest bound down and ends
where the bound falls below its k-th best score so far.

Strata lie in tiles of about ``TILE_DOCS`` documents: neighbouring small strata
share a tile, a large one is dealt over several, so no group grows with the
data. Each query first visits the tiles of its ``LEAD`` largest bounds, which
gives it a floor; then all other tiles whose bound reaches the floor.

Only postings of terms that a query of the batch names are written; N, L and
the documents' lengths are taken over all terms. Queries come in batches of at
most ``BATCH_TERMS`` postings, whose terms and weights are sent to all tasks;
the scans of the batches are independent of each other.

Defined results: a null or empty text has no term and is no candidate; it does
not count in N. Rows that share a doc_id are documents of their own; a null
doc_id comes after all others among equal scores. A query without terms, or
none of whose terms occurs, has no rows; queries that share an item_id, or
have none, are answered each by itself. Equal scores go by ascending doc_id.
Texts are read whole; an empty table gives no rows; extra columns are ignored.
Scores that do not fit 64 bits are not supported (a query of over 10^6 terms).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm.common import materialize

#: A term in UTF-8: digits, ASCII letters, and whatever is not ASCII.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
TOP = 10
TILE_DOCS = 4096
#: Tiles that a query visits first.
LEAD = 3
#: Terms of the queries of a batch, repeats included: some 20 bytes each, sent to all tasks.
BATCH_TERMS = 500_000
SCALE, FLAT, SLOPE = 1_000_000_000, 10, 90


def terms_of(text: bytes | None) -> list[bytes]:
    """Whole text's terms in order; only A-Z are lower-cased."""
    return TERM.findall((text or b"").lower())             # bytes.lower() is ASCII only


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(w: np.ndarray | int, tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return w * (SCALE * tf // (1000 * tf + 8 * m))


# ---- queries

def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([list(dict.fromkeys(terms_of(t.as_py()))) for t in batch.column(2)], pa.list_(pa.binary()))],
            names=["q", "item_id", "terms"])


def query_batches(items: DataFrame, batch_terms: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Batches of (q, distinct terms), each of bounded size; one is held at a time."""
    batch, held = [], 0
    for row in items.select("q", "terms").toLocalIterator():
        terms = [bytes(t) for t in row["terms"]]
        if batch and held + len(terms) > batch_terms:
            yield batch
            batch, held = [], 0
        if terms:
            batch.append((row["q"], terms))
            held += len(terms)
    if batch:
        yield batch


# ---- index

def _counted(batches: Iterator[pa.RecordBatch], places: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """doc_id, number of terms, and the asked terms (by place) with their occurrences."""
    get = places.get
    for batch in batches:
        n, named, times = [], [], []
        for text in batch.column(1):
            found = terms_of(text.as_py())
            n.append(len(found))
            counts = [(p, c) for t, c in Counter(found).items() if (p := get(t)) is not None]
            named.append([p for p, _ in counts])
            times.append([c for _, c in counts])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(named, pa.list_(pa.int32())),
                                          pa.array(times, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])


_TILE = "tile long, index binary"
_PARTS = [("ids", "i8"), ("none", "?"), ("m", "i8"), ("docs", "i8"), ("posts", "i8"), ("term", "i4"), ("tf", "i8"), ("doc", "i4")]


def pack_tile(arrays: dict[str, np.ndarray]) -> bytes:
    parts = [np.ascontiguousarray(arrays[name], dtype=kind).tobytes() for name, kind in _PARTS]
    return np.array([len(p) for p in parts], "i8").tobytes() + b"".join(parts)


def unpack_tile(data: bytes) -> dict[str, np.ndarray]:
    at, out = 8 * len(_PARTS), {}
    for (name, kind), size in zip(_PARTS, np.frombuffer(data, "i8", len(_PARTS))):
        out[name] = np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at)
        at += int(size)
    return out


def _index_tile(key: tuple, table: pa.Table) -> pa.Table:
    """The strata of one tile: documents by m, postings by (m, term, tf)."""
    m = np.asarray(table["m"], dtype=np.int64)
    order = np.argsort(m, kind="stable")
    table, m = table.take(pa.array(order)), m[order]
    terms, tfs = table["terms"].combine_chunks(), table["tfs"].combine_chunks()
    doc = np.repeat(np.arange(len(m)), np.asarray(terms.value_lengths(), dtype=np.int64))
    term, tf = np.asarray(terms.flatten(), dtype=np.int64), np.asarray(tfs.flatten(), dtype=np.int64)
    values, first = np.unique(m, return_index=True)
    stratum = np.searchsorted(values, m[doc])
    order = np.lexsort((tf, term, stratum))
    term, tf, doc, stratum = term[order], tf[order], doc[order], stratum[order]
    ids = table["doc_id"].combine_chunks()
    index = pack_tile({
        "ids": np.asarray(ids.fill_null(0)), "none": np.asarray(ids.is_null()), "m": values,
        "docs": np.append(first, len(m)), "posts": np.append(np.searchsorted(stratum, np.arange(len(values))), len(stratum)),
        "term": term, "tf": tf, "doc": doc})
    return pa.table({"tile": pa.array([key[0].as_py()], pa.int64()), "index": pa.array([index], pa.binary())})


def build_index(docs: DataFrame, places: dict[bytes, int], tile_docs: int = TILE_DOCS) -> tuple[DataFrame, np.ndarray]:
    """Tiles (``tile, index``) of the documents that hold a term of ``places``, and each term's weight by place."""
    sc = docs.sparkSession.sparkContext
    asked = sc.broadcast(places)                            # at most BATCH_TERMS short strings
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = materialize(rows.mapInArrow(lambda it: _counted(it, asked.value), "doc_id long, n long, terms array<int>, tfs array<bigint>"))
    n_docs, length = rows.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(places), np.int64)
    counts = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    for r in counts.collect():                              # a row for each asked term at most
        weights[r["term"]] = weight(n_docs, r["df"])

    m = (F.lit(FLAT) + F.expr(f"({SLOPE} * n * {n_docs}L) div {max(1, length)}L")).cast("long")
    held = rows.filter(F.size("terms") > 0).select("doc_id", "terms", "tfs", m.alias("m"), F.monotonically_increasing_id().alias("row"))
    # a row for each length that occurs; their running count cuts the order of m into tiles
    strata = held.groupBy("m").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    strata = strata.select(F.col("m").alias("of"), "size", before.alias("before"))
    place = F.col("before") + F.when(F.col("size") >= tile_docs, F.pmod(F.xxhash64("row"), F.col("size"))).otherwise(0)
    tiled = held.join(strata, F.col("m") == F.col("of")).select(F.floor(place / tile_docs).cast("long").alias("tile"), "doc_id", "m", "terms", "tfs")
    return materialize(tiled.groupBy("tile").applyInArrow(_index_tile, _TILE)), weights


# ---- search

class Queries:
    """The queries of a batch in flat arrays."""

    def __init__(self, batch: list[tuple[int, list[bytes]]], places: dict[bytes, int], weights: np.ndarray):
        self.q = np.array([q for q, _ in batch], np.int64)
        self.terms = np.concatenate([np.array([places[t] for t in ts], np.int64) for _, ts in batch])
        self.starts = np.concatenate([[0], np.cumsum([len(ts) for _, ts in batch])])
        self.weights = weights
        self.floors = np.zeros(len(batch), np.int64)

    def totals(self, of_term: np.ndarray) -> np.ndarray:
        """For each query the sum of a value that each term has."""
        return np.add.reduceat(of_term[self.terms], self.starts[:-1]) if len(self.q) else np.zeros(0, np.int64)


class Tile:
    """A tile's strata with the impacts of their postings, computed once for each (stratum, term, tf)."""

    def __init__(self, data: bytes, queries: Queries):
        self.__dict__ |= unpack_tile(data)
        self.queries = queries

    def stratum(self, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms, the start of each one's postings, and every posting's impact."""
        a, b = self.posts[s], self.posts[s + 1]
        term, tf = self.term[a:b], self.tf[a:b]
        new = np.concatenate([[True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])])
        runs = np.flatnonzero(new)
        once = impacts(self.queries.weights[term[runs]], tf[runs], self.m[s])
        impact = np.repeat(once, np.diff(np.append(runs, b - a)))
        starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        return term[starts], np.append(starts, b - a), impact

    def bounds(self) -> np.ndarray:
        """For each stratum (rows) and query the largest score that a document there can have."""
        out = np.zeros((len(self.m), len(self.queries.q)), np.int64)
        for s in range(len(self.m)):
            terms, starts, impact = self.stratum(s)
            best = np.zeros(len(self.queries.weights), np.int64)
            best[terms] = impact[starts[1:] - 1]            # postings are in the order of tf
            out[s] = self.queries.totals(best)
        return out

    def search(self, wanted: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, documents, scores): the k best of the tile for each ``wanted`` query, among those its floor lets through."""
        bounds, floors = self.bounds(), self.queries.floors.copy()
        kept: dict[int, list] = {}
        strata = {}
        for i in wanted:
            docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
            mine = self.queries.terms[self.queries.starts[i]:self.queries.starts[i + 1]]
            for s in np.argsort(-bounds[:, i], kind="stable"):
                if bounds[s, i] <= 0 or bounds[s, i] < floors[i]:
                    break
                if s not in strata:
                    terms, starts, impact = self.stratum(s)
                    slot = np.full(len(self.queries.weights), -1)
                    slot[terms] = np.arange(len(terms))
                    strata[s] = slot, starts, impact, self.doc[self.posts[s]:self.posts[s + 1]] - self.docs[s]
                slot, starts, impact, doc = strata[s]
                total = np.zeros(self.docs[s + 1] - self.docs[s], np.int64)
                for t in slot[mine]:
                    if t >= 0:
                        total[doc[starts[t]:starts[t + 1]]] += impact[starts[t]:starts[t + 1]]
                good = np.flatnonzero((total > 0) & (total >= floors[i]))
                docs, scores = np.concatenate([docs, good + self.docs[s]]), np.concatenate([scores, total[good]])
                if len(docs) > k:
                    best = np.lexsort((self.ids[docs], self.none[docs], -scores))[:k]
                    docs, scores = docs[best], scores[best]
                if len(docs) == k:
                    floors[i] = max(floors[i], scores.min())
            if len(docs):
                yield i, docs, scores


def _bound_rows(batches: Iterator[pa.RecordBatch], queries) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tile, data in zip(batch.column(0), batch.column(1)):
            best = Tile(data.as_py(), queries.value).bounds().max(0, initial=0)
            on = np.flatnonzero(best > 0)
            yield pa.RecordBatch.from_arrays([pa.array(on, pa.int64()), pa.array(np.full(len(on), tile.as_py()), pa.int64()), pa.array(best[on])],
                                             names=["i", "tile", "bound"])


def _found_rows(batches: Iterator[pa.RecordBatch], queries, k: int) -> Iterator[pa.RecordBatch]:
    """batches: tile, its index, the queries (by number) that visit it."""
    for batch in batches:
        for data, wanted in zip(batch.column(1), batch.column(2)):
            tile = Tile(data.as_py(), queries.value)
            for i, docs, scores in tile.search(np.array(sorted(wanted.as_py())), k):
                ids = pa.array(tile.ids[docs], mask=tile.none[docs])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), queries.value.q[i])), ids, pa.array(scores)],
                                                 names=["q", "doc_id", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _search_batch(docs: DataFrame, batch: list[tuple[int, list[bytes]]], k: int, tile_docs: int, lead: int) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    places = {t: i for i, t in enumerate(sorted({t for _, ts in batch for t in ts}))}
    tiles, weights = build_index(docs, places, tile_docs)
    asked = Queries(batch, places, weights)
    sent = sc.broadcast(asked)
    visits = materialize(tiles.mapInArrow(lambda it: _bound_rows(it, sent), "i long, tile long, bound long"))

    def visit(chosen: DataFrame, queries) -> DataFrame:
        named = chosen.groupBy(F.col("tile").alias("at")).agg(F.collect_list("i").alias("wanted"))
        return tiles.join(named, F.col("tile") == F.col("at")).select("tile", "index", "wanted").mapInArrow(
            lambda it: _found_rows(it, queries, k), "q long, doc_id long, score long")

    order = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("bound"), "tile"))
    led = materialize(visits.withColumn("place", order).filter(F.col("place") <= lead).drop("place"))
    first = materialize(_best(visit(led, sent), k).drop("rank"))
    number = {int(q): i for i, q in enumerate(asked.q)}
    for r in first.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).collect():     # a row per query of the batch
        if r["n"] == k:
            asked.floors[number[r["q"]]] = r["floor"]
    floors = sc.broadcast(asked)
    least = F.broadcast(docs.sparkSession.createDataFrame([(i, int(f)) for i, f in enumerate(asked.floors)], "at long, floor long"))
    rest = visits.join(led.select("i", "tile"), ["i", "tile"], "left_anti").join(least, F.col("i") == F.col("at")).filter("bound >= floor")
    return _best(first.unionByName(visit(rest.select("i", "tile"), floors)), k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, tile_docs: int = TILE_DOCS, lead: int = LEAD,
           batch_terms: int = BATCH_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: for every row of ``items`` (item_id, text) its k documents of highest positive score."""
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    asked = materialize(asked.select(F.monotonically_increasing_id().alias("q"), "item_id", "text").mapInArrow(
        _query_terms, "q long, item_id long, terms array<binary>"))
    found = [materialize(_search_batch(docs, batch, k, tile_docs, lead)) for batch in query_batches(asked, batch_terms)]
    if not found:
        return asked.select("item_id", F.lit(1).alias("rank"), F.col("item_id").alias("doc_id"), F.col("q").alias("score")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.join(asked.select(F.col("q").alias("of"), "item_id"), F.col("q") == F.col("of")).select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
