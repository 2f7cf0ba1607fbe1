import __spark_entry__ as entry
import corpus_pipeline
from chalkline.llm import langid, queries
from tests.llm.test_linededup import gone_lines
from tests.llm.test_neardup import brute
from tests.llm.test_packing import ids_of

SF = "/root/testdata/sf0.001"


def test_registered():
    found = entry.queries()
    assert [n for n in range(1, 11) if any(k.startswith(f"op{n}_") for k in found)] == list(range(1, 11))
    assert "pipeline" in found and set(queries.ORACLES) <= set(found) and set(queries.ORACLES) <= set(entry.oracle_sql())


def test_stages(spark, sample, tmp_path):
    """Each stage against brute force on what the one before kept."""
    docs, columns = sample, sample.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = kept[name] = docs.collect()
        if name != "pack":
            assert docs.columns == columns
        if name == "language_id":
            assert {r.doc_id for r in before if langid.words_of(r.text)} >= {r.doc_id for r in rows}
            assert len(rows) > 0.95 * len(before)
        if name == "line_dedup":
            texts = [(r.doc_id, r.text) for r in before]
            gone = gone_lines(texts)
            want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in texts}
            assert {r.doc_id: r.text for r in rows} == {d: t for d, t in want.items() if t.strip() or not any(g[0] == d for g in gone)}
            assert all(r.n_chars == len(r.text) for r in rows)
        if name == "simhash_dedup":
            found = brute([(r.doc_id, r.text) for r in before])
            assert {r.doc_id for r in rows} == {c for _, _, c in found}
        if name == "mix_sources":
            assert {r.doc_id for r in rows} <= {r.doc_id for r in before} and len(rows) == len({r.doc_id for r in rows})
        if name == "pack":
            assert sum(r.length for r in rows) == sum(map(len, ids_of([r.text for r in before])))


def test_empty_table(spark, empty_docs):
    docs = empty_docs
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = docs if out.columns == docs.columns else out


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} == set(rows[0].asDict())
