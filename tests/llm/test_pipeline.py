"""Each stage of the pipeline against a plain version on what the stage before it kept."""

import collections
import hashlib

import duckdb

import corpus_pipeline
from riverlens.llm import quality, toxicity
from riverlens.llm.common import cut

from .test_classifiers import toxic_rows
from .test_minhash import brute_components
from .test_packing import check
from .test_substring import brute_removal


def test_stages(spark, tmp_path):
    docs, labels = toxic_rows(400, 7)
    base = [(i, f"{t} {t[::-1]}", lang, s, len(t)) for i, t, lang, s, _ in docs if len(t) > 150]
    rows = [*base, *((1000 + i, t + " tail", lang, s, 0) for i, t, lang, s, _ in base[:60]), (5000, None, None, None, None), (5001, "", "en", "s", 0)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lab.write.parquet(f"{sf}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    d = spark.read.parquet(f"{sf}/documents.parquet")
    names = d.columns

    def step(name, docs):
        out = cut(stages[name](spark, docs, sf), name)
        return out, out.collect()

    scorer = toxicity.learn(d, lab.where(~toxicity.held_out(lab)))
    one, got = step("toxicity", d)
    assert one.columns == names and {r.doc_id for r in got} == {i for i, t, *_ in rows if scorer.score(t) < 0.5}

    con = duckdb.connect()
    con.register("documents", one.toPandas())
    kept = {r[0] for r in con.sql(f"select doc_id from ({quality.ORACLE_SQL}) where kept").fetchall()}
    two, got2 = step("quality", one)
    assert two.columns == names and {r.doc_id for r in got2} == kept and kept

    parts = brute_components([(r.doc_id, r.text, "") for r in got2])
    three, got3 = step("minhash_near_dedup", two)
    assert three.columns == names and {r.doc_id for r in got3} == {i for i, (_, c) in parts.items() if i == c}

    want = brute_removal([(r.doc_id, r.text, "") for r in got3])
    four, got4 = step("substring_dedup", three)
    digests = collections.Counter((r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in got4)
    assert four.columns == names and digests == collections.Counter((i, h) for i, _, _, h in want)

    _, got5 = step("packing", four)
    check([(r.doc_id, r.text, r.source) for r in got4], got5, 4096)
    assert corpus_pipeline.run(spark, sf).count() == len(got5)


def test_odd_rows_pass_through_all_stages(spark, tmp_path):
    """Empty table; repeated rows, null ids and texts, columns with the operators' own names."""
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "s", 3, 1, "k"), (1, text, "en", "s", 3, 1, "k"), (None, text + " more", None, None, None, None, None), (2, None, None, None, None, None, None), (3, text[::-1], "en", "s", 0, 0, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept int, spans string"
    lab = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for k, data in enumerate(([], rows)):
        sf = f"{tmp_path}/{k}"
        spark.createDataFrame(data, schema).write.parquet(f"{sf}/documents.parquet")
        lab.write.parquet(f"{sf}/labels.parquet")
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = cut(stage(spark, docs, sf), name)
            assert out.columns == docs.columns
            docs = out
        got = corpus_pipeline.run(spark, sf)
        assert got.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        assert {r.doc_id for r in got.collect()} <= {r[0] for r in data}
