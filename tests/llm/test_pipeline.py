import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tagatlas.llm import mixing, sstable, toxicity
from tests.llm.cases import documents
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_simhash import plain_kept

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture
def folder(spark, tmp_path):
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    more = [(100 + k, f"idiot moron {k} some text number {k}", "en", "s1", 9) for k in range(20)] + [(200 + k, f"a calm text about number {k * 7} and {k}", "en", "s2", 9) for k in range(60)]
    more += [(300, "bench words one two three four five six seven eight nine ten eleven twelve", "en", "s2", 1)]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100 + k, 1, 1) for k in range(20)] + [(200 + k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "Bench words one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    machine = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    one = machine.scorer()
    for k, (name, stage) in enumerate(pipeline.STAGES):
        rows = docs.collect()
        stage(spark, docs, folder).write.parquet(str(tmp_path / f"out{k}"))
        got = spark.read.parquet(str(tmp_path / f"out{k}"))
        out = got.collect()
        if name != "token_shards":
            assert got.columns == docs.columns
        if name == "toxicity":
            assert sorted(map(str, out)) == sorted(str(r) for r in rows if one(r.text) < 0.7) and len(out) < len(rows)
        if name == "near_duplicates":
            groups = plain_kept([(r.doc_id, r.text) for r in rows])
            assert len(out) == len(groups)
            for g in groups:
                mine = [r for r in out if (r.doc_id, r.text) in g]
                assert len(mine) == 1 and mine[0].doc_id == min((i for i, _ in g if i is not None), default=None)
            assert not ({str(r) for r in out} - {str(r) for r in rows})
        if name == "decontamination":
            items = [(1, "Bench words one two three four five six seven eight nine ten eleven twelve")]
            assert sorted(map(str, out)) == sorted(str(r) for r in rows if not contaminated(r.text, items)[4]) and len(out) == len(rows) - 1
        if name == "mixing":
            taken = {r.doc_id: r.taken // r.size if r.size else 1 for r in mixing.mixed(docs).collect()}
            assert sorted(map(str, out)) == sorted(str(r) for r in rows for _ in range(taken[r.doc_id]))
        if name == "token_shards":
            t = Tokenizer.from_file(sstable.tokenizer_path("byte_bpe_50k.json"))
            want = sorted((str(r.doc_id), zlib.crc32(np.array(t.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for r in rows)
            assert sorted((str(r.doc_id), r.ids_crc32) for r in out) == want
        docs = got


def test_run(spark, folder):
    assert pipeline.run(spark, folder).count() > 0
