"""The pipeline's stages on their own input, and the whole against a plain restatement."""

import brute
import corpus_pipeline
import numpy as np
import pytest

from lumenlake.llm import mixing, neardup, quality, tokenout


@pytest.fixture(scope="module")
def written(spark, sf_dir, tmp_path_factory):
    root, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf_dir)
        made.write.parquet(str(root / name))
        out.append((name, docs, spark.read.parquet(str(root / name))))
        docs = out[-1][2]
    return {name: (before, after) for name, before, after in out}


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_order_and_columns(written):
    assert list(written) == ["quality", "neardup", "decontam", "mixing", "tokens"]
    for name, (before, after) in written.items():
        assert (after.columns == before.columns) == (name != "tokens")


def test_quality_stage(written, spark, sf_dir):
    before, after = written["quality"]
    forest = quality.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids(after) == ids(quality.assess(before, forest).where("kept"))


def test_neardup_stage(written):
    before, after = written["neardup"]
    rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
    found = brute.components(rows, neardup.SHINGLE, neardup.PERCENT)
    assert ids(after) == sorted(i for i, (_, c) in found.items() if c == i)


def test_decontam_stage(written, spark, sf_dir):
    before, after = written["decontam"]
    rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert ids(after) == sorted({i for i, _ in rows} - {x[0] for x in brute.leaks(rows, items)})


def test_mixing_and_token_stages(written):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    before, after = written["mixing"]
    assert ids(before) == ids(after)
    at = {r["doc_id"]: r["position"] for r in mixing.schedule(before, corpus_pipeline.WEIGHTS, default_weight=corpus_pipeline.DEFAULT_WEIGHT).collect()}
    plain, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: r for r in written["tokens"][1].collect()}
    for row in sorted(after.select("doc_id", "text").collect(), key=lambda r: at[r["doc_id"]]):
        x = plain.encode(row["text"], add_special_tokens=False).ids + [tokenout.END_ID]
        r = got[row["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        start += len(x)


def test_run_equals_the_stages(written, spark, sf_dir):
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(corpus_pipeline.run(spark, sf_dir)) == rows(written["tokens"][1])


def test_stages_on_awkward_tables(spark, sf_dir):
    from test_operators import ROWS

    columns = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in ROWS], columns)
    for df in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, sf_dir)
            rows = out.collect()
            assert name == "tokens" or out.columns == df.columns
            assert len(rows) <= len(ROWS)
