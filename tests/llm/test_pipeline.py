"""The pipeline's stages on small tables, each against what its operator promises."""

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from millrace.llm import bagminhash, secrets
from millrace.llm.tokens import default_path
from millrace.sources.tables import load


def test_stages(spark, sf):
    docs = load(spark, sf, "documents")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(spark.createDataFrame(stage(spark, kept[-1], sf).collect(), docs.schema))
        assert kept[-1].columns == docs.columns
    language, lines, near, clean = ({r["doc_id"]: r for r in k.collect()} for k in kept[1:])
    assert len(language) >= 0.97 * docs.count()
    assert lines.keys() == language.keys() and sum(len(r["text"]) for r in lines.values()) < sum(len(r["text"]) for r in language.values())
    bags = [bagminhash.bag(r["text"]) for r in near.values()]
    assert max(bagminhash.overlap(x, y) for i, x in enumerate(bags) for y in bags[:i]) < 0.8
    assert clean.keys() == near.keys() and not any(secrets.scan_block([r["text"] for r in clean.values()]))
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept[-1], sf).collect()
    library = Tokenizer.from_file(default_path())
    assert sum(r["length"] for r in pieces) == sum(len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in clean.values())


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(rows.columns) and rows.count() > 100


def test_empty_and_odd_rows(spark, sf):
    docs = load(spark, sf, "documents")
    assert [len(corpus_pipeline.STAGES)] == [5] and corpus_pipeline.ORACLE_SQL is None
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "the end of the time is near and the rest", "en", "s", 40), (2, "the end of the time is near and the rest", "en", "s", 40)], docs.schema)
    for table in (odd, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            table = spark.createDataFrame(stage(spark, table, sf).collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, table, sf).count() == table.count()


@pytest.fixture(autouse=True)
def quiet(spark):
    spark.sparkContext.setLogLevel("ERROR")
