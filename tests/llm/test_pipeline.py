import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodegraph.llm import packing, queries

from ..conftest import SF
from ..oracle import connect, same
from .helpers import LOWER, empty, table
from .test_quality import counts_by_hand
from .test_texts import ITEMS, classes_by_hand, variants


def survivors_by_hand(rows):
    """The pipeline's rules on plain lists; the labels of the test prove no cutoff."""
    rows = [(i, t) for i, t in rows if (c := counts_by_hand(t))[0] >= 10 and 100 * c[4] <= 20 * c[0]]
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in t.split("\n")]
    often = {k for k, n in Counter(k for _, t in rows for k in set(keys(t)) if k).items() if n >= 10}
    rows = [(i, "\n".join(x for x, k in zip(t.split("\n"), keys(t), strict=True) if k not in often)) for i, t in rows]
    kept = {i for i, _, _, k in classes_by_hand(rows, 80) if k}
    rows = [(i, t) for i, t in rows if i in kept]
    return [(i, t) for i, t in rows if not any(x in t.lower() for x in ITEMS)]


def test_pipeline_by_hand(spark, tmp_path):
    boiler = "this line stands in many documents and says nothing at all"
    own = [f"{' '.join(f'p{k}q{j}' for j in range(30))}" + (f"\n{boiler.upper() if k % 2 else boiler}" if k < 14 else "") for k in range(20)]
    texts = [*own, *variants(12), own[3], "short text", None, "", " ".join(["again and again we say it"] * 20), f"{' '.join(f'r{j}' for j in range(60))} {ITEMS[0].upper()} end"]
    docs = table(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    t = packing.WordTokenizer(packing.default_tokenizer()).tokenizer
    want = Counter()
    for i, text in survivors_by_hand(list(enumerate(texts))):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        want[i, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want


def test_stages_keep_the_columns_and_take_any_row(spark, tmp_path):
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, ITEMS[0])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    same_row = "a row that stands here twice with the very same id and text in it"
    docs = table(spark, [same_row, same_row, same_row, None, "", "no id but a text with more than ten words is in this row"], [7, 7, 8, 9, None, None])
    for frame in (docs, empty(spark)):
        df = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, str(tmp_path))
            assert df.columns == docs.columns, name
            df = spark.createDataFrame(df.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).select(F.sum("length")).collect() is not None
        if frame is docs:
            assert sorted((r["doc_id"] or -1 for r in df.collect())) == [-1, 7]


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark, tmp_path):
    a, b = (" ".join(f"{x}{j}" for j in range(30)) for x in "ab")
    docs = table(spark, [a, a, b, b, b, a, "c", "c"], [7, 8, 8, None, None, None, None, None])
    found = corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path))
    assert sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=repr) == sorted([(7, a), (8, b), (None, "c")], key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["op2_sharding", "op3_quality_classifier", "op6_pii", "op8_decontamination"])
def test_queries_cover_the_table(spark, name):
    found = queries.QUERIES[name](spark, SF)
    if name != "op8_decontamination":
        assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert found.columns[0] == "doc_id"
