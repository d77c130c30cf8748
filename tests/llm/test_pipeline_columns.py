"""Pipeline stages with columns whose names the operators use inside, null ids, repeated rows and empty tables."""

import os

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
NAMES = ["score", "lang_pred", "switches", "_text", "_row", "_bad", "_bad_text", "rest", "more", "none", "a.b", "doc id", "n_words", "h", "fp"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not mounted")
@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_other_columns(spark, name, stage):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in base.collect()]
    rows += [(None, *rows[0][1:]), (None, None, None, None, None), (10 ** 6, "", "en", "s", 0), rows[1], rows[1]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    more = spark.createDataFrame([(*r, *(f"{n}-{r[0]}" for n in NAMES)) for r in rows], schema)
    out = stage(spark, more, SF)
    assert out.columns == more.columns
    got = out.collect()
    plain = stage(spark, spark.createDataFrame(rows, base.schema), SF).collect()
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, map(tuple, plain))) and len(got) > 50
    assert all(tuple(r)[5:] == tuple(f"{n}-{r.doc_id}" for n in NAMES) for r in got)
    assert stage(spark, more.limit(0), SF).count() == 0
