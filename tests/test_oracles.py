"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from millrace.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["corpus_funnel", "normalize_steps", "filter_reasons_tight", "exact_dedup", "split_fallback_val", "mix_oversample", "token_estimate", "lm_samples", "causal_softmax", "rope", "transformer_block", "qkv_projection", "swiglu_ffn", "eos_invariant", "mix_stats", "source_report"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    return sorted(tuple("-" if x != x or x is None else repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(duck.sql(catalog.oracle_sql()[name]).df())


def test_every_query_has_an_oracle_or_is_named():
    assert {n for n in catalog.queries() if n not in catalog.oracle_sql()} == {"bpe_encode", "token_counts"}
