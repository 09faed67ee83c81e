import duckdb

import __spark_entry__ as E
from stratum.plans.registry import ORACLES, QUERIES
from stratum.session import TABLES
from tests.conftest import SMOKE

NO_ORACLE = {"v2_kmeans", "v2b_init_codebook"}
PLAIN = ["v2_kmeans_two_rounds", "j2_tokenise_series"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["lang", "n_total", "n_kept", "avg_cer_kept", "max_cer_kept"]


def test_every_query_has_an_oracle_or_is_listed():
    assert set(QUERIES) - set(ORACLES) == NO_ORACLE
    assert set(ORACLES) <= set(QUERIES) <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())


def _duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return con


def _same(spark_df, con, sql):
    cols = spark_df.columns
    a = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in spark_df.collect())
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    b = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[ocols.index(c)] for c in cols))
               for r in res.fetchall())
    return sorted(cols) == sorted(ocols) and a == b


def test_oracles_on_smoke_tables(spark):
    con = _duck()
    qs, orc = E.queries(), E.oracle_sql()
    for name in ["j1_quality_report", "p4_squash_ws", "t3_render_chat", "k6_pack_next_fit", "k4_pack_ffd",
                 "v6_rvq_encode", "g3_overlap_add", "a1_quantised_cdf", "a4_topk_average", "g8_resample_series", *PLAIN,
                 "k5_gathered_ranks", "v8_codes_to_features", "s7_incremental_shards", "s3_overwrite_shards"]:
        assert _same(qs[name](spark, SMOKE), con, orc[name]), name
