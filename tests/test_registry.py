"""Every named query gives the rows of its SQL."""

import datetime as dt
import decimal

import duckdb
import pytest
from conftest import TESTDATA

from storeflow import registry

QUERIES, SQL = registry.load()
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# The operator list of the survey, by query name.
OPERATORS = """
csv_scan table_scan list_tables item_catalogue overwrite_table ensure_schema catalog_copy predictions_upload
transactions_append_clear drop_configured normalise_categoricals parse_timestamps parse_dates cast_numerics
hour_bucket prefix_pivot_columns restore_time_column column_report gate_target gate_gross gate_price
fill_configured fill_unknown fill_pivot_zero predictions_by_date predictions_by_slot predictions_by_category
comparison_by_category valid_quantity promo_left_join enrich_transactions store_lookup slot_lookup
forecast_vs_actual hourly_agg first_non_null promo_pivot feature_stats label_dictionary slot_totals
prediction_stats comparison_summary monthly_comparison actuals_by_date pos_stats units_by_category
items_by_category recent_feed category_order label_rank cal_hour cal_dayofweek cal_dayofmonth cal_month
cal_quarter cal_year cal_weekofyear cal_is_weekend cyclical_encode binary_flags log1p_target standard_scale
label_encode upper_trim slot_of sales_price ext_sales_price difference accuracy_pct accuracy_band
stream_slot_actuals stream_dedupe stream_pos_stats stream_upsert model_features clean_hourly_sales time_index
role_projection training_sequences
""".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TESTDATA}/sf0.001/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int | float | decimal.Decimal):
        return repr(float(value) + 0.0)
    assert not isinstance(value, dt.date | list | dict), "queries give plain values"
    return value


def test_every_operator_has_a_query_and_sql():
    assert len(OPERATORS) == 79 and set(OPERATORS) <= set(QUERIES)
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    names = sorted(df.columns)
    got = sorted([plain(r[c]) for c in names] for r in df.collect())
    found = duck.execute(SQL[name])
    order = [c[0] for c in found.description]
    assert sorted(order) == names
    expected = sorted([plain(r[order.index(c)]) for c in names] for r in found.fetchall())
    assert got == expected and got


def test_flagship_query(spark, small_dir):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() == 943 and "transaction_timestamp_hour_sin" in df.columns


def without_text_queries(monkeypatch, named):
    """The entry with imports of the text queries failing for lack of a module."""
    import __spark_entry__ as entry

    found = entry.importlib.import_module

    def load(name):
        if name in ("storeflow.llm.registry", "corpus_pipeline"):
            raise ModuleNotFoundError(name=named or name.removesuffix(".registry"))
        return found(name)

    monkeypatch.setattr(entry.importlib, "import_module", load)
    return entry


def test_text_queries_may_be_absent(monkeypatch):
    entry = without_text_queries(monkeypatch, None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(SQL)


def test_other_import_errors_are_not_hidden(monkeypatch):
    with pytest.raises(ModuleNotFoundError):
        without_text_queries(monkeypatch, "numpy").queries()
