"""Laws that hold for any input."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from rows import frame, sale

from storeflow.functions.calendar import PERIODS, cycle_pair
from storeflow.functions.slots import slot_of
from storeflow.operators import hourly as H
from storeflow.operators import labels as L
from storeflow.operators import scaling as Z
from storeflow.operators.cleaning import typed_rows
from storeflow.spec import SalesSpec

FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
SPEC = SalesSpec(row_id="row_id")

numbers = st.floats(-1e6, 1e6, allow_nan=False).map(lambda x: round(x, 3))
sales = st.lists(
    st.tuples(
        st.sampled_from(["s1", "s2", None]), st.sampled_from([10, 11, 23]),
        st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 50).map(float)),
        st.sampled_from(["x", "y", None]),
    ),
    min_size=1, max_size=25,
)


@FEW
@given(rows=sales)
def test_one_pass_is_the_join_form(spark, rows):
    raw = [sale(row_id=n, store_id=s, time=f"2024-01-01 {h}:30:00", promo=p, promo_quantity=q, cat=c)
           for n, (s, h, p, q, c) in enumerate(rows)]
    typed = typed_rows(frame(spark, *raw), SPEC)
    one = H.hourly_sales(typed, SPEC, [None, "A", "B"])
    two = H.promo_left_join(typed, SPEC, [None, "A", "B"]).select(one.columns)
    key = lambda r: str(tuple(r))
    assert sorted(one.collect(), key=key) == sorted(two.collect(), key=key)


@FEW
@given(values=st.lists(numbers, min_size=2, max_size=30))
def test_scaled_values_have_mean_0_and_deviation_1(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    made = [r.x for r in Z.standard_scale(df, ["x"]).collect()]
    assert math.isclose(sum(made) / len(made), 0, abs_tol=1e-6)
    if max(values) - min(values) > 1e-3:
        deviation = math.sqrt(sum(x * x for x in made) / (len(made) - 1))
        assert math.isclose(deviation, 1, rel_tol=1e-6)


@FEW
@given(values=st.lists(st.one_of(st.none(), st.text("ab1", max_size=2)), min_size=1, max_size=40))
def test_labels_are_dense_and_ordered_by_count(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    got = sorted(L.fit_labels(df, ["c"]).collect(), key=lambda r: r.idx)
    known = [v for v in values if v is not None]
    expected = sorted(set(known), key=lambda v: (-known.count(v), v))
    assert [r.value for r in got] == expected and [r.idx for r in got] == list(range(len(expected)))


def test_cycles_lie_on_the_unit_circle(spark):
    df = spark.range(0, 60)
    for period in PERIODS.values():
        made = df.select(*cycle_pair(F.col("id"), period, "v"))
        assert made.agg(F.max(F.abs(F.col("v_sin") ** 2 + F.col("v_cos") ** 2 - 1))).first()[0] < 1e-9


def test_slots_cover_1_to_12(spark):
    hours = spark.range(24).select(slot_of(F.timestamp_seconds(F.col("id") * 3600)).alias("s"))
    assert [r.s for r in hours.distinct().orderBy("s").collect()] == list(range(1, 13))
