"""Hand-made raw sales rows."""

COLUMNS = (
    "row_id bigint, store_id string, `Item Slin` string, transaction_timestamp string, day_date string, "
    "promotion_id string, sales_unit_qty double, Gross_sales string, promo_amount double, "
    "promo_quantity double, avg_sell_price double, PRODUCTION_QUANTITY double, HOLD_TIME double, "
    "ITEM_NAME string, cat_id string, Holidays string, event_name_1 string, PERISHABLE string, "
    "snap_CA int, Latitude double, OPENING_PRES_FIXED double, State string, month int"
)
BLANK = dict(
    row_id=1, store_id="s1", item="i1", time="2024-03-02 10:15:00", day="2024-03-02", promo="p1", units=1.0,
    gross="2.0", promo_amount=None, promo_quantity=1.0, price=2.0, produced=4.0, hold=3.0, name="bun",
    cat="food", holidays=None, event=None, perishable="Y", snap=1, latitude=1.5, opening=None, state="TX", month=3,
)


def sale(**changes):
    unknown = set(changes) - set(BLANK)
    assert not unknown, unknown
    return tuple({**BLANK, **changes}.values())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), COLUMNS)
