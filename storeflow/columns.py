"""Column lists of the raw sales / production-planning feed.

Everything here is a default: a :class:`storeflow.spec.SalesSpec` can be built
from any other set of columns.
"""

# --- fixed values: column names and defaults of the retail feed -------------

GROUP_KEYS = ("store_id", "Item Slin")
TIME_COLUMN = "transaction_timestamp"
DATE_COLUMNS = ("day_date",)
TARGET = "sales_unit_qty"
GROSS = "Gross_sales"
PRICE = "avg_sell_price"
PROMOTION = "promotion_id"
PROMOTION_QUANTITY = "promo_quantity"

SUM_COLUMNS = ("sales_unit_qty", "Gross_sales", "promo_amount")
MEAN_COLUMNS = ("avg_sell_price", "PRODUCTION_QUANTITY", "HOLD_TIME")

NUMERIC_COLUMNS = (
    "Gross_sales", "avg_sell_price", "promo_quantity", "promo_amount",
    "PRODUCTION_QUANTITY", "HOLD_TIME", "MIN_PRES", "MAX_PRES",
    "ALERT_LOOK_AHEAD_MIN", "QUANTITY_LOOK_AHEAD_MIN", "OPENING_PRES_FIXED",
    "OPENING_PRES_PREDICTIVE", "PRODUCTION_MULTIPLIER",
    "FORECAST_WEIGHT_PERCENTAGE", "Latitude", "Longitude",
    "Store_Hours_Per_Day", "Retail_Minimum_Hours", "Restaurant_Minimum_Hours",
)

CATEGORICAL_COLUMNS = (
    "ITEM_NAME", "Item Slin", "ITEM_UNIT", "store_id", "state_id", "City",
    "County", "DAYPART_NAME", "weekday", "Holidays", "event_name_1",
    "event_type_1", "event_name_2", "event_type_2", "promotion_id", "DMA_Name",
    "zone_code", "cat_id", "dept_id", "Flow", "HOLD_TIME_UNIT", "PERIOD_NAME",
    "PRODUCTION_PERIOD_GROUP_NAME", "PRODUCTION_PERIOD_GROUP_ID",
    "Operating_System", "POS_Type", "PREDICTIVE_MODEL", "ROUNDING",
    "DAYPART_DAYS", "eff_reg_start_date", "eff_reg_end_date",
    "ORGANIZATION_ID", "country_ops_code", "country_ops_description",
    "Operator_Changeover_Date", "LastChgDTM", "franchise_code",
    "Hierarchy_Level", "owner_code", "DMA_Code", "Time_Zone_Code",
    "postal_code", "market_code", "Super_Market", "super_zone",
    "store_ops_code", "total_zone_code", "Store_Operating_Hours_Mon",
    "Store_Operating_Hours_Tue", "Store_Operating_Hours_Wed",
    "Store_Operating_Hours_Thu", "Store_Operating_Hours_Fri",
    "Store_Operating_Hours_Sat", "Store_Operating_Hours_Sun",
)

FLAG_COLUMNS = (
    "Flag_Delivery", "self_checkout", "Mobile_Checkout", "Metro", "Corner",
    "Rest_Ops", "Daylight_Saving_Indicator", "product_active_flag",
    "PERISHABLE", "snap_CA", "snap_TX", "snap_WI",
)

# Flags of the feed that no configuration scales.
NEVER_SCALED = ("snap_CA", "snap_TX", "snap_WI", "PERISHABLE")

FILLS = {
    "OPENING_PRES_FIXED": 0,
    "event_name_1": "No_Event",
    "event_type_1": "No_Event",
    "event_name_2": "No_Event",
    "event_type_2": "No_Event",
    "Holidays": "No_Holiday",
    "promo_amount": 0,
    "promo_quantity": 0,
}
UNKNOWN = "UNKNOWN"

DROP_COLUMNS = (
    "Item Name", "ITEM_TREE", "slc_item_number", "noi_slin", "promo_slin",
    "selling_upc", "upc", "product_id", "item_description", "item_id", "date",
    "trans_sales_date_key", "DAYPART_START", "DAYPART_END", "item_dimensions",
    "product_hierarchy", "manufacturer", "Brand", "description", "address",
    "Vicinity", "Geography", "market_desc", "Super_Market_Description",
    "store_ops_description", "total_zone_description",
    "super_zone_description", "zone_name", "ITEM_TYPE", "transaction_number",
    "PRODUCTION_STATUS", "State", "PERIOD_STATUS", "DAYPART_STATUS",
    "PRODUCTION_PERIOD_GROUP_STATUS", "country_code", "location_number",
    "location_id", "SPW_store_number", "store_name", "fiscal_year",
    "fiscal_month", "calendar_week", "fiscal_week", "wday", "month", "year",
    "wm_yr_wk",
)

CALENDAR = {
    "transaction_timestamp": ("hour", "dayofweek", "month", "quarter", "year", "weekofyear"),
    "day_date": ("dayofweek", "month", "dayofmonth", "is_weekend"),
}

# Model roles. A column may have a role although no job step produces it.
STATIC_CATEGORICALS = (
    "store_id", "Item Slin", "ITEM_NAME", "ITEM_UNIT", "HOLD_TIME_UNIT",
    "Flow", "cat_id", "dept_id", "state_id", "City", "County", "DMA_Name",
    "zone_code", "franchise_code", "Hierarchy_Level",
    "PRODUCTION_PERIOD_GROUP_ID", "owner_code", "DMA_Code", "Time_Zone_Code",
    "postal_code", "market_code", "Super_Market", "zone_name",
    "store_ops_code", "total_zone_code", "super_zone", "Operating_System",
    "POS_Type", "Flag_Delivery", "self_checkout", "Mobile_Checkout", "Metro",
    "Corner", "PREDICTIVE_MODEL", "ROUNDING", "ORGANIZATION_ID",
    "country_ops_code", "country_ops_description", "Rest_Ops",
    "Daylight_Saving_Indicator", "Operator_Changeover_Date",
    "Store_Operating_Hours_Mon", "Store_Operating_Hours_Tue",
    "Store_Operating_Hours_Wed", "Store_Operating_Hours_Thu",
    "Store_Operating_Hours_Fri", "Store_Operating_Hours_Sat",
    "Store_Operating_Hours_Sun",
)
STATIC_REALS = (
    "PRODUCTION_QUANTITY", "HOLD_TIME", "MIN_PRES", "MAX_PRES",
    "ALERT_LOOK_AHEAD_MIN", "QUANTITY_LOOK_AHEAD_MIN", "PRODUCTION_MULTIPLIER",
    "Latitude", "Longitude", "PERISHABLE", "FORECAST_WEIGHT_PERCENTAGE",
    "OPENING_PRES_PREDICTIVE", "OPENING_PRES_FIXED", "Store_Hours_Per_Day",
    "Retail_Minimum_Hours", "Restaurant_Minimum_Hours",
)
KNOWN_CATEGORICALS = (
    "DAYPART_NAME", "PERIOD_NAME", "PRODUCTION_PERIOD_GROUP_NAME",
    "DAYPART_DAYS", "product_active_flag", "eff_reg_start_date",
    "eff_reg_end_date", "LastChgDTM", "weekday", "Holidays", "event_name_1",
    "event_type_1", "event_name_2", "event_type_2", "promotion_id",
)
KNOWN_REALS = (
    "transaction_timestamp_hour_sin", "transaction_timestamp_hour_cos",
    "transaction_timestamp_dayofweek_sin", "transaction_timestamp_dayofweek_cos",
    "transaction_timestamp_month_sin", "transaction_timestamp_month_cos",
    "transaction_timestamp_weekofyear_sin", "transaction_timestamp_weekofyear_cos",
    "transaction_timestamp_quarter", "transaction_timestamp_year",
    "day_date_dayofweek_sin", "day_date_dayofweek_cos",
    "day_date_month_sin", "day_date_month_cos",
    "day_date_dayofmonth_sin", "day_date_dayofmonth_cos", "day_date_is_weekend",
    "snap_CA", "snap_TX", "snap_WI", "promo_amount",
)
UNKNOWN_CATEGORICALS = ()
UNKNOWN_REALS = ("sales_unit_qty", "Gross_sales", "avg_sell_price", "promo_quantity")

HISTORY = 30
HORIZON = 7

# --- end of fixed values ----------------------------------------------------

ROLES = {
    "static_categoricals": STATIC_CATEGORICALS,
    "static_reals": STATIC_REALS,
    "time_varying_known_categoricals": KNOWN_CATEGORICALS,
    "time_varying_known_reals": KNOWN_REALS,
    "time_varying_unknown_categoricals": UNKNOWN_CATEGORICALS,
    "time_varying_unknown_reals": UNKNOWN_REALS,
}
