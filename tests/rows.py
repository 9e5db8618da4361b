"""Hand-written purchases rows (FIXTURES.md §B)."""

import datetime as dt
from decimal import Decimal

SCHEMA = (
    "purchase_date timestamp_ntz, invoice_id bigint, store_location string, disp_category string, "
    "revenue_subcategory string, product_name string, vendor_name string, quantity double, "
    "purchase_price_w_discount decimal(18,2), unit_cost decimal(18,2)"
)
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]
DEFAULTS = {
    "purchase_date": dt.datetime(2024, 1, 10, 12, 0),
    "invoice_id": 1,
    "store_location": "Main",
    "disp_category": "Food",
    "revenue_subcategory": "Snacks",
    "product_name": "Chips",
    "vendor_name": "Acme",
    "quantity": 1.0,
    "purchase_price_w_discount": Decimal("10.00"),
    "unit_cost": Decimal("4.00"),
}


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def dec(x) -> Decimal | None:
    return None if x is None else Decimal(str(x))


def make(spark, *rows):
    out = []
    for r in rows:
        d = dict(DEFAULTS)
        d.update(r)
        for k in ("purchase_price_w_discount", "unit_cost"):
            if d[k] is not None and not isinstance(d[k], Decimal):
                d[k] = dec(d[k])
        if isinstance(d["purchase_date"], str):
            d["purchase_date"] = ts(d["purchase_date"])
        out.append(tuple(d[f] for f in FIELDS))
    return spark.createDataFrame(out, SCHEMA)
