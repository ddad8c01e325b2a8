"""Small hand-made tables."""

from datetime import datetime
from decimal import Decimal

from clientele.sources.schemas import SCHEMAS, Tables


def make_tables(spark, orders=(), customers=None, items=(), payments=(), products=(), reviews=()):
    """Tables from short tuples.

    orders: (order, customer, time[, status]); customers: (customer, person), by
    default every customer is a person of the same name; items: (order, number,
    product, price, freight); payments: (order, number, value); products:
    (product, category); reviews: (review, order, score).
    """
    if customers is None:
        customers = [(c, c) for c in sorted({o[1] for o in orders})]
    rows = {
        "customers": [(c, p, None, None, None) for c, p in customers],
        "orders": [
            (
                o[0],
                o[1],
                o[3] if len(o) > 3 else "delivered",
                None if o[2] is None else datetime.fromisoformat(o[2]),
                None,
                None,
            )
            for o in orders
        ],
        "products": list(products),
        "order_items": [(o, n, p, Decimal(a), Decimal(f)) for o, n, p, a, f in items],
        "payments": [(o, n, "credit_card", 1, Decimal(v)) for o, n, v in payments],
        "reviews": [(r, o, s, None, None) for r, o, s in reviews],
    }
    frames = {}
    for name, schema in SCHEMAS.items():
        # Rows that break a rule must be possible, so every column may be NULL.
        loose = type(schema)([type(f)(f.name, f.dataType, True) for f in schema])
        frames[name] = spark.createDataFrame(rows[name], loose)
    return Tables(**frames)


def by_key(frame, key, *columns):
    """{key: value} or {key: (values)} of a result."""
    rows = frame.collect()
    if len(columns) == 1:
        return {r[key]: r[columns[0]] for r in rows}
    return {r[key]: tuple(r[c] for c in columns) for r in rows}


def text_rows(frame):
    """Rows as text cells, dates and decimals in their usual notation."""
    return [tuple(None if v is None else str(v) for v in row) for row in frame.collect()]
