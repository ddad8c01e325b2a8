"""All main reports against plain Python with fractions, on untidy random tables.

The tables hold what a clean data set would not: repeated rows, missing states,
persons, times and parents, unpaid and overpaid orders, refunds.
"""

import random
from collections import defaultdict
from datetime import date
from decimal import Decimal
from fractions import Fraction

import pytest
from helpers import make_tables

from clientele import AnalysisConfig, Analytics


def untidy(seed):
    rng = random.Random(seed)
    customers = [
        (f"c{i:02d}", None if rng.random() < 0.05 else f"u{i // 2:02d}") for i in range(30)
    ]
    customers += rng.choices(customers, k=4)
    states = ["delivered", "shipped", "canceled", "unavailable", None]
    orders = []
    for i in range(140):
        day = f"{rng.choice((2022, 2023))}-{rng.randint(1, 12):02d}-{rng.choice((1, 2, 15, 28)):02d}"
        orders.append(
            (
                f"o{i:03d}",
                f"c{rng.randrange(33):02d}",
                None if rng.random() < 0.04 else f"{day}T{rng.randrange(24):02d}:30",
                rng.choices(states, (80, 30, 8, 4, 4))[0],
            )
        )
    orders += rng.choices(orders, k=6)
    cents = lambda: f"{rng.randint(-500, 9999) / 100:.2f}"
    numbers = [f"o{rng.randrange(145):03d}" for _ in range(200)]
    payments = [(o, i, cents()) for i, o in enumerate(numbers)]
    items = [
        (o, i, f"p{rng.randrange(9)}", cents(), f"{rng.randint(0, 300) / 100:.2f}")
        for i, o in enumerate(numbers)
    ]
    products = [(f"p{i}", None if i == 3 else f"category {i % 3}") for i in range(8)]
    return dict(
        orders=orders, customers=customers, payments=payments, items=items, products=products
    )


def half_up(value, places):
    if value is None:
        return None
    scaled = abs(value) * 10**places + Fraction(1, 2)
    whole = int(scaled // 1)
    return Decimal(whole if value >= 0 else -whole).scaleb(-places)


def day_of(time):
    return date.fromisoformat(time[:10])


def month_of(time):
    return day_of(time).replace(day=1)


def counts(order):
    return order[2] is not None and order[3] not in ("canceled", "unavailable", None)


def history(data):
    """{person: sorted distinct (day, order, revenue)}"""
    paid = defaultdict(Fraction)
    for order, _, value in data["payments"]:
        paid[order] += Fraction(value)
    rows = {
        (person, day_of(o[2]), o[0], paid.get(o[0], Fraction(0)))
        for o in data["orders"]
        if counts(o)
        for customer, person in data["customers"]
        if customer == o[1] and person is not None
    }
    persons = defaultdict(list)
    for person, *row in sorted(rows):
        persons[person].append(tuple(row))
    return persons


def ntile(rows, bands):
    """{person: band} of persons in order."""
    size, larger = divmod(len(rows), bands)
    sizes = [size + (band < larger) for band in range(bands)]
    numbered = [band + 1 for band in range(bands) for _ in range(sizes[band])]
    return dict(zip(rows, numbered))


@pytest.fixture(scope="module", params=[1, 2])
def case(request, spark):
    data = untidy(request.param)
    return data, make_tables(spark, **data)


@pytest.fixture
def shop(case):
    return Analytics(case[1])


def found(frame, *columns):
    return sorted(tuple(row[c] for c in columns) for row in frame.collect())


def test_history_and_running_revenue(case):
    expected = []
    for person, rows in history(case[0]).items():
        total = Fraction(0)
        for day, order, revenue in rows:
            total += revenue
            expected.append((person, order, day, revenue, total))
    running = Analytics(case[1]).customer_running_revenue()
    columns = ["customer_unique_id", "order_id", "order_date", "order_revenue", "cumulative_revenue"]
    assert running.columns == columns
    assert found(running, *columns) == sorted(expected)


def test_clv(case, shop):
    values = {}
    for person, rows in history(case[0]).items():
        revenue, span = sum(r[2] for r in rows), (rows[-1][0] - rows[0][0]).days
        frequency = len(rows) / (Fraction(span) / Fraction("30.4375") + 1)
        monthly = revenue / len(rows) * frequency
        path = [revenue + k * monthly for k in range(13)]
        values[person] = (max(path), revenue, len(rows), frequency, monthly)
    quartile = ntile(sorted(values, key=lambda p: (-values[p][0], p)), 4)
    expected = [
        (
            person,
            orders,
            half_up(revenue, 2),
            half_up(revenue / orders, 2),
            half_up(frequency, 4),
            half_up(monthly, 2),
            half_up(best, 2),
            quartile[person],
        )
        for person, (best, revenue, orders, frequency, monthly) in values.items()
    ]
    assert found(
        shop.customer_clv(),
        "customer_unique_id",
        "order_count",
        "historical_revenue",
        "average_order_value",
        "monthly_order_frequency",
        "projected_monthly_revenue",
        "projected_12_month_clv",
        "clv_quartile",
    ) == sorted(expected)
    tiers = [
        (
            q,
            sum(1 for p in quartile if quartile[p] == q),
            half_up(sum(values[p][0] for p in quartile if quartile[p] == q), 2),
        )
        for q in (1, 2, 3, 4)
    ]
    tier = found(shop.clv_tier_summary(), "clv_quartile", "customer_count", "projected_clv_total")
    assert tier == tiers


def test_segments_and_churn(case, shop):
    persons = history(case[0])
    today = max(rows[-1][0] for rows in persons.values())
    silent = {p: (today - rows[-1][0]).days for p, rows in persons.items()}
    spent = {p: sum(r[2] for r in rows) for p, rows in persons.items()}
    recency = ntile(sorted(persons, key=lambda p: (silent[p], p)), 5)
    frequency = ntile(sorted(persons, key=lambda p: (-len(persons[p]), p)), 5)
    monetary = ntile(sorted(persons, key=lambda p: (-spent[p], p)), 5)

    def segment(r, f, m):
        if min(r, f, m) >= 4:
            return "Champions"
        if r >= 3 and f >= 4:
            return "Loyal Customers"
        if r >= 4 and f <= 2:
            return "New Customers"
        if r <= 2 and f >= 3 and m >= 3:
            return "At Risk"
        return "Lost Customers" if r == 1 and f <= 2 and m <= 2 else "Potential Loyalists"

    def state(p):
        gaps = [(b[0] - a[0]).days for a, b in zip(persons[p], persons[p][1:])]
        gap = Fraction(sum(gaps), len(gaps)) if gaps else Fraction(180)
        if silent[p] <= gap:
            return "Active"
        return "At Risk" if silent[p] <= gap * Fraction(3, 2) else "Churned"

    expected = sorted(
        (
            p,
            segment(recency[p], frequency[p], monetary[p]),
            state(p),
            recency[p] + frequency[p] + monetary[p],
            silent[p],
            len(persons[p]),
            half_up(spent[p], 2),
        )
        for p in persons
    )
    status = shop.customer_status()
    assert found(status, *status.columns) == expected
    flags = found(shop.churn_flags(), "customer_unique_id", "churn_status")
    assert flags == [(row[0], row[2]) for row in expected]
    everyone = sum(spent.values())
    summary = []
    for name in {row[1] for row in expected}:
        members = [row[0] for row in expected if row[1] == name]
        revenue = sum(spent[p] for p in members)
        summary.append(
            (
                name,
                len(members),
                half_up(Fraction(100 * len(members), len(persons)), 2),
                half_up(revenue, 2),
                half_up(100 * revenue / everyone, 2),
                half_up(revenue / len(members), 2),
            )
        )
    segments = shop.rfm_segment_summary()
    assert found(segments, *segments.columns) == sorted(summary)


def test_retention(case):
    data, tables = case
    months = defaultdict(set)
    for order in data["orders"]:
        for customer, person in data["customers"]:
            if customer == order[1] and person is not None and order[2] is not None:
                months[person].add(month_of(order[2]))
    kept = defaultdict(int)
    for active in months.values():
        first = min(active)
        for month in active:
            kept[first, 12 * (month.year - first.year) + month.month - first.month] += 1
    expected = [
        (first, k, kept[first, 0], n, half_up(Fraction(100 * n, kept[first, 0]), 2))
        for (first, k), n in kept.items()
    ]
    long = Analytics(tables).cohort_retention_long()
    assert found(long, *long.columns) == sorted(expected)


def test_growth(case):
    data, tables = case
    category = dict(data["products"])
    ids, revenue = defaultdict(set), defaultdict(Fraction)
    for order in data["orders"]:
        for number, _, product, price, freight in data["items"]:
            if number == order[0] and counts(order):
                cell = (category.get(product) or "Unknown", month_of(order[2]))
                ids[cell].add(number)
                revenue[cell] += Fraction(price) + Fraction(freight)
    expected, before = [], {}
    for name, month in sorted(revenue):
        amount, last = revenue[name, month], before.get(name)
        growth = half_up(100 * (amount - last) / last, 2) if last else None
        expected.append((name, month, len(ids[name, month]), half_up(amount, 2), growth))
        before[name] = amount
    detail = Analytics(tables).growth_rollup().filter("summary_level = 'Monthly Category'")
    columns = ["product_category", "revenue_month", "order_count", "revenue", "mom_growth_pct"]
    assert found(detail, *columns) == expected
