"""Independent SQL for every registered query, on the raw star tables.

Amounts are whole ten-thousandths and ratios are rounded in integer arithmetic,
so no result depends on how an engine rounds a binary fraction.  The statements
take other routes than the Spark plans where there is a choice: gaps come from
LAG, bands from NTILE, cohorts from a join.
"""

from __future__ import annotations

MONEY = 10_000


def ratio(n: str, d: str, places: int) -> str:
    """n / d at some decimals, half away from zero, NULL where d is 0."""
    n, d = f"CAST({n} AS HUGEINT)", f"CAST(nullif({d}, 0) AS HUGEINT)"
    size = f"(2 * abs({n}) * {10**places} + abs({d})) // (2 * abs({d}))"
    return f"(sign({n}) * sign({d}) * CAST({size} AS DOUBLE) / {10**places}.0)"


def money(units: str) -> str:
    return f"(CAST({units} AS DOUBLE) / {MONEY}.0)"


def cents(units: str) -> str:
    """Ten-thousandths rounded to two decimals."""
    return ratio(units, str(MONEY), 2)


def day(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d')"


MONTH = "CAST(date_trunc('month', o_orderdate) AS DATE)"
CENT_PRICE = "CAST(round(l_extendedprice * 100) AS HUGEINT)"
PAID = f"{CENT_PRICE} * (100 - CAST(round(l_discount * 100) AS HUGEINT))"
ITEM = f"{CENT_PRICE} * (100 + CAST(round(l_tax * 100) AS HUGEINT))"


def history(person: str = "c_custkey") -> str:
    """CTEs paid, hist (one row per qualified order), and person."""
    return f"""
WITH paid AS (
  SELECT l_orderkey, sum({PAID}) AS u FROM lineitem GROUP BY l_orderkey
), hist AS (
  SELECT {person} AS person, o_orderkey AS ord, CAST(o_orderdate AS DATE) AS d,
         coalesce(u, 0) AS u
  FROM orders JOIN customer ON c_custkey = o_custkey
  LEFT JOIN paid ON l_orderkey = o_orderkey
  WHERE o_orderdate IS NOT NULL AND o_orderstatus <> 'P'
), gaps AS (
  SELECT *, date_diff('day', lag(d) OVER (PARTITION BY person ORDER BY d, ord), d) AS gap
  FROM hist
), person AS (
  SELECT person, count(*) AS n, min(d) AS f, max(d) AS l, sum(u) AS u,
         date_diff('day', min(d), max(d)) AS span,
         sum(gap) AS gap_days, count(gap) AS gap_count
  FROM gaps GROUP BY person
), dated AS (
  SELECT *, (SELECT max(d) FROM hist) AS today,
         date_diff('day', l, (SELECT max(d) FROM hist)) AS recency
  FROM person
)"""


def retention(person: str) -> str:
    return f"""
WITH months AS (
  SELECT DISTINCT {person} AS person, {MONTH} AS m
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate IS NOT NULL
), firsts AS (SELECT person, min(m) AS c FROM months GROUP BY person),
sizes AS (SELECT c, count(*) AS size FROM firsts GROUP BY c),
active AS (
  SELECT c, date_diff('month', c, m) AS k, count(*) AS kept
  FROM months JOIN firsts USING (person) GROUP BY c, k
), rates AS (
  SELECT c, k, size, kept, {ratio("100 * kept", "size", 2)} AS rate
  FROM active JOIN sizes USING (c)
)"""


def retention_long(person: str) -> str:
    return f"""{retention(person)}
SELECT {day("c")} AS cohort_month, k AS months_since_cohort, size AS cohort_customers,
       kept AS retained_customers, rate AS retention_rate_pct
FROM rates"""


RETENTION_MATRIX = f"""{retention("c_custkey")}
SELECT {day("c")} AS cohort_month, {", ".join(
    f"max(CASE WHEN k = {k} THEN rate END) AS month_{k}" for k in range(13))}
FROM rates GROUP BY c"""


# A month has 487/16 days.
DIVISOR = "(16 * span + 487)"
# Projections keep 12 digits behind the ten-thousandth.
KEPT = 10**12


def path(person: str = "c_custkey") -> str:
    """CTE path: the projection month by month, as a fraction num / den.

    A month adds revenue / orders * orders / (days / (487/16) + 1), which is
    487 * revenue / den.
    """
    recursive = history(person).replace("WITH paid", "WITH RECURSIVE paid")
    return f"""{recursive}, path AS (
  SELECT person, 0 AS k, CAST(u AS HUGEINT) * {DIVISOR} AS num, {DIVISOR} AS den FROM person
  UNION ALL
  SELECT p.person, p.k + 1, p.num + 487 * CAST(a.u AS HUGEINT), p.den
  FROM path AS p JOIN person AS a ON a.person = p.person WHERE p.k < 12
)"""


def clv(person: str = "c_custkey") -> str:
    rounded = f"(2 * abs(num) * {KEPT} + den) // (2 * den)"
    return f"""{path(person)}, highest AS (
  SELECT person, max(num) AS num, any_value(den) AS den FROM path GROUP BY person
), valued AS (
  SELECT person.*, CAST(sign(num) AS HUGEINT) * ({rounded}) AS v
  FROM person JOIN highest ON highest.person = person.person
), ranked AS (
  SELECT *, ntile(4) OVER (ORDER BY v DESC, person) AS q FROM valued
), tiered AS (
  SELECT *, CASE q WHEN 1 THEN 'Top CLV' WHEN 2 THEN 'High CLV'
                   WHEN 3 THEN 'Mid CLV' ELSE 'Low CLV' END AS tier
  FROM ranked
)"""


def customer_clv(person: str = "c_custkey") -> str:
    return f"""{clv(person)}
SELECT person AS customer_unique_id, n AS order_count, {day("f")} AS first_order_date,
       {day("l")} AS last_order_date, {cents("u")} AS historical_revenue,
       {ratio("u", f"n * {MONEY}", 2)} AS average_order_value,
       {ratio("n * 487", DIVISOR, 4)} AS monthly_order_frequency,
       {ratio("u * 487", f"{MONEY} * {DIVISOR}", 2)} AS projected_monthly_revenue,
       {ratio("v", str(KEPT * MONEY), 2)} AS projected_12_month_clv,
       CAST(q AS BIGINT) AS clv_quartile, tier AS clv_tier
FROM tiered"""


CLV_TIERS = f"""{clv()}
SELECT CAST(q AS BIGINT) AS clv_quartile, tier AS clv_tier, count(*) AS customer_count,
       {ratio("sum(v)", str(KEPT * MONEY), 2)} AS projected_clv_total,
       {ratio("sum(v)", f"count(*)::HUGEINT * {KEPT * MONEY}", 2)} AS projected_clv_average
FROM tiered GROUP BY q, tier"""

CLV_PATH = f"""{path()}
SELECT person AS customer_unique_id, CAST(k AS BIGINT) AS projection_month,
       {ratio("num", f"{MONEY} * den", 2)} AS cumulative_projected_clv
FROM path"""


def rfm(best_is_high: bool = False, percent_rank: bool = False) -> str:
    """CTE segmented: scores r, f5, m, and the segment of each person."""
    recency, size = ("DESC", "ASC") if best_is_high else ("ASC", "DESC")

    def score(column: str, way: str) -> str:
        if percent_rank:
            below = f"(rank() OVER (ORDER BY {column} {way}) - 1)"
            others = "greatest(count(*) OVER () - 1, 1)"
            return f"CAST(least(5, 1 + 5 * {below} // {others}) AS BIGINT)"
        return f"CAST(ntile(5) OVER (ORDER BY {column} {way}, person) AS BIGINT)"

    return f"""{history()}, scored AS (
  SELECT *, {score("recency", recency)} AS r, {score("n", size)} AS f5,
         {score("u", size)} AS m
  FROM dated
), segmented AS (
  SELECT *, CASE
      WHEN least(r, f5, m) >= 4 THEN 'Champions'
      WHEN r >= 3 AND f5 >= 4 THEN 'Loyal Customers'
      WHEN r >= 4 AND f5 <= 2 THEN 'New Customers'
      WHEN r <= 2 AND least(f5, m) >= 3 THEN 'At Risk'
      WHEN r = 1 AND greatest(f5, m) <= 2 THEN 'Lost Customers'
      ELSE 'Potential Loyalists' END AS segment
  FROM scored
)"""


def rfm_customers(**options: bool) -> str:
    return f"""{rfm(**options)}
SELECT person AS customer_unique_id, recency AS recency_days, n AS frequency,
       {cents("u")} AS monetary_value, r AS recency_score, f5 AS frequency_score,
       m AS monetary_score, r + f5 + m AS rfm_score, segment AS customer_segment
FROM segmented"""


RFM_SEGMENTS = f"""{rfm()}, totals AS (
  SELECT segment, count(*) AS k, sum(u) AS u FROM segmented GROUP BY segment
)
SELECT segment AS customer_segment, k AS customer_count,
       {ratio("100 * k", "(SELECT sum(k) FROM totals)", 2)} AS customer_share_pct,
       {cents("u")} AS segment_revenue,
       {ratio("100 * u", "(SELECT sum(u) FROM totals)", 2)} AS revenue_contribution_pct,
       {ratio("u", f"k * {MONEY}", 2)} AS average_customer_revenue
FROM totals"""


def status(gap_days: str, gap_count: str) -> str:
    return f"""CASE WHEN recency * {gap_count} <= {gap_days} THEN 'Active'
      WHEN 2 * recency * {gap_count} <= 3 * {gap_days} THEN 'At Risk' ELSE 'Churned' END"""


OWN_GAP = (
    "(CASE WHEN gap_count = 0 THEN 180 ELSE gap_days END)",
    "(CASE WHEN gap_count = 0 THEN 1 ELSE gap_count END)",
)


def churn(gap_days: str, gap_count: str) -> str:
    return f"""{history()}
SELECT person AS customer_unique_id, n AS order_count, {day("l")} AS last_order_date,
       {day("today")} AS analysis_date, recency AS days_since_last_order,
       {ratio(gap_days, gap_count, 1)} AS expected_gap_days,
       {ratio("gap_days", "gap_count", 1)} AS average_gap_days,
       {cents("u")} AS monetary_value, {status(gap_days, gap_count)} AS churn_status
FROM dated"""


CHURN_SEGMENTS = f"""{rfm()}, flagged AS (
  SELECT *, {status(*OWN_GAP)} AS state FROM segmented
)
SELECT segment AS customer_segment, state AS churn_status, count(*) AS customer_count,
       {cents("sum(u)")} AS segment_revenue,
       {ratio("sum(recency)", "count(*)", 1)} AS average_recency_days
FROM flagged GROUP BY segment, state"""

CUSTOMER_STATUS = f"""{rfm()}
SELECT person AS customer_unique_id, segment AS customer_segment,
       {status(*OWN_GAP)} AS churn_status, r + f5 + m AS rfm_score,
       recency AS recency_days, n AS frequency, {cents("u")} AS monetary_value
FROM segmented"""

GROWTH = f"""
WITH sold AS (
  SELECT {MONTH} AS m,
         CASE WHEN p_type IS NULL OR p_type = 'PROMO' THEN 'Unknown' ELSE p_type END AS cat,
         o_orderkey AS ord, {ITEM} AS u
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  LEFT JOIN part ON p_partkey = l_partkey
  WHERE o_orderdate IS NOT NULL AND o_orderstatus <> 'P'
), cells AS (
  SELECT m, cat, count(DISTINCT ord) AS k, sum(u) AS u FROM sold GROUP BY m, cat
), grown AS (
  SELECT *, lag(u) OVER (PARTITION BY cat ORDER BY m) AS before,
         (2 * abs(u) * 100 + {MONEY}) // (2 * {MONEY}) * CAST(sign(u) AS HUGEINT) AS c
  FROM cells
), levels AS (
  SELECT m, cat, 'Monthly Category' AS lv, k, c,
         {ratio("100 * (u - before)", "before", 2)} AS g FROM grown
  UNION ALL
  SELECT NULL, cat, 'Category Subtotal', sum(k), sum(c), NULL FROM grown GROUP BY cat
  UNION ALL
  SELECT NULL, NULL, 'Grand Total', sum(k), sum(c), NULL FROM grown{{extra}}
)
SELECT {day("m")} AS revenue_month, cat AS product_category, lv AS summary_level,
       CAST(k AS BIGINT) AS order_count, CAST(c AS DOUBLE) / 100.0 AS revenue,
       g AS mom_growth_pct
FROM levels"""
CUBE_EXTRA = """
  UNION ALL
  SELECT m, NULL, 'Monthly Total', sum(k), sum(c), NULL FROM grown GROUP BY m"""


def extremes(what: str, key: str, columns: str) -> str:
    join = "LEFT JOIN part ON p_partkey = l_partkey" if what == "Category" else ""
    return f"""
WITH totals AS (
  SELECT {key} AS g, count(DISTINCT o_orderkey) AS k, sum({ITEM}) AS u
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey {join}
  WHERE o_orderdate IS NOT NULL AND o_orderstatus <> 'P'
  GROUP BY 1
), neighbours AS (SELECT *, lag(u) OVER (ORDER BY g) AS before FROM totals)
SELECT {columns}, k AS order_count, {cents("u")} AS revenue,
       CASE WHEN u = (SELECT max(u) FROM totals) THEN 'Best Revenue {what}'
            ELSE 'Lowest Revenue {what}' END AS performance_flag
FROM neighbours
WHERE u IN ((SELECT max(u) FROM totals), (SELECT min(u) FROM totals))"""


MONTH_EXTREMES = extremes(
    "Month",
    MONTH,
    f"{day('g')} AS revenue_month, {ratio('100 * (u - before)', 'before', 2)} AS mom_growth_pct",
)
CATEGORY_EXTREMES = extremes(
    "Category",
    "CASE WHEN p_type IS NULL OR p_type = 'PROMO' THEN 'Unknown' ELSE p_type END",
    "g AS product_category",
)

# Base table, source of its rows, and the source of each checked column.
REVIEWS = """(SELECT 'r' || o_orderkey AS review, o_orderkey AS ord
  FROM orders WHERE o_orderstatus = 'F')"""
SOURCES = {
    "customers": "customer",
    "orders": "orders",
    "products": "part",
    "order_items": "lineitem",
    "payments": "lineitem",
    "reviews": REVIEWS,
}
KEYS = {
    "customers": ("customer_id", "c_custkey"),
    "orders": ("order_id", "o_orderkey"),
    "products": ("product_id", "p_partkey"),
    "order_items": ("order_id, order_item_id", "l_orderkey, l_linenumber"),
    "payments": ("order_id, payment_sequential", "l_orderkey, l_linenumber"),
    "reviews": ("review_id", "review"),
}
PARENTS = [
    ("orders", "customer_id", "o_custkey", "customers", "c_custkey"),
    ("order_items", "order_id", "l_orderkey", "orders", "o_orderkey"),
    ("order_items", "product_id", "l_partkey", "products", "p_partkey"),
    ("payments", "order_id", "l_orderkey", "orders", "o_orderkey"),
    ("reviews", "order_id", "ord", "orders", "o_orderkey"),
]
REQUIRED = {
    "customers": {"customer_id": "c_custkey", "customer_unique_id": "c_custkey"},
    "orders": {
        "order_id": "o_orderkey",
        "customer_id": "o_custkey",
        "order_status": "o_orderstatus",
        "order_purchase_timestamp": "o_orderdate",
    },
    "products": {"product_id": "p_partkey"},
    "order_items": {
        "order_id": "l_orderkey",
        "order_item_id": "l_linenumber",
        "product_id": "l_partkey",
        "price": "l_extendedprice",
        "freight_value": "l_extendedprice * l_tax",
    },
    "payments": {
        "order_id": "l_orderkey",
        "payment_sequential": "l_linenumber",
        "payment_value": "l_extendedprice * l_discount",
    },
    "reviews": {"review_id": "review", "order_id": "ord"},
}


def union(*parts: str) -> str:
    return "\nUNION ALL\n".join(parts)


PK_VIOLATIONS = union(
    *[
        f"""SELECT '{table}' AS table_name, 'primary key ({names})' AS rule,
       CAST(coalesce(sum(k - 1), 0) AS BIGINT) AS violations
FROM (SELECT count(*) AS k FROM {SOURCES[table]} AS s GROUP BY {columns})"""
        for table, (names, columns) in KEYS.items()
    ]
)
FK_VIOLATIONS = union(
    *[
        f"""SELECT '{child}' AS table_name, 'foreign key ({name}) to {parent}' AS rule,
       count(*) AS violations
FROM {SOURCES[child]} AS s WHERE {column} IS NOT NULL
 AND {column} NOT IN (SELECT {key} FROM {SOURCES[parent]} WHERE {key} IS NOT NULL)"""
        for child, name, column, parent, key in PARENTS
    ]
)
VALUE_VIOLATIONS = union(
    *[
        f"""SELECT '{table}' AS table_name, 'not null ({name})' AS rule,
       count(*) AS violations
FROM {SOURCES[table]} AS s WHERE {column} IS NULL"""
        for table, columns in REQUIRED.items()
        for name, column in columns.items()
    ],
    # All reviews of the star tables have five points.
    f"""SELECT 'reviews' AS table_name, 'range (review_score) 1 to 5' AS rule,
       count(*) FILTER (WHERE score NOT BETWEEN 1 AND 5) AS violations
FROM (SELECT 5 AS score FROM {REVIEWS})""",
)
# The same rules on tables without some parents and with some missing values.
WITH_BROKEN = """
WITH customer AS (SELECT * FROM main.customer WHERE c_mktsegment <> 'BUILDING'),
orders AS (SELECT * FROM main.orders WHERE o_orderstatus <> 'P'),
part AS (SELECT * FROM main.part WHERE p_type <> 'PROMO'),
lineitem AS (
  SELECT * REPLACE (CASE WHEN l_linenumber <> 3 THEN l_partkey END AS l_partkey)
  FROM main.lineitem
)
"""
BROKEN_TABLES = WITH_BROKEN + union(PK_VIOLATIONS, FK_VIOLATIONS, VALUE_VIOLATIONS)

# (table, columns, SQL of the columns); within a list all have the same types.
COMPARABLE_KEYS = [
    [
        ("customers", "customer_id", "c_custkey"),
        ("customers", "customer_unique_id", "c_custkey"),
        ("orders", "order_id", "o_orderkey"),
        ("orders", "customer_id", "o_custkey"),
        ("products", "product_id", "p_partkey"),
        ("order_items", "order_id", "l_orderkey"),
        ("order_items", "product_id", "l_partkey"),
        ("payments", "order_id", "l_orderkey"),
        ("reviews", "order_id", "ord"),
    ],
    [("order_items", "order_item_id", "l_linenumber")],
    [("reviews", "review_id", "review")],
    [
        ("order_items", "order_id, order_item_id", "l_orderkey, l_linenumber"),
        ("payments", "order_id, payment_sequential", "l_orderkey, l_linenumber"),
    ],
]


def filled(columns: str) -> str:
    return " AND ".join(f"{column} IS NOT NULL" for column in columns.split(", "))


def repeated(table: str, columns: str) -> str:
    """Rows with a missing key, and rows beyond the first of each key."""
    return f"""(SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT {columns} FROM {SOURCES[table]} AS d
  WHERE {filled(columns)})) FROM {SOURCES[table]} AS r)"""


def declared_key(table: str, names: str) -> str:
    return str(KEYS[table][0] == names)


def key_candidate(table: str, names: str, columns: str) -> str:
    there = f"SELECT * FROM {SOURCES[table]} AS s WHERE {filled(columns)}"
    return f"""SELECT '{table}' AS table_name, '{names}' AS key_columns,
       (SELECT count(*) FROM {SOURCES[table]} AS s) AS row_count,
       (SELECT count(*) FROM {SOURCES[table]} AS s WHERE NOT ({filled(columns)})) AS missing,
       (SELECT count(*) FROM (SELECT DISTINCT {columns} FROM ({there}))) AS distinct_values,
       (SELECT CAST(coalesce(sum(k - 1), 0) AS BIGINT)
        FROM (SELECT count(*) AS k FROM ({there}) GROUP BY {columns})) AS repeated_rows,
       {repeated(table, columns)} = 0 AS is_key, {declared_key(table, names)} AS declared"""


def key_inclusion(child: tuple[str, str, str], parent: tuple[str, str, str]) -> str:
    referred = any((child[0], child[1], parent[0], parent[1]) == (c, n, p, n) for c, n, _, p, _ in PARENTS)
    lost = f"""FROM {SOURCES[child[0]]} AS s WHERE {filled(child[2])} AND ({child[2]}) NOT IN
  (SELECT {f"({parent[2]})" if ", " in parent[2] else parent[2]} FROM {SOURCES[parent[0]]} AS p WHERE {filled(parent[2])})"""
    return f"""SELECT '{child[0]}' AS child_table, '{child[1]}' AS child_columns,
       '{parent[0]}' AS parent_table, '{parent[1]}' AS parent_columns,
       (SELECT count(*) FROM (SELECT DISTINCT {child[2]} {lost})) AS lost_values,
       (SELECT count(*) {lost}) AS lost_rows, (SELECT count(*) {lost}) = 0 AS holds,
       {repeated(parent[0], parent[2])} = 0 AS parent_is_key, {referred} AS declared"""


KEY_CANDIDATES = union(*[key_candidate(*key) for group in COMPARABLE_KEYS for key in group])
KEY_INCLUSIONS = union(
    *[
        key_inclusion(child, parent)
        for group in COMPARABLE_KEYS
        for child in group
        for parent in group
        if child[0] != parent[0]
    ]
)
ROW_COUNTS = union(
    *[
        f"SELECT '{table}' AS table_name, count(*) AS row_count FROM {source} AS s"
        for table, source in SOURCES.items()
    ]
)

FIRST_ITEM = f"""
SELECT l_orderkey AS ord, {ITEM} AS u,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {ITEM}) AS place
FROM lineitem"""


def payment_columns(number: str) -> str:
    return f"""ord AS order_id, CAST({number} AS BIGINT) AS payment_sequential,
       'credit_card' AS payment_type, CAST(1 AS BIGINT) AS payment_installments,
       {money("u")} AS payment_value"""


DERIVED_PAYMENTS = f"SELECT {payment_columns('1')} FROM ({FIRST_ITEM}) WHERE place = 1"
INSERT_IGNORE = f"""
WITH existing AS (
  SELECT ord, 1 AS number, u FROM ({FIRST_ITEM}) JOIN orders ON o_orderkey = ord
  WHERE place = 1 AND o_orderstatus = 'F'
), batch AS (
  SELECT l_orderkey AS ord, l_linenumber AS number, min({PAID}) AS u
  FROM lineitem GROUP BY l_orderkey, l_linenumber
)
SELECT {payment_columns("number")} FROM (
  SELECT * FROM existing
  UNION ALL
  SELECT * FROM batch AS b
  WHERE NOT EXISTS (SELECT 1 FROM existing AS e WHERE e.ord = b.ord AND e.number = b.number)
)"""
DERIVED_REVIEWS = f"""
SELECT review AS review_id, ord AS order_id, CAST(5 AS BIGINT) AS review_score
FROM {REVIEWS}"""

RUNNING = f"""{history()}
SELECT person AS customer_unique_id, ord AS order_id, {day("d")} AS order_date,
       {money("u")} AS order_revenue,
       {money("sum(u) OVER (PARTITION BY person ORDER BY d, ord ROWS UNBOUNDED PRECEDING)")}
         AS cumulative_revenue
FROM hist"""
GAPS = f"""{history()}
SELECT person AS customer_unique_id, ord AS order_id, {day("d")} AS order_date,
       {day("lag(d) OVER w")} AS previous_order_date,
       {day("lead(d) OVER w")} AS next_order_date,
       CAST(date_diff('day', lag(d) OVER w, d) AS DOUBLE) AS days_since_previous,
       CAST(date_diff('day', d, lead(d) OVER w) AS DOUBLE) AS days_to_next
FROM hist WINDOW w AS (PARTITION BY person ORDER BY d, ord)"""

PAIR = "c_custkey // 2"

# Documents that went through a CSV file; its fields tell an empty text from none.
CSV_REVIEWS = """
SELECT CAST(doc_id AS VARCHAR) AS review_id, 'o' || doc_id AS order_id,
       1 + doc_id % 5 AS review_score, source AS review_comment_title,
       text AS review_comment_message FROM documents"""

CSV_REJECTS = """
WITH rows AS (
  SELECT l_quantity, CASE
    WHEN l_orderkey % 83 = 0 THEN 'number of fields'
    WHEN l_orderkey % 89 = 0 THEN 'order_id: missing'
    WHEN l_orderkey % 97 = 0 THEN 'payment_sequential: not int'
    WHEN l_orderkey % 79 = 0 THEN 'payment_value: not decimal(12,2)'
    ELSE 'good' END AS cause
  FROM lineitem)
SELECT cause, count(*) AS records,
       CAST(sum(CAST(l_quantity AS DECIMAL(12, 2))) FILTER (cause = 'good') AS DOUBLE) AS value,
       CASE WHEN cause = 'good' THEN 'card, "gold"' || chr(10) || 'or other' END AS payment_type
FROM rows GROUP BY cause"""

ORACLE: dict[str, str] = {
    "order_revenue": f"""SELECT l_orderkey AS order_id, {money(f"sum({PAID})")} AS order_revenue
FROM lineitem GROUP BY l_orderkey""",
    "customer_orders": f"""{history()}
SELECT person AS customer_unique_id, ord AS order_id, {day("d")} AS order_date,
       {money("u")} AS order_revenue FROM hist""",
    "customer_monthly_orders": f"""
SELECT o_custkey AS customer_id, {day(MONTH)} AS order_month, count(*) AS order_count
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY o_custkey, {MONTH}""",
    "active_customer_months": f"""
SELECT count(*) AS active_customer_months FROM (
  SELECT DISTINCT c_custkey, {MONTH} FROM orders JOIN customer ON c_custkey = o_custkey
  WHERE o_orderdate IS NOT NULL)""",
    "cohort_retention_long": retention_long("c_custkey"),
    "cohort_retention_person_variant": retention_long(PAIR),
    "cohort_retention_matrix": RETENTION_MATRIX,
    "running_revenue": RUNNING,
    "order_gaps": GAPS,
    "clv_projection_path": CLV_PATH,
    "customer_clv": customer_clv(),
    "customer_clv_person_variant": customer_clv(PAIR),
    "clv_tier_summary": CLV_TIERS,
    "rfm_customers": rfm_customers(),
    "rfm_customers_corrected": rfm_customers(best_is_high=True),
    "rfm_segment_summary": RFM_SEGMENTS,
    "percent_rank_scores": rfm_customers(percent_rank=True),
    "churn_flags": churn(*OWN_GAP),
    "fixed_window_churn": churn("90", "1"),
    "churn_by_segment": CHURN_SEGMENTS,
    "customer_status": CUSTOMER_STATUS,
    "growth_rollup": GROWTH.format(extra=""),
    "growth_cube": GROWTH.format(extra=CUBE_EXTRA),
    "month_extremes": MONTH_EXTREMES,
    "category_extremes": CATEGORY_EXTREMES,
    "table_row_counts": ROW_COUNTS,
    "pk_violations": PK_VIOLATIONS,
    "fk_violations": FK_VIOLATIONS,
    "null_and_range_violations": VALUE_VIOLATIONS,
    "check_tables": union(PK_VIOLATIONS, FK_VIOLATIONS, VALUE_VIOLATIONS),
    "check_broken_tables": BROKEN_TABLES,
    "key_candidates": KEY_CANDIDATES,
    "key_inclusions": KEY_INCLUSIONS,
    "key_candidates_of_broken_tables": WITH_BROKEN + KEY_CANDIDATES,
    "key_inclusions_of_broken_tables": WITH_BROKEN + KEY_INCLUSIONS,
    "csv_reviews": CSV_REVIEWS,
    "csv_rejects": CSV_REJECTS,
    "insert_ignore": INSERT_IGNORE,
    "derived_payments": DERIVED_PAYMENTS,
    "derived_reviews": DERIVED_REVIEWS,
}
