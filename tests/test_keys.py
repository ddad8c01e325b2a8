"""Keys and references that the rows show, against counting in plain Python."""

from collections import Counter
from dataclasses import replace

import pytest
from helpers import make_tables
from pyspark.sql import functions as F

from clientele.plans import keys
from clientele.plans.keys import Candidate, id_candidates, key_candidates, key_inclusions
from clientele.plans.measure import plan_nodes


@pytest.fixture(scope="module")
def tables(spark):
    """A third of all items are of one order; ids with quotes and commas; nulls and orphans."""
    items = [("o1" if i % 3 == 0 else f"o{i % 50}", i, f"p{i % 7}" if i % 5 else None, "1.00", "0.00") for i in range(900)]
    return make_tables(
        spark,
        [("o1", 'c"1', "2024-01-01"), ("o2", "c,2", "2024-01-02"), ("o2", "gone", "2024-01-03"), ("o3", None, "2024-01-04")],
        customers=[('c"1', "u1"), ("c,2", "u1"), (None, "u2"), (None, "u2")],
        items=[*items, items[0]],
        payments=[("o1", 1, "1.00"), ("o2", 1, "1.00")],
        products=[(f"p{i}", None) for i in range(6)],
        reviews=[("r1", "o1", 5), ("r2", "o9", 5)],
    )


def _values(tables, candidate):
    rows = tables.named()[candidate.table].select(*candidate.columns).collect()
    return [tuple(row) for row in rows]


def test_candidates_and_inclusions_equal_counting(tables):
    candidates = id_candidates()
    values = {c: _values(tables, c) for c in candidates}
    counts = {c: Counter(v for v in values[c] if None not in v) for c in candidates}
    expected = {
        (c.table, c.label): (
            len(values[c]),
            len(values[c]) - counts[c].total(),
            len(counts[c]),
            counts[c].total() - len(counts[c]),
            len(values[c]) == len(counts[c]),
        )
        for c in candidates
    }
    found = {
        (r.table_name, r.key_columns): (r.row_count, r.missing, r.distinct_values, r.repeated_rows, r.is_key)
        for r in key_candidates(tables).collect()
    }
    assert found == expected
    assert not found["orders", "order_id"][-1] and found["reviews", "review_id"][-1]

    pairs = key_inclusions(tables).collect()
    for r in pairs:
        child = Candidate(r.child_table, tuple(r.child_columns.split(", ")))
        parent = Candidate(r.parent_table, tuple(r.parent_columns.split(", ")))
        lost = [n for v, n in counts[child].items() if v not in counts[parent]]
        assert (r.lost_values, r.lost_rows, r.holds) == (len(lost), sum(lost), not lost)
        assert r.parent_is_key == expected[parent.table, parent.label][-1]
    # Columns of one type meet only those of that type in other tables.
    text = [c for c in candidates if len(c.columns) == 1 and c.columns != ("order_item_id",)]
    same = sum(a.table != b.table for a in text for b in text)
    assert len(pairs) == same + 2
    assert sum(r.declared for r in pairs) == 5


def test_empty_tables(spark):
    empty = make_tables(spark)
    rows = key_candidates(empty).collect()
    assert rows and all((r.row_count, r.missing, r.repeated_rows, r.is_key) == (0, 0, 0, True) for r in rows)
    assert all((r.lost_values, r.lost_rows, r.holds) == (0, 0, True) for r in key_inclusions(empty).collect())


def test_added_columns_and_chosen_candidates(tables):
    wider = replace(tables, reviews=tables.reviews.withColumns({"value": F.lit(1), "at": F.lit(2), "n0": F.lit(3)}))
    chosen = [Candidate("reviews", ("order_id", "review_id")), Candidate("customers", ("customer_unique_id",))]
    found = {r.table_name: r.is_key for r in key_candidates(wider, chosen).collect()}
    assert found == {"reviews": True, "customers": False}
    with pytest.raises(ValueError):
        key_inclusions(wider, chosen)


def test_one_grouped_pass(spark, tables, tmp_path):
    for name, frame in tables.named().items():
        frame.write.parquet(f"{tmp_path}/{name}")
    stored = replace(tables, **{n: spark.read.parquet(f"{tmp_path}/{n}") for n in tables.named()})
    for report in (key_candidates, key_inclusions):
        plan = report(stored)
        assert plan_nodes(plan, "Scan") == 6
        # By value, by the candidates that share it, and the totals; each after partial sums.
        assert plan_nodes(plan, "Exchange") == 3
        assert plan_nodes(plan, "SortMergeJoin") + plan_nodes(plan, "BroadcastHashJoin") == 0


def test_only_what_pairs_need_is_counted(tables, monkeypatch):
    """Counters of one kind of values, and no column whose type no other table has."""
    counted = []
    occurrences = keys._occurrences

    def watched(tables, candidates):
        counted.append((candidates, occurrences(tables, candidates)))
        return counted[-1][1]

    monkeypatch.setattr(keys, "_occurrences", watched)
    assert key_inclusions(tables).count() > 0
    candidates, found = counted[0]
    assert ("order_item_id",) not in {c.columns for c in candidates}
    single = [c for c in candidates if len(c.columns) == 1]
    assert len(found.columns) == 2 + len(single) < 2 + len(candidates)


def test_parts_of_a_key_are_told_apart(spark):
    items = [("1:1", 1, "p", "1.00", "0.00"), ("1", 11, "p", "1.00", "0.00"), ("1,1", 1, "p", "1.00", "0.00")]
    chosen = [Candidate("order_items", ("order_id", "product_id"))]
    rows = [*items, ("1", 2, "1:p", "1.00", "0.00"), ("11:", 2, "p", "1.00", "0.00")]
    found = key_candidates(make_tables(spark, items=rows), chosen).first()
    assert (found.distinct_values, found.is_key) == (5, True)
