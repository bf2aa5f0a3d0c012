"""Changes between snapshots against a loop, and odd rows."""

import datetime as dt
import random
from decimal import Decimal

from glintframe.operators.snapshots import snapshot_changes

LISTING = "library string, snapshot_no int, position long, key string, fingerprint decimal(20,0), feed string, state_ix int"
DELIVERY = "build_id long, library string, snapshot_no int, delivered_at timestamp, entries array<struct<key:string,path:string,fingerprint:decimal(20,0),view:string>>"


def listing(spark, rows):
    return spark.createDataFrame([(*r[:4], None if r[4] is None else Decimal(r[4]), "x", 9) for r in rows], LISTING)


def deliveries(spark, rows):
    return spark.createDataFrame(rows, DELIVERY)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_listings(spark):
    rows = [
        ("a", 1, 0, "k", 1), ("a", 1, 1, "gone", 1), ("a", 1, 2, "", 5),
        ("a", 4, 0, "k", 1), ("a", 4, 5, "k", 2), ("a", 4, 1, None, 2), ("a", 4, 2, "nofp", None), ("a", 4, 2, "", 5), ("a", 4, 2, "", 5),
        ("a", 7, 0, "k", 2), ("a", 7, 0, "gone", 2**64 - 1), ("a", 7, 0, "", 6),
        ("b", 1, 0, "only", 1), (None, 1, 0, "k", 1), ("a", None, 0, "k", 1),
    ]
    want = [("index", "a", 4, "gone", "full", "removed"), ("index", "a", 4, "k", "full", "changed"), ("index", "a", 7, "", "full", "changed"), ("index", "a", 7, "gone", "full", "added")]
    assert got(snapshot_changes(listing(spark, rows), deliveries(spark, []))) == sorted(want)


def test_deliveries(spark):
    t = [dt.datetime(2031, 1, d) for d in range(1, 6)]
    e = lambda k, f, v=None, p="p": None if k == "NULL" else (k, p, None if f is None else Decimal(f), v)
    rows = [
        (1, "a", 1, t[0], [e("k", 1), e("k", 1, "center"), e("k", 3), e("NULL", 1), e(None, 1), e("x", None)]),
        (2, "a", 2, t[1], [e("other", 1)]),
        (3, "a", 2, t[2], [e("k", 3, "full", "moved"), e("k", 2, "center")]),
        (4, "a", 2, t[3], None),
        (5, "a", 3, t[1], []),
        (6, "a", 5, t[1], [e("k", 3)]),
        (7, "a", 5, t[1], [e("k", 4)]),
    ]
    want = [
        ("build", "a", 2, "k", "center", "changed"), ("build", "a", 3, "k", "full", "removed"), ("build", "a", 3, "k", "center", "removed"), ("build", "a", 5, "k", "full", "added"),
    ]
    assert got(snapshot_changes(listing(spark, []), deliveries(spark, rows))) == sorted(want)


def test_empty(spark):
    assert got(snapshot_changes(listing(spark, []), deliveries(spark, []))) == []


def test_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(0, 9, 2), rng.randrange(50), rng.choice("uvwxyz"), rng.randrange(3)) for _ in range(300)]
    rows = list({(r[0], r[1], r[2], r[3]): r for r in rows}.values())
    state = {}
    for lib, no, pos, key, fp in rows:
        cell = state.setdefault(lib, {}).setdefault(no, {})
        cell[key] = max(cell.get(key, (-1, 0)), (pos, fp))
    want = []
    for lib, by_no in state.items():
        numbers = sorted(by_no)
        for before, after in zip(numbers, numbers[1:], strict=False):
            a, b = by_no[before], by_no[after]
            for key in set(a) | set(b):
                change = "added" if key not in a else "removed" if key not in b else "changed" if a[key][1] != b[key][1] else None
                if change:
                    want.append(("index", lib, after, key, "full", change))
    assert got(snapshot_changes(listing(spark, rows), deliveries(spark, []))) == sorted(want)
