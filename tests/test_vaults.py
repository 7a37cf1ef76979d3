from datetime import datetime

from pyspark.sql import functions as F

from marlstone.operators import notes
from marlstone.sources import readers


def test_identifiers_of_vaults(spark):
    vaults = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "1"), (5, None), (None, "z"), (2, "b")], "vault_id long, name string")
    asked = spark.createDataFrame([(x, 0) for x in ("1", "a", "b", "9", "B", "", None, "z", "a", "5")], "identifier string, name int")
    got = {r.identifier: (r.state, r.vault_id) for r in notes.resolve_vaults(asked, vaults).collect()}
    missing = dict.fromkeys(("9", "B", "", None, "z"), ("missing", None))
    assert got == {"1": ("found", 1), "a": ("found", 1), "b": ("ambiguous", None), "5": ("found", 5), **missing}
    assert {r.state for r in notes.resolve_vaults(asked, vaults.limit(0)).collect()} == {"missing"}


def test_themes_of_resting_vaults_are_dormant(spark):
    at = datetime(2024, 3, 1)
    rows = [(1, "active", datetime(2024, 1, 30), at), (2, "active", datetime(2024, 1, 31), None), (3, "stale", at, at), (5, "active", datetime(2024, 4, 1), None), (5, "active", datetime(2024, 2, 24), None), (6, "active", None, None)]
    table = spark.createDataFrame(rows, "vault_id long, status string, created_at timestamp_ntz, publish_date timestamp_ntz")
    themes = spark.createDataFrame([(v, [("x", "growing", v)]) for v in (1, 2, 3, 4, 5, 6)], "vault_id long, themes array<struct<name: string, trend: string, n: long>>")
    themes = themes.unionByName(spark.createDataFrame([(7, None)], themes.schema))
    fresh = notes.fresh_summaries(themes, table, F.lit("2024-03-01").cast("timestamp_ntz")).collect()
    got = {r.vault_id: (r.themes and r.themes[0].trend, r.days_since_last_note, r.last_7_days, r.last_30_days) for r in fresh}
    rest = {v: ("growing", None, 0, 0) for v in (3, 4, 6)}
    assert got == {1: ("dormant", 31, 0, 0), 2: ("growing", 30, 0, 1), 5: ("growing", 0, 2, 2), 7: (None, None, 0, 0), **rest}


def test_log_of_scans(spark):
    scans = {1: {"a": 1, "b": 5}, 2: {"a": 1, "b": 4}, 3: {"a": 2}, 5: {"b": 1, "c": 1}, 6: {"b": 1}, 7: {}}
    rows = [(p, m, n, "x") for n, files in scans.items() for p, m in files.items()] + [("a", 0, 1, "y"), (None, 1, 1, ""), ("d", None, 2, ""), ("e", 1, None, "")]
    listings = spark.createDataFrame(rows, "path string, modified long, scan long, change string")
    want = [("a", 1, "new"), ("a", 3, "changed"), ("a", 4, "deleted"), ("b", 1, "new"), ("b", 3, "deleted"), ("b", 5, "returning"), ("c", 5, "new"), ("c", 6, "deleted")]
    assert sorted(map(tuple, readers.change_log(listings).collect())) == want
    assert sorted(map(tuple, readers.change_log(listings, F.lit(7)).collect())) == sorted([*want, ("b", 7, "deleted")])
    assert readers.change_log(listings.limit(0)).count() == 0
