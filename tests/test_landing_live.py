"""Landing meets live memories only."""

from silt.operators import landing

COLUMNS = "scope string, tier string, text string, subject string, predicate string, object string, observed_at long"


def test_closed_and_archived_memories_are_not_met(spark):
    held = spark.createDataFrame(
        [
            (1, "s", "fact", "db is one", "db", "host", "one", 10, None, None),
            (2, "s", "fact", "db is two", "db", "host", "two", 90, 95, None),
            (3, "s", "fact", "gone claim", None, None, None, 80, None, 99),
            (4, "s", "episode", "db is three", "db", "host", "three", 99, None, None),
        ],
        f"id long, {COLUMNS}, valid_to long, archived_at long",
    )
    new = spark.createDataFrame(
        [(11, "s", "fact", "db is ONE", "db", "host", "ONE", 100, 1.0), (12, "s", "fact", "gone claim", None, None, None, 100, 1.0)],
        f"cid long, {COLUMNS}, weight double",
    )
    single = landing.text.single_valued
    landing.text.single_valued = lambda predicate: predicate == "host"
    try:
        got = {r["cid"]: (r["action"], r["mid"]) for r in landing.resolve(new, held).select("cid", "action", "mid").collect()}
    finally:
        landing.text.single_valued = single
    assert got == {11: ("reinforced", 1), 12: ("added", None)}
