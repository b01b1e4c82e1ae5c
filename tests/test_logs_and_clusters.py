"""Log lines of any pattern, and clusters that are stored already."""

import datetime as dt

from ledgerloom.operators import signals
from ledgerloom.streaming import events


def test_lines_of_another_format(spark):
    lines = spark.createDataFrame([("[7] pay 12.50 EUR  ",), ("[x] pay 1 EUR",), ("[8] pay ten EUR",), ("",), (None,)], "value string")
    got = events.parse_logs(lines, r"^\[(\d+)\] (\w+) (\S+) EUR$", {"user": "bigint", "what": "string", "amount": "decimal(9,2)"})
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "bigint", "string", "decimal(9,2)"]
    rows = [(r.line, r.user, r.what, None if r.amount is None else float(r.amount)) for r in got.collect()]
    assert rows == [("[7] pay 12.50 EUR", 7, "pay", 12.5), ("[x] pay 1 EUR", None, None, None), ("[8] pay ten EUR", 8, "pay", None),
                    ("", None, None, None), (None, None, None, None)]


def test_a_stored_cluster_is_skipped_until_it_grows(spark):
    schema = "type string, subject string, weight int"
    found = spark.createDataFrame([("late", "a", 3), ("over", "a", 2), ("late", "b", 1)], schema)
    first = signals.cluster(found, dt.date(2024, 1, 1))
    assert first.count() == 1
    assert signals.cluster(found, dt.date(2024, 1, 2), known=first).count() == 0
    more = found.unionByName(spark.createDataFrame([("drop", "b", 4)], schema))
    assert signals.cluster(more, dt.date(2024, 1, 2), known=first).count() == 1
    by_subject = signals.cluster_by_subject(found, dt.date(2024, 1, 1))
    assert signals.unknown(by_subject, by_subject).count() == 0
    assert signals.unknown(by_subject, by_subject.limit(0)).count() == by_subject.count()
