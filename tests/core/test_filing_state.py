from datetime import date, datetime

from ledgerlark.streaming import incremental
from ledgerlark.streaming.filing_state import EVENT, OUTCOME, expires, filing_events, filing_states

LONG_AGO, LAST_YEAR = date(2023, 12, 31), date(2025, 3, 1)


def fed(spark, folder, batches):
    """The events of each batch of outcomes, read from files, in one query that is restarted for each."""
    out = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, OUTCOME).coalesce(1).write.parquet(f"{folder}/in/b{k}")
        stream = spark.readStream.schema(OUTCOME).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        query = filing_events(stream, "1 day").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start()
        query.awaitTermination()
        seen = [tuple(r) for r in spark.read.schema(EVENT).parquet(f"{folder}/out").collect()]
        out.append(sorted(((c, f, e, n) for c, f, _, e, n, _ in seen)))
    return out, spark.read.schema(EVENT).parquet(f"{folder}/out")


def test_filings_are_read_retried_recovered_and_expire(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    at = lambda month, day, year=2026: datetime(year, month, day, 12)
    batches = [
        [("house", "a", LAST_YEAR, "read", at(1, 1)), ("house", "b", LAST_YEAR, "error", at(1, 1)), ("house", "c", LAST_YEAR, "paper", at(1, 1)), ("senate", "a", LAST_YEAR, "error", at(1, 1)), ("house", None, LAST_YEAR, "read", at(1, 1)), ("house", "x", LAST_YEAR, "odd", at(1, 1))],
        [("house", "a", LAST_YEAR, "error", at(1, 4)), ("house", "b", LAST_YEAR, "read", at(1, 4)), ("house", "old", LONG_AGO, "read", at(1, 4))],
        [("house", "d", date(2026, 1, 5), "error", at(1, 5)), ("house", "d", date(2026, 1, 5), "paper", at(1, 6)), ("senate", "a", LAST_YEAR, "error", at(1, 6))],
        [("house", "e", date(2027, 2, 1), "read", at(2, 2, 2027))],
        [("house", "f", date(2027, 2, 1), "read", at(2, 3, 2027)), ("house", "late", LAST_YEAR, "read", at(2, 3, 2027))],
    ]
    steps, events = fed(spark, tmp_path, batches)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    new = [sorted(set(b) - set(a)) for a, b in zip([[], *steps], steps, strict=False)]
    assert new[0] == [("house", "a", "read", 0), ("house", "b", "failed", 1), ("house", "c", "paper", 0), ("senate", "a", "failed", 1)]
    assert ("house", "b", "recovered", 1) in new[1] and not [e for e in new[1] if e[1] in ("a", "old") and e[0] == "house"]
    assert ("senate", "a", "retry", 1) in steps[2] and ("senate", "a", "failed", 2) in new[2] and {("house", "d", "failed", 1), ("house", "d", "paper", 1)} <= set(new[2])
    assert {e[:3] for e in steps[4] if e[2] == "expired"} == {("house", x, "expired") for x in "abc"} | {("senate", "a", "expired")}
    assert not [e for e in steps[4] if e[1] == "late"]
    assert sorted((r.chamber, r.filing_id, r.status) for r in filing_states(events).collect()) == [("house", "d", "paper"), ("house", "e", "read"), ("house", "f", "read")]
    assert expires(LAST_YEAR) == int(datetime(2027, 1, 1).timestamp() * 1000)


def test_states_equal_those_of_runs(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    filings = lambda rows: spark.createDataFrame([("house", i, "M", None, None, LAST_YEAR, f"/{i}", p, t) for i, p, t in rows], "chamber string, filing_id string, member string, state string, district string, filing_date date, source_url string, is_paper boolean, text string")
    good, bad = "A Corp P 05/03/2025 05/04/2025 $1,001 - $15,000", "nothing"
    rounds = [[("1", False, good), ("2", False, bad), ("3", True, None), ("4", False, bad)], [("2", False, good), ("4", False, bad), ("5", False, good)]]
    from ledgerlark.operators.filings import text_trades

    data, roster = incremental.Dataset(spark, f"{tmp_path}/data"), spark.createDataFrame([], "position int, name string, chamber string, party string, state string, district string, aliases array<string>")
    for rows in rounds:
        incremental.run(data, filings(rows), text_trades, roster, "2026-06-01", "now")
    outcome = lambda paper, text: "paper" if paper else "read" if text == good else "error"
    _, events = fed(spark, tmp_path, [[("house", i, LAST_YEAR, outcome(p, t), datetime(2026, 6, k + 1)) for i, p, t in rows] for k, rows in enumerate(rounds)])
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    states = {r.filing_id: r.status for r in filing_states(events).collect()}
    assert {i for i, s in states.items() if s != "failed"} == {r.filing_id for r in data.read("processed").collect()}
    skipped = {r.filing_id: r.reason for r in data.read("skipped_filings").collect()}
    assert {i: "paper" if s == "paper" else "parse_error" for i, s in states.items() if s != "read"} == skipped
