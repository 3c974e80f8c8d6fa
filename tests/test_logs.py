import datetime
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from salescope.functions.fixed_values import GENESIS_HASH
from salescope.operators import audit, calls, costs, experiments, failures, performance

NOW = datetime.datetime(2024, 1, 10, 12)


@pytest.fixture(scope="module")
def stats(spark):
    rows = [("fast", 0.1, False)] * 19 + [("fast", 2.0, False), ("slow", 9.0, False), ("slow", 1.0, True), ("broken", 1.0, True)]
    frame = spark.createDataFrame([(i, NOW, *r) for i, r in enumerate(rows)], "event_id long, ts timestamp_ntz, operation string, duration double, is_error boolean")
    return frame, performance.operation_stats(frame)


def test_operation_stats(stats):
    got = {r.operation: r.asDict() for r in stats[1].collect()}
    # Position int(20 * .95) is the last of twenty, not the nineteenth.
    assert got["fast"]["p95"] == 2.0 and got["fast"]["p50"] == 0.1 and got["fast"]["count"] == 20
    assert got["slow"]["error_rate"] == 0.5 and got["slow"]["std_dev"] == 0.0
    assert got["broken"]["count"] == 0 and got["broken"]["avg"] == 0.0 and got["broken"]["error_rate"] == 1.0


def test_operation_reports(stats):
    summary = performance.operation_summary(stats[1]).first()
    assert summary.total_operations == 21 and summary.total_errors == 2 and summary.active_operations == 3
    assert summary.slowest_operation == "slow" and summary.most_error_prone == "broken"
    assert [r.operation for r in performance.operation_ranking(stats[1], "nonsense", 2).collect()] == ["slow", "fast"]
    assert [r.operation for r in performance.slow_operations(stats[1]).collect()] == ["slow"]
    assert [r.operation for r in performance.high_error_operations(stats[1]).collect()] == ["slow"]
    assert [r["index"] for r in performance.duration_series(stats[0], "fast").orderBy("index").collect()] == list(range(20))


def test_call_costs(spark):
    frame = spark.createDataFrame(
        [(NOW, "gpt-4o", 1000, 500, "a", "u", "s"), (NOW, "unheard-of", 1000, 1000, "b", "u", "s")],
        "ts timestamp_ntz, model string, input_tokens long, output_tokens long, agent string, user string, session_id string",
    )
    priced = {r.model: float(r.total_cost) for r in costs.call_costs(frame).collect()}
    assert priced == {"gpt-4o": 0.0125, "unheard-of": 0.00075}
    custom = costs.call_costs(frame, {**costs.TOKEN_PRICES, "unheard-of": (1.0, 2.0)})
    assert float(custom.where("model = 'unheard-of'").first().total_cost) == 3.0
    report = costs.daily_cost_report(costs.call_costs(frame), "2024-01-11", 45).collect()
    assert len(report) == 45 and report[-2].calls == 2 and report[-1].calls == 0


def test_chain_equals_hand_made(spark):
    day, other = datetime.date(2024, 1, 1), datetime.date(2024, 1, 2)
    entries = [(day, i, json.dumps({"user": f"ü{i}", "action_type": "x", "details": {"n": i}})) for i in range(5)] + [(other, 0, '{"a": 1}')]
    chain = audit.build_chain(spark.createDataFrame(entries, "log_date date, at int, entry string"), "key", ["at"])
    rows = chain.orderBy("log_date", "seq").collect()
    previous = GENESIS_HASH
    for (_, _, entry), row in zip(entries[:5], rows):
        text = json.dumps({**json.loads(entry), "prev_hash": previous}, sort_keys=True)
        previous = hmac.new(b"key", text.encode(), hashlib.sha256).hexdigest()
        assert row.payload == text and row.hash == previous
    assert rows[5].prev_hash == GENESIS_HASH
    stored = spark.createDataFrame(rows, chain.schema)
    assert all(r.intact for r in audit.verify_chains(stored, "key").collect())
    assert not any(r.intact for r in audit.verify_chains(stored, "wrong").collect())
    gone = stored.where("not (log_date = '2024-01-01' and seq = 2)")
    assert {r.log_date: r.first_broken for r in audit.verify_chains(gone, "key").collect()} == {day: 3, other: None}
    # Raw lines as another program wrote them: keys in any order, hash included.
    lines = [(r.log_date, r.seq, json.dumps({**json.loads(r.payload), "hash": r.hash})) for r in rows]
    lines.append((other, 1, "{broken"))
    foreign = audit.chain_from_lines(spark.createDataFrame(lines, "log_date date, seq long, line string"))
    assert {r.log_date: r.intact for r in audit.verify_chains(foreign, "key").collect()} == {day: True, other: False}
    recent = {str(r.day): (r.entries, r.intact) for r in audit.verify_recent(stored, "key", "2024-01-03", 3).collect()}
    assert recent == {"2024-01-01": (5, True), "2024-01-02": (1, True), "2024-01-03": (0, True)}


def test_long_keys(spark):
    key = "k" * 100
    frame = spark.createDataFrame([("text",)], "t string")
    assert frame.select(audit.hmac_sha256(F.col("t"), key)).first()[0] == hmac.new(key.encode(), b"text", hashlib.sha256).hexdigest()


def test_redaction(spark):
    cases = {
        '{"a":1,"Password":"x","n":{"api_key":5,"list":[{"auth":true,"k":1}]}}': {"a": 1, "Password": "[REDACTED]", "n": {"api_key": "[REDACTED]", "list": [{"auth": "[REDACTED]", "k": 1}]}},
        '{"note":"my token is","x":[1,2]}': {"note": "my token is", "x": [1, 2]},
        '{"secret":{"a":1},"b":2}': {"secret": "[REDACTED]", "b": 2},
        '{"say":"he said \\"token\\": 5","token":"q\\"z"}': {"say": 'he said "token": 5', "token": "[REDACTED]"},
        '{"t\\u006fken":[1]}': {"token": "[REDACTED]"},
        '{"credentials":[{"a":1}],"list":[1,"x",{"private":null}]}': {"credentials": "[REDACTED]", "list": [1, "x", {"private": "[REDACTED]"}]},
    }
    frame = spark.createDataFrame([(k,) for k in cases], "d string")
    got = {r.d: json.loads(r.r) for r in frame.select("d", audit.redact_json(F.col("d")).alias("r")).collect()}
    assert got == cases
    verbatim = {
        '{"a":{"b":{"c":{"d":{"e":{"token":1,"rows":1.50}}}}}, "z":"\\\\"}': '{"a":{"b":{"c":{"d":{"e":{"token":"[REDACTED]","rows":1.50}}}}}, "z":"\\\\"}',
        '[{"token":"x"}, 1.0]': '[{"token":"[REDACTED]"}, 1.0]',
        '{"note":"a\\"b","password":"x"': "[REDACTED]",
        '{"password": \'x\'}': "[REDACTED]",
        '{"n": 1.50, "rows": [1, 2]}': '{"n": 1.50, "rows": [1, 2]}',
        "[" * 3000 + '{"secret":[{"a":"]"}],"b":1}' + "]" * 3000: "[" * 3000 + '{"secret":"[REDACTED]","b":1}' + "]" * 3000,
    }
    frame = spark.createDataFrame([(k,) for k in [*verbatim, None]], "d string")
    assert {r.d: r.r for r in frame.select("d", audit.redact_json(F.col("d")).alias("r")).collect()} == {**verbatim, None: None}
    flat = spark.createDataFrame([({"User_Token": "1", "b": "2"},)], "m map<string,string>")
    assert flat.select(audit.redact_map(F.col("m"))).first()[0] == {"User_Token": "[REDACTED]", "b": "2"}


def test_fix_confidence_grows(spark):
    rows = [(i, NOW + datetime.timedelta(minutes=i), "KeyError", "t", "'x'", None, None) for i in range(12)]
    schema = "failure_id long, ts timestamp_ntz, error_type string, tool string, message string, available_columns array<string>, object_type string"
    fixes = spark.createDataFrame([("KeyError", True), ("KeyError", True)], "error_type string, success boolean")
    got = failures.fix_actions(spark.createDataFrame(rows, schema), fixes).orderBy("failure_id").collect()
    assert [r.similar_count for r in got] == list(range(3, 13))
    assert got[0].confidence == 0.45 and not got[0].auto_apply
    assert got[-1].confidence == 0.95 and got[-1].auto_apply
    assert [r.confidence for r in got] == sorted(r.confidence for r in got)


def test_suggestions(spark):
    rows = [
        (1, "TypeError", "'NoneType' object", None, None), (2, "KeyError", "'x'", ["a", "b"], None), (3, "AttributeError", "no 'foo'", None, "Frame"),
        (4, "Odd", "m", None, None), (5, "ValueError", "DateTime wrong", None, None),
    ]
    frame = spark.createDataFrame(rows, "failure_id long, error_type string, message string, available_columns array<string>, object_type string")
    got = {r.failure_id: r.suggestion for r in failures.with_suggestions(frame).collect()}
    assert got[1].startswith("Encountered None") and got[4] is None and got[5].startswith("Invalid date")
    assert got[2] == "Column 'x' not found. Available columns: a, b. Check column name spelling."
    assert got[3].startswith("'foo' not found on Frame.")


def test_suggestions_name_all_columns(spark):
    columns = [f"c{i}" for i in range(12)]
    frame = spark.createDataFrame(
        [(1, "KeyError", "'x'", columns, None)],
        "failure_id long, error_type string, message string, available_columns array<string>, object_type string",
    )
    cut, whole = (failures.with_suggestions(frame, n).first().suggestion for n in (10, None))
    assert "c9" in cut and "c10" not in cut
    assert whole == f"Column 'x' not found. Available columns: {', '.join(columns)}. Check column name spelling."


def test_whole_messages_tell_failures_apart(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(n, at, "E", "t", "m" * 100 + tail) for n, tail in enumerate(["a", "b", "a"])]
    frame = spark.createDataFrame(rows, "failure_id long, ts timestamp, error_type string, tool string, message string")
    counts = lambda **chars: [r.similar_count for r in failures.similar_failures(frame, **chars).orderBy("failure_id").collect()]
    assert counts() == [3, 3, 3] and counts(message_chars=None) == [2, 1, 2]


def test_ab(spark):
    users = spark.range(200).select(F.col("id"), experiments.assigned_version(F.col("id"), "t").alias("v")).collect()
    for row in users:
        bucket = int(hashlib.md5(f"{row.id}:t".encode()).hexdigest()[:8], 16) / 2**32
        assert row.v == ("v2" if bucket < 0.5 else "v1")
    rows = [("t", "latency", "v1", 1.0)] * 19 + [("t", "latency", "v2", float(i)) for i in range(20)] + [("t", "score", "v1", 1.0), ("t", "score", "v2", 1.0), ("t", "alone", "v1", 1.0)]
    frame = spark.createDataFrame(rows, "test_name string, metric_name string, version string, metric_value double")
    results = {(r.metric_name, r.version): r.p95 for r in experiments.metric_results(frame).collect()}
    assert results["latency", "v1"] is None and results["latency", "v2"] == 19.0
    assert {r.metric_name: r.winner for r in experiments.metric_winners(frame).collect()} == {"latency": "v1", "score": "v1", "alone": None}


def test_call_stats_without_success(spark):
    frame = spark.createDataFrame([("gpt-4o", NOW, 1, 5.0, 1000, 1000, False)], "model string, ts timestamp_ntz, call_id long, latency_ms double, input_tokens long, output_tokens long, success boolean")
    row = calls.call_stats(frame).first()
    assert row.avg_latency_ms == 0.0 and row.success_rate == 0.0 and row.estimated_cost == 0.01


def test_checking_shuffles_hashes_only(spark, capsys):
    """Payloads are judged where they are read; entries without hash, predecessor or payload are found as before."""
    day = datetime.date(2024, 1, 1)
    chain = audit.build_chain(spark.createDataFrame([(day, i, json.dumps({"i": i})) for i in range(5)], "log_date date, at int, entry string"), "key", ["at"])
    rows = [r.asDict() for r in chain.collect()]
    rows[2]["payload"], rows[4]["hash"] = None, None
    stored = spark.createDataFrame([tuple(r.values()) for r in rows], chain.schema)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        checked = audit.check_entries(stored, "key")
        checked.explain("formatted")
        sorts = [part.split("Input")[1].split("]\n")[0] for part in capsys.readouterr().out.split("\n\n") if ") Sort" in part and "Input" in part]
        assert len(sorts) == 2 and not any("payload" in columns for columns in sorts)
        assert sorted(tuple(r)[1:] for r in checked.collect()) == [(0, True, True), (1, True, True), (2, False, False), (3, True, True), (4, True, False)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
