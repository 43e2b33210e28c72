"""The versioned store, streaming runs with restarts, wire codec, readers, artifacts and models."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rillflow import schemas
from rillflow.operators import artifacts, modelling
from rillflow.sources import avro_wire as A
from rillflow.sources import generator as G
from rillflow.sources import readers
from rillflow.sources.store import VersionedTable, sink
from rillflow.streaming import jobs as J

T0 = 1893499200000000
MIN = 60_000_000
DDL = "event_id string, customer_id long, event_time timestamp, event_us long, amount decimal(18,4), currency string, kafka_partition int, kafka_offset long"


def events(spark, rows):
    data = [(f"e{o}", c, T0 + int(m * MIN), Decimal(a), "USD", 0, o) for o, c, m, a in rows]
    d = spark.createDataFrame(data, "event_id string, customer_id long, event_us long, amount decimal(18,4), currency string, kafka_partition int, kafka_offset long")
    return d.withColumn("event_time", F.timestamp_micros("event_us")).select(*[n for n, _ in schemas.fields(DDL)])


def test_append_is_idempotent_and_versioned(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", "id long")
    df = lambda a, b: spark.range(a, b).select("id")
    assert t.append(df(0, 3), "app", 0) == 0
    assert t.append(df(0, 3), "app", 0) is None
    assert t.append(df(0, 0), "app", 1) is None
    assert t.commit_empty("app", 2) == 1
    with pytest.raises(RuntimeError):
        t.append(df(3, 5), "app", 3, post_commit=lambda v: (_ for _ in ()).throw(RuntimeError("after commit")))
    assert t.append(df(3, 5), "app", 3) is None
    assert [t.read(v).count() for v in (0, 1, 2)] == [3, 3, 5]
    assert [r.version for r in t.history().collect()] == [2, 1, 0]
    with pytest.raises(schemas.SchemaMismatch):
        t.append(spark.range(3).select(F.col("id").alias("x")), "app", 9)


def stream(spark, path, waves):
    for w in waves:
        w.coalesce(1).sortWithinPartitions("event_us").write.mode("append").parquet(path)
    return spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, tmp_path, plan, ddl, config, mode="append"):
    table = VersionedTable(spark, f"file://{tmp_path}/out", ddl)
    q = J.run_available(plan(spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in"), config), f"file://{tmp_path}/cp", config.name, sink(table, config.name), mode)
    return table, q


def test_activity_lifecycle(spark, tmp_path):
    config = J.StreamConfig("act", "10 minutes", "2 hours")
    step = lambda *rows: stream(spark, f"file://{tmp_path}/in", [events(spark, rows)])
    go = lambda: run(spark, tmp_path, J.activity, J.ACTIVITY, config, "update")[0].read()
    step((1, 1, 0, "10"), (2, 1, 5, "20"), (3, 2, 2, "7.5"))
    assert {(r.customer_id, r.lifecycle_type, r.state_event_count) for r in go().collect()} == {(1, "UPDATED", 2), (2, "UPDATED", 1)}
    step((4, 1, 20, "5"))
    row = go().where("customer_id = 1 and state_event_count = 3").first()
    assert row.state_amount_total == 35 and row.batch_event_count == 1
    step((5, 3, 151, "9"))
    assert go().where("lifecycle_type = 'EXPIRED'").count() == 2
    step((6, 1, 160, "3"))
    got = go()
    assert got.where("lifecycle_type = 'EXPIRED'").count() == 2
    last = got.where("customer_id = 1 and lifecycle_type = 'UPDATED'").orderBy(F.desc("_version")).first()
    assert (last.state_event_count, last.state_amount_total) == (1, 3)


def test_dedup_within_watermark_and_restart(spark, tmp_path):
    config = J.StreamConfig("dd", "10 minutes")
    ddl = "event_id string, kafka_offset long"
    plan = lambda s, c: J.deduplicated(s, c).select("event_id", "kafka_offset")
    stream(spark, f"file://{tmp_path}/in", [events(spark, [(0, 1, 0, "1"), (1, 1, 0.5, "1"), (2, 1, 1, "1")])])
    table, _ = run(spark, tmp_path, plan, ddl, config)
    assert table.read().count() == 3
    again = events(spark, [(0, 1, 0, "1"), (1, 1, 0.5, "1")]).withColumn("kafka_offset", F.col("kafka_offset") + 100)
    stream(spark, f"file://{tmp_path}/in", [again, events(spark, [(7, 1, 30, "1")])])
    table, _ = run(spark, tmp_path, plan, ddl, config)
    assert {r.kafka_offset for r in table.read().collect()} == {0, 1, 2, 7}
    stream(spark, f"file://{tmp_path}/in", [events(spark, [(8, 1, 19, "1")]), events(spark, [(9, 1, 21, "1")])])
    table, q = run(spark, tmp_path, plan, ddl, config)
    assert {r.event_id for r in table.read().collect()} == {"e0", "e1", "e2", "e7", "e9"}
    assert J.progress_table(spark, q).agg(F.sum("late_rows")).first()[0] == 1


def test_moments_expire_after_silence(spark, tmp_path):
    config = J.StreamConfig("mo", "10 minutes", "1 hours")
    waves = [events(spark, [(0, 1, 0, "100"), (1, 1, 1, "200")]), events(spark, [(2, 2, 90, "5")]), events(spark, [(3, 2, 95, "5")]), events(spark, [(4, 1, 100, "300")])]
    stream(spark, f"file://{tmp_path}/in", waves)
    table, _ = run(spark, tmp_path, J.statistics, J.MOMENTS, config)
    got = {r.event_id: (r.prior_amount_observation_count, r.statistical_feature_status) for r in table.read().collect()}
    assert got["e1"] == (1, "INSUFFICIENT_VARIANCE_HISTORY") and got["e4"] == (0, "NO_HISTORY")


def test_rolling_stream_forgets_what_no_window_needs(spark, tmp_path):
    config = J.StreamConfig("ro", "10 minutes")
    waves = [events(spark, [(0, 1, 0, "100"), (1, 1, 3, "200"), (2, 1, 7, "300")]), events(spark, [(3, 1, 10, "1")]), events(spark, [(4, 1, 60, "1")]), events(spark, [(5, 1, 61, "1")])]
    stream(spark, f"file://{tmp_path}/in", waves)
    table, q = run(spark, tmp_path, J.rolling, J.ROLLING, config)
    got = {r.event_id: (r.prior_transaction_count_5m, r.prior_amount_sum_10m) for r in table.read().collect()}
    assert got["e3"] == (1, Decimal("600.0000")) and got["e4"] == (0, Decimal("0.0000")) and got["e5"] == (1, Decimal("1.0000"))
    assert J.progress_table(spark, q).agg(F.sum("state_removed")).first()[0] > 0


def test_a_checkpoint_keeps_its_configuration(spark, tmp_path):
    J.claim(spark, f"file://{tmp_path}/c", J.StreamConfig("a"), "app")
    J.claim(spark, f"file://{tmp_path}/c", J.StreamConfig("a"), "app")
    with pytest.raises(ValueError):
        J.claim(spark, f"file://{tmp_path}/c", J.StreamConfig("a", timeout="1 hour"), "app")


def test_wire_codec(spark):
    good = G.transactions(spark, 1).first().asDict()
    frame = A.encode(good)
    assert A.decode(frame)["customer_id"] == good["customer_id"]
    assert A.decode(A.encode(good | {"amount": "12345678901234.5678"}))["amount"] == "12345678901234.5678"
    for bad, error in ((frame[:-1], "TruncatedRecord"), (frame + b"\0", "TrailingBytes"), (b"\1" + frame[1:], "BadFrame"), (frame[:4] + b"\7" + frame[5:], "UnknownSchema")):
        with pytest.raises(A.WireError, match=error):
            A.decode(bad)
    with pytest.raises(A.WireError, match="SubMicrosecond"):
        A.encode(good | {"event_time": "2030-01-01T00:00:00.0000001Z"})
    rows = [(good["customer_id"].encode(), frame), (b"other", frame), (None, frame), (b"x", None), (b"\xff", frame), (b"x", b"")]
    src = spark.createDataFrame([(k, v, "t", 0, i, None) for i, (k, v) in enumerate(rows)], readers.MESSAGES)
    got = [r.wire_error for r in A.decode_records(src).orderBy("kafka_offset").collect()]
    assert got == [None, "KeyMismatch", "NullKey", "NullValue", "MalformedKey", "BadFrame"]


def test_json_lines(spark, tmp_path):
    good = {"event_id": "e", "outcome": "FRAUD", "label_observed_at": "2030-01-01T00:00:00Z", "label_source": "s", "label_revision": 1}
    lines = [json.dumps(good), json.dumps(good | {"extra": 1}), json.dumps(good)[:-1] + ', "outcome": "LEGIT"}', "{", json.dumps(good | {"label_observed_at": "yesterday"}), json.dumps(good | {"label_source": None})]
    (tmp_path / "l.jsonl").write_text("\n".join(lines) + "\n")
    d = readers.json_lines(spark, f"file://{tmp_path}/l.jsonl", readers.LABELS)
    assert sorted(str(r.error) for r in d.collect()) == ["DUPLICATE_KEY", "FIELDS_DIFFER", "MALFORMED", "NOT_UTC", "NULL_OR_WRONG_TYPE", "None"]
    with pytest.raises(Exception):
        readers.labels(spark, f"file://{tmp_path}/l.jsonl").collect()
    (tmp_path / "ok.jsonl").write_text(lines[0] + "\n")
    assert readers.labels(spark, f"file://{tmp_path}/ok.jsonl").first().observed_us == 1893456000000000


def test_message_log_offsets(spark, tmp_path):
    d = spark.range(50).select(F.col("id").cast("string").cast("binary").alias("key"), F.lit(b"v").alias("value"), F.col("id").alias("order"))
    readers.append_log(d, f"file://{tmp_path}/log", "t", 3)
    got = spark.read.parquet(f"file://{tmp_path}/log").groupBy("partition").agg(F.min("offset").alias("a"), F.max("offset").alias("b"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == 50 and all(r.a == 0 and r.b == r.n - 1 for r in got)


def test_tsv_round_trip(spark, tmp_path):
    d = G.scenario_corpus(spark, 40, 3).select("event_number", "customer_id", "outcome")
    G.write_tsv(d, f"file://{tmp_path}/c")
    back = G.read_tsv(spark, f"file://{tmp_path}/c", "event_number long, customer_id string, outcome string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, d.collect()))
    with pytest.raises(Exception):
        G.read_tsv(spark, f"file://{tmp_path}/c", "event_number long, client string, outcome string").collect()


def test_artifacts(spark, tmp_path):
    df = spark.range(20).select("id")
    a = artifacts.publish(df, f"file://{tmp_path}/a", {"kind": "x"})
    assert artifacts.publish(df.orderBy(F.desc("id")), f"file://{tmp_path}/a", {"kind": "x"})["id"] == a["id"]
    assert artifacts.verify(spark, a)
    assert not artifacts.verify(spark, a | {"content": "0"})
    inv = artifacts.inventory(spark, f"file://{tmp_path}/a")
    assert inv.count() >= 2 and artifacts.bundle_errors(inv, inv.limit(1)).count() == inv.count() - 1


def test_model_and_registry(spark, tmp_path):
    d = spark.range(300).select(F.col("id").cast("string").alias("event_id"), F.lit("USD").alias("currency"), F.lit("US").alias("country"), F.lit("CARD_PAYMENT").alias("transaction_type"), F.lit("READY").alias("statistical_feature_status"), F.col("id").cast("double").alias("amount"), *[F.lit(0.0).alias(c) for c in modelling.NUMBERS[1:]], (F.col("id") > 200).cast("int").alias("fraud_label"))
    m = modelling.fit(d)
    s = modelling.scored(m, d, ["event_id", "fraud_label"])
    assert s.where("(p >= 0.5) = (fraud_label = 1)").count() > 270
    unseen = modelling.scored(m, d.limit(1).withColumn("currency", F.lit("CHF")), ["event_id"])
    assert 0 <= unseen.first().p <= 1
    assert tuple(modelling.reload_parity(m, f"file://{tmp_path}/m", d).first()) == (300, 0)
    r = modelling.Registry(spark, f"file://{tmp_path}/r")
    r.register("v1", "c", "d1", "s", {"ap": 0.1}, 0)
    r.register("v2", "c", "d2", "s", {"ap": 0.3}, 0)
    assert r.compare("v1", "v2").first().warnings == "DATASET_DIFFERS"
    with pytest.raises(ValueError):
        r.register("v1", "c", "d1", "s", {"ap": 0.1}, 0)


def test_stream_follows_commits_made_after_it_was_built(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", "id long")
    t.append(spark.range(3), "app", 0)
    s = t.stream()
    t.append(spark.range(3, 6), "app", 1)
    # A batch that was never committed is not seen.
    spark.range(90, 99).write.parquet(f"file://{tmp_path}/t/staging/other")
    out = VersionedTable(spark, f"file://{tmp_path}/out", "id long")
    J.run_available(s, f"file://{tmp_path}/cp", "follow", sink(out, "follow"))
    assert sorted(r.id for r in out.read().collect()) == [0, 1, 2, 3, 4, 5]
    t.append(spark.range(6, 8), "app", 2)
    J.run_available(t.stream(), f"file://{tmp_path}/cp", "follow", sink(out, "follow"))
    assert out.read().count() == 8


def test_two_writers_of_one_batch(spark, tmp_path):
    a, b = (VersionedTable(spark, f"file://{tmp_path}/t", "id long") for _ in range(2))
    a.append(spark.range(2), "app", 0)
    stale = b.log()
    assert a.append(spark.range(10, 15), "app", 1) == 1
    real = b.log
    b.log = iter([stale, stale, real()]).__next__  # a writer whose view of the log is old
    assert b.append(spark.range(20, 29), "app", 1) is None
    b.log = real
    assert sorted(r.id for r in a.read().collect()) == [0, 1, 10, 11, 12, 13, 14]
    assert [(c["folder"][-1], c["version"]) for c in a.log() if c["batch_id"] == 1] == [("1", 1)]
    assert a.table_id == b.table_id


def test_a_claim_without_a_commit_is_finished(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, f"file://{tmp_path}/t", "id long")
    monkeypatch.setattr(VersionedTable, "_finish", lambda self, name, post_commit=None: (_ for _ in ()).throw(InterruptedError()))
    with pytest.raises(InterruptedError):
        t.append(spark.range(4), "app", 0)
    monkeypatch.undo()
    assert t.read().count() == 0 and t.append(spark.range(4), "app", 0) == 0 and t.read().count() == 4


def test_waves_get_following_versions(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", "id long")
    assert [t.append_wave(spark.range(2), "w", i) for i in range(2)] == [0, 1]
    with pytest.raises(ValueError, match="next version"):
        t.append_wave(spark.range(2), "w", 1)


def test_journals_refuse_what_does_not_fit(spark, tmp_path):
    from rillflow.operators import journals as Q

    log = spark.createDataFrame([("a", 0, 0, "p"), ("b", 0, 2, "p")], "ready_event_id string, partition int, offset long, payload string")
    c = Q.ReceiptConsumer(spark, f"file://{tmp_path}/c")
    with pytest.raises(Exception, match="follow on"):
        c.poll(log, 0)
    c.poll(log.where("offset = 0"), 1)
    c.poll(log.withColumn("offset", F.col("offset") - F.expr("int(offset > 0)")), 2)
    assert {(r.partition, r.next_offset) for r in c.committed().collect()} == {(0, 2)} and c.receipts.read().count() == 2
    with pytest.raises(Exception, match="lacks a row"):
        Q.require_in(log, log.where("offset = 0"), "ready_event_id").collect()
    with pytest.raises(Exception, match="differs"):
        Q.require_payloads(log, log.withColumn("payload", F.lit("q"))).collect()
    with pytest.raises(Exception, match="sealed"):
        Q.require_seal(log, Q.seal(log.limit(1))).collect()
    assert Q.require_seal(log, Q.seal(log)).count() == 2
