"""Uploads and streams end to end."""

import json
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flowward.operators import aggregates as A
from flowward.operators import dashboards as D
from flowward.operators.aggregates import upload_summary
from flowward.operators.features import FeatureError
from flowward.operators.joins import batch_complete, complete_predictions, recent_complete
from flowward.operators.validation import DROP, InvalidRowError
from flowward.plans.pipeline import score_upload
from flowward.profiles import ATTACK_PROFILE, THREAT_CURRENT, THREAT_LEGACY, default_sources
from flowward.session import cut_lineage, shared_dir
from flowward.sources.flow_files import read_flows_csv, read_many_csv, with_offset_ids
from flowward.sources.loads import claim
from flowward.sources.manifest import commit, snapshot
from flowward.sources.messages import MESSAGE_SCHEMA, decode_messages, read_flow_stream, sender_ip, unwrap
from flowward.sources.tables import (
    append_log_csv,
    compact_tables,
    load_dashboard,
    load_tables,
    read_dim,
    vacuum_tables,
    write_dim,
    write_flows_json,
)
from flowward.streaming.live import compact_throughput, read_throughput, write_throughput
from flowward.streaming.scoring import file_message_sink, score_batch, score_external_stream, score_stream
from samples import ATTACK_HEADER, ATTACK_PORTS, ATTACK_ROWS, LEGACY_HEADER, LEGACY_ROWS, attack, legacy, write_csv
from test_rules import expected_class, expected_score


def test_threat_upload(spark, tmp_path):
    path = write_csv(tmp_path / "flows.csv", LEGACY_HEADER, LEGACY_ROWS)
    upload = score_upload(spark, path, str(tmp_path / "out"))
    assert upload.profile is THREAT_LEGACY
    tables = load_tables(spark, str(tmp_path / "out"))
    threats = tables["threat"].orderBy("id").collect()
    assert [r["id"] for r in threats] == [0, 1, 2] and threats[0]["prediction_score"] == expected_score(legacy())
    traffic = tables["traffic"].orderBy("id").collect()
    assert traffic[0]["features"] == legacy() and {r["batch_id"] for r in traffic} == {upload.batch_id}
    assert tables["attack"].count() == tables["action"].count() == 0
    score_upload(spark, path, str(tmp_path / "out"))
    ids = [r["id"] for r in load_tables(spark, str(tmp_path / "out"))["traffic"].collect()]
    assert len(ids) == len(set(ids)) == 6


def test_attack_upload(spark, tmp_path):
    path = write_csv(tmp_path / "flows.csv", ATTACK_HEADER, ATTACK_ROWS)
    upload = score_upload(spark, path, str(tmp_path / "out"))
    assert upload.profile is ATTACK_PROFILE
    rows = complete_predictions(**load_tables(spark, str(tmp_path / "out"))).orderBy("traffic.id").collect()
    codes = [r["attack"]["attack_type_encoded"] for r in rows]
    assert codes == [{22: 7, 21: 4}.get(p, 0) for p in ATTACK_PORTS]
    assert rows[0]["attack"]["attack_type_encoded"] == expected_class(attack())
    assert rows[1]["action"]["action_params"] == {"ip": "192.168.1.3"} and rows[0]["threat"] is None
    score_upload(spark, path, str(tmp_path / "out"))
    tables = load_tables(spark, str(tmp_path / "out"))
    of_batch = batch_complete(tables, upload.batch_id)
    assert sorted(r["traffic"]["id"] for r in of_batch.collect()) == list(range(8))
    assert "In(load_id" in of_batch._jdf.queryExecution().toString()
    own = load_tables(spark, str(tmp_path / "out"), upload.batch_id)
    assert 2 * len(own["attack"].inputFiles()) == len(tables["attack"].inputFiles())
    assert sorted(r["traffic"]["id"] for r in batch_complete(own, upload.batch_id).collect()) == list(range(8))
    assert tuple(upload_summary(tables, upload.batch_id).first()) == (8, 8, 0, 100.0)


def test_refused_files(spark, tmp_path):
    out = str(tmp_path / "out")
    with pytest.raises(FeatureError, match="empty"):
        score_upload(spark, write_csv(tmp_path / "empty.csv", LEGACY_HEADER, []), out)
    with pytest.raises(FeatureError, match="Only CSV"):
        read_flows_csv(spark, str(tmp_path / "flows.txt"))
    bad = [*LEGACY_ROWS, LEGACY_ROWS[0].replace("0.62", "1.5"), LEGACY_ROWS[0].replace("1730", "abc")]
    path = write_csv(tmp_path / "bad.csv", LEGACY_HEADER, bad)
    with pytest.raises(InvalidRowError, match="row 3: Feature 'same_srv_rate'"):
        score_upload(spark, path, out)
    assert load_tables(spark, out)["traffic"].count() == 0
    score_upload(spark, path, out, policy=DROP)
    assert load_tables(spark, out)["threat"].count() == 3
    reasons = {r["errors"][0] for r in spark.read.parquet(f"{out}/quarantine").collect()}
    assert "Invalid value for feature 'src_bytes': expected a number" in reasons and len(reasons) == 2


def messages(spark, rows):
    """(value, sender header, second) rows in the columns of a message source."""
    prepared = [(v, [("sender_ip", h.encode())] if h else [], s) for v, h, s in rows]
    df = spark.createDataFrame(prepared, "value string, headers array<struct<key:string,value:binary>>, s int")
    return df.select("value", "headers", F.timestamp_seconds(F.col("s")).alias("timestamp"))


def test_decoding(spark):
    rows = [(None, None, 0), ("", None, 0), (" \t", None, 0), ("not json", None, 0), ("[]", None, 0),
            ('{"a": 1, "a": 2}', None, 0), ('{"sender_ip": "1.1.1.1", "features": {"x": 5}}', "2.2.2.2", 0),
            ('{"sender_ip": "1.1.1.1", "features": 7}', None, 0)]
    decoded = decode_messages(messages(spark, rows))
    got = unwrap(decoded.withColumn("sender", sender_ip(decoded))).collect()
    assert len(got) == 5
    by_text = {r["text"]: r for r in got}
    assert by_text["not json"]["payload"] is None and by_text["[]"]["payload"] is None
    assert by_text[rows[5][0]]["payload"] == {"a": "2"}
    assert (by_text[rows[6][0]]["sender"], by_text[rows[6][0]]["payload"]) == ("2.2.2.2", {"x": "5"})
    assert (by_text[rows[7][0]]["sender"], by_text[rows[7][0]]["payload"]) == ("1.1.1.1", None)


def full(profile, row) -> dict:
    return dict(zip(profile.features, (row[c] for c in profile.columns)))


def test_stream_of_mixed_messages(spark, tmp_path):
    good = [json.dumps(legacy(count=float(i))) for i in range(4)] + [json.dumps(full(ATTACK_PROFILE, attack(destination_port=21.0)))]
    poison = ["not json", "[]", "  ", json.dumps({"k": 1}), json.dumps(legacy(diff_srv_rate=2.0)),
              json.dumps(dict.fromkeys(THREAT_CURRENT.features, 1))]
    source = str(tmp_path / "in")
    for part in (good[:3] + poison, good[3:]):
        messages(spark, [(v, None, i) for i, v in enumerate(part)]).coalesce(1).write.mode("append").parquet(source)
    stream = read_flow_stream(spark, "parquet", path=source, maxFilesPerTrigger="1")
    out = str(tmp_path / "out")
    q = score_stream(stream, out, f"{out}/cp", message_sink=file_message_sink(out), availableNow=True)
    q.awaitTermination()
    tables = load_tables(spark, out)
    scores = sorted(r["prediction_score"] for r in tables["threat"].collect())
    assert scores == sorted(expected_score(legacy(count=float(i))) for i in range(4))
    assert [r["attack_type_name"] for r in tables["attack"].collect()] == ["FTP-Patator"]
    assert [r["action_type"] for r in tables["action"].collect()] == ["block_ip"]
    ids = [r["id"] for r in tables["traffic"].collect()]
    assert len(set(ids)) == 5
    quarantine = spark.read.parquet(f"{out}/quarantine").collect()
    assert len(quarantine) == 5 and sum(r["reason"] == "not a JSON object" for r in quarantine) == 2
    sent = [json.loads(r["value"]) for r in spark.read.text(f"{out}/messages").collect()]
    assert len(sent) == 5 and {m["type"] for m in sent} == {"prediction"}
    assert sum(m["data"]["self_healing_action"] is not None for m in sent) == 1


def test_replayed_batch_stores_rows_once(spark, tmp_path):
    batch = messages(spark, [(json.dumps(legacy()), None, 1)])
    for _ in range(2):
        score_batch(batch, 3, "realtime", str(tmp_path))
    assert load_tables(spark, str(tmp_path))["threat"].count() == 1


def test_streams_with_checkpoints_of_their_own_share_a_root(spark, tmp_path):
    out = str(tmp_path / "out")
    for k in range(2):
        source = str(tmp_path / f"in{k}")
        messages(spark, [(json.dumps(legacy(count=float(10 * k + i))), None, i) for i in range(5 - 3 * k)]).write.parquet(source)
        stream = read_flow_stream(spark, "parquet", path=source)
        score_stream(stream, out, f"{out}/cp{k}", availableNow=True).awaitTermination()
    stored = load_tables(spark, out)["threat"].collect()
    assert len(stored) == 7 and len({r["id"] for r in stored}) == 7


def test_ids_follow_offsets_without_a_shuffle(spark):
    rows = [("t" if k % 2 else "s", k % 3, 100 + k, f"x{k}") for k in range(60) if k != 31]
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, text string")
    found = []
    for parts in (2, 5):
        numbered = with_offset_ids(df.repartition(parts, "text"), ["text"], 1000)
        assert "Exchange hash" not in numbered._jdf.queryExecution().toString()
        found.append(sorted(map(tuple, numbered.collect())))
    ids = [i for i, _ in found[0]]
    assert found[0] == found[1] and len(set(ids)) == 59 and ids[0] == 1000 and numbered.columns == ["id", "text"]
    order = sorted(rows)
    assert [t for _, t in found[0]] == [r[3] for r in order]
    for odd, room in ((df.withColumn("offset", F.expr("nullif(offset, 120)")), 1 << 37), (df, 100)):
        ids = [r.id for r in with_offset_ids(odd, ["text"], 7, room).collect()]
        assert sorted(ids) == list(range(7, 66))  # in the order of the content


def test_file_stream_has_offsets_over_a_restart(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    body = F.to_json(F.struct(*[F.lit(1.0).alias(c) for c in THREAT_LEGACY.features]))
    rows = spark.range(20).select(
        body.alias("value"),
        F.array().cast("array<struct<key:string,value:binary>>").alias("headers"),
        F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("timestamp"),
    )
    for part in range(2):  # a file each, the second one after the first run has ended
        rows.coalesce(1).write.mode("append").parquet(source)
        stream = read_flow_stream(spark, "parquet", path=source, maxFilesPerTrigger="1")
        score_stream(stream, root, f"{root}/checkpoint", availableNow=True).awaitTermination()
        stored = load_tables(spark, root)["threat"].orderBy("id").collect()
        assert len(stored) == len({r.id for r in stored}) == 20 * (part + 1)
    seconds = [int(r.created_at.timestamp()) - 1_700_000_000 for r in stored]
    assert seconds == [*range(20), *range(20)]


def test_replays_give_the_same_ids_however_partitioned(spark, tmp_path):
    rows = messages(spark, [(json.dumps(legacy(count=float(i % 9))), None, i % 4) for i in range(60)])
    found = []
    for parts in (1, 4, 7):
        score_batch(rows.repartition(parts, "value"), 0, "realtime", str(tmp_path))
        table = load_tables(spark, str(tmp_path))["traffic"].collect()
        found.append(sorted((r["id"], r["features"]["count"], r["created_at"]) for r in table))
    assert found[0] == found[1] == found[2] and len(found[0]) == 60


def test_loads_are_claimed_once_and_hidden_while_open(spark, tmp_path):
    root = str(tmp_path / "out")
    numbers = [claim(spark, root, f"load/{k % 7}") for k in range(21)]
    assert numbers == list(range(7)) * 3
    path = write_csv(tmp_path / "flows.csv", LEGACY_HEADER, LEGACY_ROWS)
    upload = score_upload(spark, path, root, batch_id="a")
    assert upload.scored.count() == 3 and load_tables(spark, root)["threat"].count() == 3
    # a folder that was written and not committed is no part of the store
    (tmp_path / "out/data/unfinished").mkdir()
    load_tables(spark, root)["threat"].write.parquet(f"{root}/data/unfinished/threat_predictions")
    assert load_tables(spark, root)["threat"].count() == 3


def test_names_that_begin_alike_are_loads_of_their_own(spark, tmp_path):
    root = str(tmp_path / "out")
    for batch, n in (("a", 1), ("a-b", 2), ("realtime", 3)):
        path = write_csv(tmp_path / f"{batch}.csv", LEGACY_HEADER, LEGACY_ROWS[:n])
        assert score_upload(spark, path, root, batch_id=batch).scored.count() == n
    again = score_upload(spark, write_csv(tmp_path / "more.csv", LEGACY_HEADER, LEGACY_ROWS[:2]), root, batch_id="a")
    assert again.scored.count() == 2
    tables = load_tables(spark, root)
    assert [batch_complete(tables, b).count() for b in ("a", "a-b", "realtime")] == [2, 2, 3]


def test_compaction_in_place_beside_readers_and_loads(spark, tmp_path):
    root = str(tmp_path / "out")

    def load(batch, header=LEGACY_HEADER, rows=LEGACY_ROWS):
        return score_upload(spark, write_csv(tmp_path / f"{batch}.csv", header, rows), root, batch_id=batch)

    load("a"), load("b", ATTACK_HEADER, ATTACK_ROWS), load("c")
    before = load_tables(spark, root)
    ids = sorted(r["id"] for r in before["traffic"].collect())
    compact_tables(spark, root)
    assert len(snapshot(spark, root).folders) == 1
    load("c", rows=LEGACY_ROWS[:1])  # its rows in the compacted folder do not count any more
    assert sorted(r["id"] for r in before["traffic"].collect()) == ids
    after = load_tables(spark, root)
    assert after["traffic"].count() == len(ids) - len(LEGACY_ROWS) + 1
    assert after["action"].count() == len(ATTACK_ROWS)
    compact_tables(spark, root)
    assert sorted(r["id"] for r in load_tables(spark, root)["traffic"].collect()) == sorted(r["id"] for r in after["traffic"].collect())
    assert vacuum_tables(spark, root, keep=1) == 5
    assert load_tables(spark, root)["threat"].count() == len(LEGACY_ROWS) + 1


def test_commits_that_meet_all_count(spark, tmp_path):
    root = str(tmp_path / "out")
    with ThreadPoolExecutor(4) as pool:
        done = [pool.submit(commit, spark, root, lambda _, k=k: {"add": {f"f{k}": ([f"l{k}"], ["t"], [])}, "drop": []}) for k in range(70)]
        versions = sorted(d.result().version for d in done)
    assert versions == list(range(1, 71))  # two of them hold the whole state
    assert len(snapshot(spark, root).folders) == 70 and len(snapshot(spark, root, 40).folders) == 40


def test_dashboards_merge_what_the_tables_hold(spark, tmp_path):
    root = str(tmp_path / "out")
    for k, batch in enumerate("aabc"):  # the first one twice
        rows, header = (ATTACK_ROWS, ATTACK_HEADER) if batch == "b" else (LEGACY_ROWS, LEGACY_HEADER)
        at = datetime(2024, 3, 4 + k, 5 + k, 30)
        score_upload(spark, write_csv(tmp_path / f"{batch}.csv", header, rows), root, batch_id=batch, created_at=at)

    def same(one, two):
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))

    for turn in range(2):
        tables, parts = load_tables(spark, root), load_dashboard(spark, root)
        cells = parts["cells"]
        same(D.merged_threat_stats(cells), A.threat_stats(tables["threat"]))
        same(D.merged_distribution(cells, "attack"), A.attack_distribution(tables["attack"]))
        same(D.merged_distribution(cells, "action"), A.action_distribution(tables["action"]))
        same(D.merged_batches(cells), A.list_batches(tables["traffic"]))
        same(D.merged_heatmap(cells), A.attack_heatmap(tables["threat"]))
        for batch in "abcx":
            same(D.merged_summary(cells, batch), A.upload_summary(tables, batch))
        for n in (1, 4, 20):
            same(D.merged_recent(parts["newest"], tables, n), recent_complete(tables, n))
        if turn == 0:
            compact_tables(spark, root)
    assert load_dashboard(spark, str(tmp_path / "none"))["cells"].count() == 0


def test_compacted_tables_read_the_same(spark, tmp_path):
    root, into = str(tmp_path / "out"), str(tmp_path / "compact")
    for batch in "ab":
        score_upload(spark, write_csv(tmp_path / f"{batch}.csv", ATTACK_HEADER, ATTACK_ROWS), root, batch_id=batch)
    compact_tables(spark, root, into)
    before, after = load_tables(spark, root), load_tables(spark, into)
    for name, table in before.items():
        columns = [c for c, kind in table.dtypes if not kind.startswith("map")]
        assert sorted(map(tuple, after[name].select(columns).collect())) == sorted(map(tuple, table.select(columns).collect()))
    assert batch_complete(after, "a").count() == len(ATTACK_ROWS)


def test_files_with_ids_and_other_headers(spark, tmp_path):
    rows = [f"{row},x{k}" for k, row in enumerate(LEGACY_ROWS)]
    path = write_csv(tmp_path / "ids.csv", LEGACY_HEADER + ",id", rows)
    root = str(tmp_path / "out")
    for _ in range(2):
        score_upload(spark, path, root)
    assert load_tables(spark, root)["traffic"].dtypes[0] == ("id", "bigint")
    assert load_tables(spark, root)["traffic"].count() == 6
    other = write_csv(tmp_path / "other.csv", LEGACY_HEADER, LEGACY_ROWS)
    both = read_many_csv(spark, [path, other])
    assert both.count() == 6 and both.where("id is null").count() == 3


def test_nothing_stays_in_the_scratch_folder(spark, tmp_path):
    before = {p.name for p in Path(shared_dir(spark)).iterdir()} if Path(shared_dir(spark)).exists() else set()
    path = write_csv(tmp_path / "flows.csv", LEGACY_HEADER, LEGACY_ROWS)
    score_upload(spark, path, str(tmp_path / "out"))
    score_batch(messages(spark, [(json.dumps(legacy()), None, 1)]), 0, "realtime", str(tmp_path / "out"))
    assert {p.name for p in Path(shared_dir(spark)).iterdir()} == before


def test_late_rows_count_in_their_window(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    for second in (500, 20, 500, 0):  # the later files hold the earlier rows
        spark.createDataFrame([(second, second % 3 == 2)], "s int, is_attack boolean").select(
            F.timestamp_seconds("s").alias("created_at"), "is_attack"
        ).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("created_at timestamp, is_attack boolean").option("maxFilesPerTrigger", 1).parquet(source)
    write_throughput(stream, root, f"{root}/cp", availableNow=True).awaitTermination()
    rows = {r["window_start"].second + 60 * r["window_start"].minute: r["total"] for r in read_throughput(spark, root).collect()}
    assert rows == {0: 1, 20: 1, 500: 2}
    compact_throughput(spark, root, f"{root}/compact")
    assert read_throughput(spark, f"{root}/compact").count() == 3


def test_external_stream_gates(spark, tmp_path):
    body = {"features": legacy()}
    rows = [(json.dumps(body | {"sender_ip": "9.9.9.9"}), "10.0.0.1", 1), (json.dumps(body | {"sender_ip": "10.0.0.1"}), None, 2),
            (json.dumps(body | {"sender_ip": "10.0.0.2"}), None, 3), (json.dumps(body), None, 4)]
    source, out, dims = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "dims")
    write_dim(spark.createDataFrame([("10.0.0.1", True), ("10.0.0.2", False)], "ip_address string, is_active boolean"), dims, "ip_whitelist")
    write_dim(default_sources(spark), dims, "data_source_config")

    def run():
        messages(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = read_flow_stream(spark, "parquet", path=source)
        score_external_stream(stream, dims, out, f"{out}/cp", availableNow=True).awaitTermination()
        return load_tables(spark, out)["threat"]

    assert run().count() == 0
    write_dim(default_sources(spark).withColumn("is_enabled", F.lit(True)), dims, "data_source_config")
    got = run()
    assert got.count() == 2 and {r["source"] for r in got.collect()} == {"external_kafka"}
    assert read_dim(spark, dims, "data_source_config", 1).where("is_enabled").count() == 1


def test_json_and_csv_outputs(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, 0.5)], "id int, x double")
    write_flows_json(df, "text", path=str(tmp_path / "json"))
    lines = {r[0] for r in spark.read.text(str(tmp_path / "json")).collect()}
    assert lines == {'{"id":1,"x":null}', '{"id":2,"x":0.5}'}
    for _ in range(2):
        append_log_csv(df, str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log"), header=True).count() == 4


def test_cut_lineage_reads_a_written_table(spark):
    cut = cut_lineage(spark.range(10).withColumn("r", F.rand()))
    assert cut.collect() == cut.collect()
    assert shared_dir(spark) in cut.inputFiles()[0]


def test_message_schema_is_that_of_the_source(spark):
    assert messages(spark, [("{}", None, 0)]).dtypes == spark.createDataFrame([], MESSAGE_SCHEMA).dtypes
