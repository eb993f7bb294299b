"""Sources, store and streaming: streams equal batches, resumed runs equal whole ones, rollbacks keep their rules."""

import json

import pytest
from pyspark.sql import functions as F

from seqscope.config import BacktrackConfig, Config, DetectorConfig, ScoreConfig, WindowConfig
from seqscope.plans import protocols
from seqscope.sources import jsonl, store
from seqscope.streaming import monitor

SCORE = ScoreConfig(0.0, 0.0, 1.0, 0.0, 0.0, 0.0)
SMALL = Config(window=WindowConfig(size=8, stride=4, ngram_min=2, ngram_max=3), score=SCORE, detector=DetectorConfig(threshold=20.0, refractory=2), backtrack=BacktrackConfig(max_rerolls=2))
POOLS = {"0-512": [0.01 * i for i in range(40)]}


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id < 5")
    tokens = protocols.positioned(protocols.stream_tokens(events)).drop("event_id")
    for i, low in enumerate((0, 20, 45)):
        tokens.where((F.col("pos") >= low) & (F.col("pos") < (20, 45, 10_000)[i])).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    files = spark.readStream.schema(tokens.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    out = monitor.monitor_stream(files, protocols.STREAM, protocols.POOLS)
    q = out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    want = sorted(map(tuple, monitor.monitor_batch(tokens, protocols.STREAM, protocols.POOLS).collect()), key=str)
    assert want
    assert [(r[0], r[1], round(r[5], 9), r[6]) for r in got] == [(r[0], r[1], round(r[5], 9), r[6]) for r in want]


def run_of(config, schedule=None, backtrack=True, length=200):
    m = monitor.Monitor(config, monitor.Calibrator(POOLS), schedule=schedule)
    events, reason = monitor.generate_run("r", monitor.looping_source(length=length), m, 400, backtrack)
    return m, events, reason


def test_rollback_rules():
    m, events, reason = run_of(SMALL)
    backs = [e for e in events if e["type"] == "backtrack"]
    assert reason == "eos"
    assert 1 <= len(backs) <= 2
    assert m.sampled - m.deleted == len(m.tokens)
    after = events[events.index(backs[0]) + 1 :]
    assert [e["refractory"] for e in after if e["type"] == "window"][:2] == [True, True]
    assert all(w["end_pos"] <= len(m.tokens) for w in m.windows)


def test_no_alarm_identity():
    calm = Config(window=SMALL.window, score=SCORE, detector=DetectorConfig(threshold=float("inf")))
    assert run_of(calm)[0].tokens == run_of(SMALL, backtrack=False)[0].tokens


def test_exhausted_rerolls():
    none = Config(window=SMALL.window, score=SCORE, detector=SMALL.detector, backtrack=BacktrackConfig(max_rerolls=0))
    m, events, _ = run_of(none)
    assert m.deleted == 0
    assert any(e["type"] == "refused" for e in events)


def test_forced_schedule():
    m, events, _ = run_of(SMALL, schedule=[(16, 4)])
    alarms = [e for e in events if e["type"] == "alarm"]
    assert [(a["token_pos"], a["rollback_pos"]) for a in alarms] == [(16, 12)]
    assert not any(e["type"] == "alarm" for e in run_of(SMALL, schedule=[])[1])


def test_resume_equals_whole(spark, tmp_path):
    items = spark.range(5).select(F.col("id").cast("string").alias("item_id"), "id")
    work = lambda df: df.select("item_id", (F.col("id") * 2).alias("value"))
    whole = store.Store(spark, str(tmp_path / "a"), {"seed": 1, "parallel_workers": 3}, "item_id string, value long")
    assert whole.resume(items, work) == 5
    parts = store.Store(spark, str(tmp_path / "b"), {"seed": 1, "parallel_workers": 8}, "item_id string, value long")
    assert parts.resume(items, work, limit=2) == 5
    assert parts.resume(items, work) == 3
    assert parts.resume(items, work) == 0
    assert [tuple(r) for r in parts.in_order(items, "id").collect()] == [tuple(r) for r in whole.in_order(items, "id").collect()]
    with pytest.raises(ValueError, match="another run"):
        store.Store(spark, str(tmp_path / "b"), {"seed": 2}, "item_id string, value long").read()


def test_sources(spark, tmp_path):
    path = tmp_path / "prompts.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in ({"id": "a", "question": "q"}, {"id": "b", "prompt": "", "input": "i"}, {"id": "c"})) + "\n\n")
    assert [tuple(r)[:2] for r in jsonl.prompts(spark, str(path)).orderBy("id").collect()] == [("a", "q"), ("b", "i")]
    trace = tmp_path / "trace.jsonl"
    trace.write_text('{"run_id":"r","type":"token"}\n{"run_id":"r","type":"token"\n{"run_id":"r","type":"token"}\n')
    runs = spark.createDataFrame([("r", 9), ("s", 7)], "run_id string, tokens_generated long")
    assert {r.run_id: r.token_events for r in jsonl.token_events(spark, str(trace), runs).collect()} == {"r": 2, "s": 7}
    logits = tmp_path / "logits.jsonl"
    logits.write_text('{"run_id":"r","tokens":[{"token_id":1,"logits":[0.0,1.0]}]}\n')
    assert jsonl.traces(spark, str(logits)).first().logits == [0.0, 1.0]
    with pytest.raises(ValueError, match="immutable"):
        jsonl.revision_of("REPLACE_ME")


def test_freeze(tmp_path):
    lock = store.freeze({"a": 1}, {"h": 2.0}, "m")
    store.assert_frozen(lock, {"a": 1}, {"h": 2.0}, "m")
    with pytest.raises(ValueError, match="config"):
        store.assert_frozen(lock, {"a": 2}, {"h": 2.0}, "m")
    with pytest.raises(ValueError, match="freeze_sha256"):
        store.assert_frozen(lock | {"manifest_sha256": "n"}, {"a": 1}, {"h": 2.0}, "n")
    store.write_json(str(tmp_path / "x.json"), lock)
    assert json.loads((tmp_path / "x.json").read_text()) == lock


def test_injection_and_schedule():
    m = monitor.Monitor(SMALL, monitor.Calibrator(POOLS), inject=(7, 8))
    events, _ = monitor.generate_run("r", monitor.looping_source(length=120), m, 300)
    assert any(e["type"] == "backtrack" for e in events)
    assert m.prompt[-2:] == (7, 8)
    tokens, done, sampled = monitor.scheduled_run("r", monitor.looping_source(length=60), [(20, 5), (30, 0)], 200)
    assert done == [(15, 5), (29, 1)]
    assert sampled - 6 == len(tokens) == 60
