"""Campaign settings and the actions from manifest to analysis."""

import pytest
from pyspark.sql import functions as F

from seqscope import campaign
from seqscope.config import Config
from seqscope.operators import protocol, sequence
from seqscope.sources import store

GOOD = {
    "schema_version": 1,
    "campaign_id": "c",
    "manifest": "m",
    "output_root": "o",
    "experimental_status": "exploratory",
    "model": {"revision": "3f1c"},
    "generation": {"max_new_tokens": 10},
    "variants": {"vanilla": {"kind": "vanilla"}, "full": {"calibration": "a", "controller_overrides": {"window": {"size": 32}}}, "random": {"kind": "matched_random", "profile": "p"}, "vote": {"kind": "sample_aggregate"}},
    "calibrations": {"a": {"calibration_mode": "global"}},
}


def test_settings_are_checked():
    assert campaign.problems(GOOD) == []
    bad = [{"schema_version": 2}, {"manifest": ""}, {"experimental_status": "x"}, {"manifest_build": 1, "manifest_derive": 1}, {"variants": {"v": {"kind": "?"}}}, {"calibrations": {"a": {"accumulation_mode": "?"}}}]
    for change in bad:
        with pytest.raises(ValueError, match="."):
            campaign.checked(GOOD | change)
    sure = GOOD | {"experimental_status": "confirmatory"}
    assert campaign.problems(sure) == ["an independent test requires exclude_manifests"]
    frozen = sure | {"confirmatory_design": "frozen_evaluation", "no_retuning_from_prior_test": True, "planned_seeds": [0, 1], "seeds": [1]}
    assert campaign.problems(frozen) == []
    assert campaign.problems(frozen | {"seeds": [2]}) == ["seeds must be planned ones"]
    assert "immutable" in campaign.problems(frozen | {"model": {"revision": "REPLACE_ME"}})[0]


def test_variants_and_calibrations():
    full = campaign.variant(GOOD, "full")
    assert full["controller"]["window"] == {"size": 32, "stride": 32, "ngram_min": 6, "ngram_max": 8, "exclude_prompt_ngrams": True}
    assert campaign.resolved_settings(GOOD, "full").window.size == 32
    assert store.unsealed(full, "variant_sha256")["kind"] == "controller"
    assert campaign.variant(GOOD, "vote")["num_samples"] == 5
    for name, change in (("nobody", {}), ("x", {"kind": "controller"}), ("x", {"kind": "matched_random"}), ("x", {"kind": "sample_aggregate", "num_samples": 1})):
        with pytest.raises(ValueError, match="."):
            campaign.variant(GOOD | {"variants": {"x": change}}, name)
    spec = campaign.calibration_spec(GOOD, "a")
    payload = store.sealed({"pools": [], "calibration_sha256": spec["calibration_sha256"]}, "calibrator_sha256")
    assert campaign.calibration_of(GOOD, "full", {"a": payload}) == payload
    other = store.sealed({"pools": [], "calibration_sha256": "0"}, "calibrator_sha256")
    for stored in ({}, {"a": other}, {"a": payload | {"pools": [1]}}):
        with pytest.raises(ValueError, match="."):
            campaign.calibration_of(GOOD, "full", stored)


def test_actions(spark):
    rows = protocol.items(spark.createDataFrame([(i, f"problem {i % 90}") for i in range(120)], "id long, text string"), "text", "id", ["id"])
    test = protocol.items(spark.createDataFrame([(i, f"other {i}") for i in range(20)], "id long, text string"), "text", "id", ["id"])
    manifest = campaign.build_manifest(rows, test, {"reference": 30, "development": 10, "test": 5})
    assert {r["role"]: r["count"] for r in manifest.groupBy("role").count().collect()} == {"reference": 30, "development": 10, "test": 5}
    with pytest.raises(ValueError, match="count test"):
        campaign.build_manifest(rows, test, {"test": 21})
    config = campaign.from_mapping(Config, {"window": {"size": 8, "stride": 4, "ngram_min": 2, "ngram_max": 3}})
    words = spark.createDataFrame([(i, " ".join(f"w{(i * k * k) % 11}" for k in range(40))) for i in range(12)], "doc_id long, text string")
    windows = campaign.collect_features(sequence.bigram_tokens(sequence.split_tokens(words)), config)
    runs = words.select(F.col("doc_id").alias("run_id"), F.lit(1).alias("correct"), F.lit(True).alias("extractable"), F.lit(False).alias("truncated"))
    pools, summary = campaign.build_calibrator(windows, runs)
    assert pools.count() == windows.count() == summary.first()["windows"]
    one = campaign.select_threshold(windows, runs, pools, config).first()
    assert (one["runs"], one["few"]) == (12, True)
    lock = campaign.freeze(GOOD, "full", {"a": 1}, manifest)
    assert store.unsealed(lock, "freeze_sha256")["calibration"] == {"a": 1}


def test_analysis_and_status(spark):
    rows = [("vanilla", "a", 0, 1), ("vanilla", "b", 0, 0), ("better", "a", 0, 1), ("better", "b", 0, 1), ("same", "a", 0, 1), ("same", "b", 0, 0)]
    schema = "variant string, item string, seed int, correct int"
    out = {r["variant"]: r for r in campaign.analyze(spark.createDataFrame(rows, schema)).collect()}
    assert (out["better"].corrections, out["better"].regressions, out["better"].p, out["same"].difference) == (1, 0, 1.0, 0.0)
    for missing in (0, 3):
        with pytest.raises(Exception, match="unpaired"):
            campaign.analyze(spark.createDataFrame([r for i, r in enumerate(rows) if i != missing], schema)).collect()
    progress = spark.createDataFrame([("test", "full", 1, 5, 10), ("test", "full", 3, 5, 12), ("dev", "full", 5, 5, 3)], "role string, variant string, completed int, target int, time int")
    assert {(r.role, r.completed) for r in campaign.status(progress).collect()} == {("test", 3), ("dev", 5)}
