"""Campaigns: settings with variants and calibrations, and the actions of an experiment from manifest to analysis.

An action takes and gives DataFrames and small mappings, so a script or a notebook composes them; files are
written by the sinks of sources. Generation itself is a token source's (streaming.monitor).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import BUCKETS, GLOBAL_BUCKET, Config, from_mapping, merged
from .functions import udfs
from .operators import calibration, protocol, sequence, stats
from .sources import jsonl, store

#: What a campaign's settings may say.
SCHEMA_VERSION = 1
KINDS = ("controller", "vanilla", "matched_random", "sample_aggregate")
NEEDED = ("campaign_id", "manifest", "output_root", "model", "generation", "variants")
STATUSES, DESIGNS = ("confirmatory", "exploratory"), ("independent_test", "frozen_evaluation")
MODES, ACCUMULATIONS = ("positional", "global"), ("cusum_reset", "no_reset")


def problems(campaign: Mapping[str, Any]) -> list[str]:
    """What is wrong with a campaign's settings; none for valid ones."""
    out = [f"campaign requires {key}" for key in NEEDED if not campaign.get(key)]
    if campaign.get("schema_version") != SCHEMA_VERSION:
        out.append(f"schema_version must be {SCHEMA_VERSION}")
    status, design = campaign.get("experimental_status"), campaign.get("confirmatory_design", DESIGNS[0])
    if status not in STATUSES:
        out.append("unknown experimental_status")
    if campaign.get("manifest_build") and campaign.get("manifest_derive"):
        out.append("manifest_build and manifest_derive exclude each other")
    if status == "confirmatory":
        if design not in DESIGNS:
            out.append("unknown confirmatory_design")
        if design == "independent_test" and not campaign.get("exclude_manifests"):
            out.append("an independent test requires exclude_manifests")
        if design == "frozen_evaluation":
            planned = set(map(int, campaign.get("planned_seeds", ())))
            if not campaign.get("no_retuning_from_prior_test") is True:
                out.append("a frozen evaluation requires no_retuning_from_prior_test")
            if not planned or not set(map(int, campaign.get("seeds", (0,)))) <= planned:
                out.append("seeds must be planned ones")
        try:
            jsonl.revision_of(str((campaign.get("model") or {}).get("revision") or ""))
        except ValueError as error:
            out.append(str(error))
    for name, variant in (campaign.get("variants") or {}).items():
        if variant.get("kind", KINDS[0]) not in KINDS:
            out.append(f"unknown kind of variant {name}")
    for name, spec in (campaign.get("calibrations") or {}).items():
        if spec.get("calibration_mode", MODES[0]) not in MODES or spec.get("accumulation_mode", ACCUMULATIONS[0]) not in ACCUMULATIONS:
            out.append(f"unknown mode of calibration {name}")
    return out


def checked(campaign: Mapping[str, Any]) -> Mapping[str, Any]:
    """The settings, if nothing is wrong with them."""
    if found := problems(campaign):
        raise ValueError("; ".join(found))
    return campaign


def _controller(campaign: Mapping[str, Any], overrides: Mapping[str, Any]) -> dict[str, Any]:
    return merged(asdict(from_mapping(Config, campaign.get("controller", {}))), overrides)


def calibration_spec(campaign: Mapping[str, Any], name: str) -> dict[str, Any]:
    """A calibration's settings with defaults, its controller and their hash."""
    if name not in campaign.get("calibrations", {}):
        raise ValueError(f"unknown calibration {name}")
    spec = {"controller_overrides": {}, "feature_source": name, "calibration_mode": MODES[0], "accumulation_mode": ACCUMULATIONS[0]} | dict(campaign["calibrations"][name])
    return store.sealed(spec | {"controller": _controller(campaign, spec["controller_overrides"])}, "calibration_sha256")


def variant(campaign: Mapping[str, Any], name: str) -> dict[str, Any]:
    """A variant's settings with defaults, its controller and their hash."""
    if name not in campaign["variants"]:
        raise ValueError(f"unknown variant {name}")
    own = {"name": name, "kind": KINDS[0], "controller_overrides": {}, "accumulation_mode": ACCUMULATIONS[0], "repair_group": None} | dict(campaign["variants"][name])
    needs = {"controller": "calibration", "matched_random": "profile"}.get(own["kind"])
    if needs and not own.get(needs):
        raise ValueError(f"variant {name} requires a {needs}")
    if own["kind"] == "sample_aggregate":
        own = {"num_samples": 5, "selection": "majority_answer"} | own
        if int(own["num_samples"]) < 2:
            raise ValueError(f"variant {name} requires two samples at least")
    return store.sealed(own | {"controller": _controller(campaign, own["controller_overrides"])}, "variant_sha256")


def resolved_settings(campaign: Mapping[str, Any], name: str) -> Config:
    """A variant's settings as a Config."""
    return from_mapping(Config, variant(campaign, name)["controller"])


def calibration_of(campaign: Mapping[str, Any], name: str, calibrations: Mapping[str, Mapping[str, Any]]) -> Mapping[str, Any]:
    """The stored calibration that a variant names, which must be whole and of the same settings."""
    key = variant(campaign, name).get("calibration")
    if key not in calibrations:
        raise ValueError(f"no calibration {key} is stored")
    stored = store.unsealed(calibrations[key], "calibrator_sha256")
    if stored.get("calibration_sha256") != calibration_spec(campaign, key)["calibration_sha256"]:
        raise ValueError(f"calibration {key} is of other settings")
    return stored


# Actions


def build_manifest(train: DataFrame, test: DataFrame, counts: Mapping[str, int], columns: Sequence[str] = ("item_id", "content_sha256", "item_seed")) -> DataFrame:
    """Items of all roles: reference and development from train, the rest from test, without a content twice; broken rules are an error."""
    sources = {role: protocol.dedupe(test if role == "test" else train) for role in counts}
    out = protocol.role_split(sources, dict(counts)).select(*columns, "role")
    wrong = [r["rule"] for r in protocol.violations(out, dict(counts), list(columns)).where("n > 0").collect()]  # a row a rule
    if wrong:
        raise ValueError(f"broken manifest: {', '.join(wrong)}")
    return out


def collect_features(tokens: DataFrame, config: Config, prompt: DataFrame | None = None) -> DataFrame:
    """Scored windows of recorded runs, which calibrations and other weights reuse without their tokens."""
    return sequence.scored_windows(tokens, config.window, config.score, prompt)


def build_calibrator(windows: DataFrame, runs: DataFrame, mode: str = "positional") -> tuple[DataFrame, DataFrame]:
    """(pools, summary) of the healthy runs' windows."""
    own = windows.join(calibration.healthy(runs).select("run_id"), "run_id", "left_semi")
    buckets = BUCKETS if mode == "positional" else GLOBAL_BUCKET
    return calibration.pools(own, buckets), calibration.reference_summary(own, buckets)


def select_threshold(windows: DataFrame, runs: DataFrame, pools: DataFrame, config: Config, mode: str = "positional") -> DataFrame:
    """One row: the threshold whose rate of alarms on healthy development runs isn't above the target."""
    own = windows.join(calibration.healthy(runs).select("run_id"), "run_id", "left_semi")
    ps = calibration.tail_pvalues(own, pools, BUCKETS if mode == "positional" else GLOBAL_BUCKET, config.detector.p_clip)
    return calibration.select_threshold(calibration.threshold_grid(calibration.largest_statistic(ps, config.detector)), config.detector.target_rate)


def freeze(campaign: Mapping[str, Any], name: str, calibration_payload: Mapping[str, Any], manifest: DataFrame) -> dict[str, Any]:
    """What a test run of a variant must be run with."""
    digest = protocol.ids_digests(manifest, "item_id").first()["ids_sha256"]
    return store.freeze(variant(campaign, name), calibration_payload, digest)


def analyze(results: DataFrame, baseline: str = "vanilla") -> DataFrame:
    """(variant, items, corrections, regressions, p, holm_p) of each variant against the baseline, by item and seed.

    results has item, seed, variant and correct (0 or 1); units of one side only are an error.
    """
    base = results.where(F.col("variant") == baseline).select("item", "seed", F.col("correct").cast("int").alias("v"))
    others = results.where(F.col("variant") != baseline).select("variant", "item", "seed", F.col("correct").cast("int").alias("m"))
    both = others.join(base, ["item", "seed"], "left")
    sound = F.when(F.col("v").isNull(), F.raise_error(F.concat(F.lit("unpaired item "), F.col("item").cast("string"))).cast("boolean")).otherwise(F.lit(True))
    out = stats.paired(both.where(sound), ["variant"]).crossJoin(base.agg(F.count("*").alias("__n")))  # one row
    whole = F.when(F.col("paired_units") != F.col("__n"), F.raise_error(F.concat(F.lit("unpaired items of "), F.col("variant"))).cast("boolean")).otherwise(F.lit(True))
    return stats.holm(out.where(whole).drop("__n").withColumnRenamed("variant", "name")).withColumnRenamed("name", "variant")


def status(progress: DataFrame) -> DataFrame:
    """(role, variant, completed, target, time): the latest progress of each role and variant."""
    return stats.latest(progress, ["role", "variant"], ["time", "completed"], ["completed", "target", "time"])


def digest(campaign: Mapping[str, Any]) -> str:
    return udfs.canonical_sha({k: v for k, v in campaign.items() if not k.startswith("_")})
