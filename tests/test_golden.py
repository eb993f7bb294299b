"""Known values of single operators."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqscope.config import ABLATIONS, Config, DetectorConfig, WindowConfig, ablate, dump, load, mismatches
from seqscope.functions import columns as C
from seqscope.functions import udfs
from seqscope.operators import budget, calibration, candidates, detection, protocol, sequence, stats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tail_pvalues(spark):
    ref = spark.createDataFrame([("0-512", 1.0), ("0-512", 2.0), ("0-512", 3.0), ("1024-2048", 10.0)], "bucket string, score double")
    rows = spark.createDataFrame([(1, 100, 2.0), (2, 700, 3.0), (3, 100, 100.0), (4, 100, float("nan"))], "run_id long, end_pos long, score double")
    got = {r.run_id: (r.num, r.den) for r in calibration.tail_pvalues(rows, ref).collect()}
    assert got == {1: (3, 4), 2: (3, 5), 3: (1, 4), 4: (1, 4)}


def test_pvalues_need_a_reference(spark):
    rows = spark.createDataFrame([(1, 100, 2.0, False)], "run_id long, end_pos long, score double, mine boolean")
    for reference in ("mine", spark.createDataFrame([("0-512", float("nan"))], "bucket string, score double").where("not isnan(score)")):
        with pytest.raises(Exception, match="no finite reference"):
            calibration.tail_pvalues(rows, reference).collect()
    assert calibration.tail_pvalues(rows.limit(0), "mine").count() == 0


def test_clip(spark):
    assert one(spark, C.clipped(F.lit(0.1), 0.2)) == 0.2


def test_softmax(spark):
    logits = F.array(F.lit(0.0), F.lit(math.log(3)))
    assert one(spark, C.entropy(logits)) == pytest.approx(-(0.25 * math.log(0.25) + 0.75 * math.log(0.75)))
    assert one(spark, C.chosen_logprob(logits, F.lit(1))) == pytest.approx(math.log(0.75))
    nan = F.array(F.lit(float("nan")), F.lit(1.0))
    assert one(spark, C.entropy(nan)) == 0.0
    assert one(spark, C.chosen_logprob(nan, F.lit(1))) == -1e9


def test_score_weights(spark):
    row = spark.createDataFrame([(1.0, -2.0, 3.0, 4.0, 5.0, 6.0)], "mean_entropy double, mean_logprob double, repetition_rate double, confident_loop double, local_pos double, local_neg double")
    assert row.select(C.window_score()).first()[0] == pytest.approx(0.15 + 0.2 + 0.6 + 1.4 + 0.9 + 0.12)


def tokens(spark, ids, logprobs=None):
    return spark.createDataFrame([("r", i, t, (logprobs or [-1.0] * len(ids))[i], 1.0) for i, t in enumerate(ids)], "run_id string, pos long, token int, logprob double, entropy double")


def test_repeats(spark):
    g = sequence.repeats(sequence.ngrams(tokens(spark, [1, 2, 3, 1, 2], [-1.0, -1.0, -1.0, -0.5, -0.5]), 2, 2))
    w = sequence.window_repetition(g, 5, 5).first()
    assert (w.n_ngrams, w.n_repeats, w.confident_loop) == (4, 1, 0.5)


def test_prompt_exclusion(spark):
    g = sequence.ngrams(tokens(spark, [1, 2, 3, 4, 3, 4]), 2, 2)
    own = sequence.repeats(sequence.without_prompt(g, sequence.ngrams(tokens(spark, [1, 2]), 2, 2)))
    assert own.where("start_pos = 0").count() == 0
    assert [r.start_pos for r in sequence.faulty_ngrams(own, 0, 6).collect()] == [4]


def test_windows(spark):
    w = sequence.window_means(tokens(spark, [0] * 6), 4, 2).orderBy("window_index").collect()
    assert [(r.start_pos, r.end_pos) for r in w] == [(0, 4), (2, 6)]


def test_mcnemar(spark):
    for c, r, p in ((19, 4, 0.0025995), (14, 9, 0.40487), (9, 10, 1.0), (0, 0, 1.0)):
        assert one(spark, C.mcnemar(F.lit(c), F.lit(r))) == pytest.approx(p, rel=1e-4)
        assert udfs.exact_mcnemar(c, r) == pytest.approx(p, rel=1e-4)


def test_grid():
    assert math.log(C.thresholds()[49]) == pytest.approx(11.42926413138305, abs=1e-12)


def test_detector():
    d = detection.Detector(DetectorConfig(), math.log(2.0))
    assert d.update(1e-6)[2]
    d.rest()
    assert d.update(1e-6)[::2] == (1.0, False)
    d = detection.Detector(DetectorConfig(), math.log(2.0))
    d.update(0.99)
    d.update(1e-6)
    assert d.changepoint() == 0


def test_cusum_forms_agree(spark):
    ps = [(r, i, (((r * 31 + i * 17) % 97) + 1) / 98) for r in range(5) for i in range(40)]
    df = spark.createDataFrame(ps, "run_id long, window_index long, p_value double")
    a = {(r.run_id, r.window_index): r.logE for r in detection.cusum(df).collect()}
    for r in detection.folded(df).collect():
        assert r.logE == pytest.approx([a[r.run_id, i] for i in range(40)], abs=1e-9)
    low = detection.cusum(df, DetectorConfig(reset=False)).where("run_id = 1 and window_index = 1").first().logE
    high = detection.cusum(df).where("run_id = 1 and window_index = 1").first().logE
    assert low <= high


def test_penalty_and_mask(spark):
    got = one(spark, C.repetition_penalty(F.array(*map(F.lit, (-4.0, -2.0, 3.0, 8.0))), F.array(*map(F.lit, (1, 2, 2, 99))), 2.0))
    assert got == [-4.0, -4.0, 1.5, 8.0]
    logits, tail = F.array(*map(F.lit, (1.0, 2.0, 3.0))), F.array(F.lit(5), F.lit(1))
    assert one(spark, C.ngram_mask(logits, tail, F.array(F.lit(1), F.lit(2))))[2] == float("-inf")
    assert one(spark, C.ngram_mask(logits, tail, F.array(F.lit(4), F.lit(2)))) == [1.0, 2.0, 3.0]
    assert one(spark, C.ngram_mask(logits, tail, F.array(F.lit(0))))[0] == float("-inf")


@pytest.mark.parametrize(("text", "reference", "model"), [("so #### 42", "42", "42"), ("#### -3", "-3", "-3"), ("#### 1,234", "1234", "1234"), ("#### 1 234.50", "1234.5", "1234.5"), ("7 #### none", None, "7"), ("x1 2.50 +007", "7", "7"), ("", None, None)])
def test_gsm_answers(spark, text, reference, model):
    assert one(spark, C.reference_answer(F.lit(text))) == reference
    assert one(spark, C.model_answer(F.lit(text))) == model


@pytest.mark.parametrize(("text", "want"), [(r"\frac{14}{3}", "14/3"), (r"$\boxed{3\sqrt{13}}$", "3sqrt(13)"), (r"\text{Evelyn}", "evelyn"), (r"90^\circ", "90"), ("-0.50", "-0.5"), ("The answer is 007.", "7"), ("", None), (None, None), (r"\boxed{}", r"\boxed")])
def test_math_answers(text, want):
    assert udfs.normalize_math_text(text) == want


def test_math_extraction():
    assert udfs.math_answer_of("a \\boxed{1} b \\boxed{2{3}} c") == "2{3}"
    assert udfs.math_answer_of("therefore 5. The final answer is\n 6") == "6"
    assert udfs.math_answer_of("x\n####\n\n 9 \n8") == "9"
    assert udfs.math_answer_of("first\nlast") == "last"
    assert udfs.math_answer_of(None) is None


def test_threshold_selection(spark):
    tops = spark.createDataFrame([(i, 0.4 * i) for i in range(40)], "run_id long, top double")
    s = calibration.select_threshold(calibration.threshold_grid(tops)).first()
    assert s.feasible and s.rate <= 0.05
    none = calibration.select_threshold(calibration.threshold_grid(spark.createDataFrame([(1, 99.0)], "run_id long, top double"))).first()
    assert (none.feasible, none.rate, none.few) == (False, 1.0, True)


def test_splits(spark):
    rows = protocol.items(spark.createDataFrame([(i, f"problem  {i % 90}") for i in range(120)], "id long, text string"), "text", "id", ["id"])
    first = protocol.dedupe(rows)
    assert first.count() == 90
    assert {r.id for r in protocol.dedupe(rows, "last").collect()} == {*range(30, 120)}
    split = protocol.fixed_split(first, 30, 10)
    assert {r["role"]: r["count"] for r in split.groupBy("role").count().collect()} == {"reference": 30, "development": 10}
    assert protocol.prefix_mismatches(protocol.ranked(first, 20), protocol.ranked(first, 40), ["id"]).count() == 0
    assert protocol.overlaps(first.select("content_sha256", F.lit("a").alias("role")).union(first.limit(2).select("content_sha256", F.lit("b"))), "content_sha256").count() == 2


def test_bootstrap_and_holm(spark):
    both = spark.createDataFrame([("a", 0, 0, 1), ("b", 0, 1, 0), ("c", 0, 1, 1)], "item string, seed int, v int, m int")
    p = stats.paired(both).first()
    assert (p.corrections, p.regressions, p.p) == (1, 1, 1.0)
    c = stats.cluster_means(both, "item").withColumn("name", F.lit("x")).withColumn("__order", F.col("item"))
    ci = stats.bootstrap(c, "mean_difference", 1000).first()
    assert ci.low < 0 < ci.high
    h = stats.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double"))
    assert {r.name: round(r.holm_p, 6) for r in h.collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}


def test_budgets(spark):
    rows = spark.createDataFrame([("a", 11, 101, 0, 0), ("a", 12, 500, 1, 0), ("b", 23, 10, 1, 1)], "id string, seed long, token_events_trace long, src_ord int, line_no int")
    rows = rows.withColumn("decode_token_events_total", F.lit(None).cast("long")).withColumn("tokens_generated", F.lit(1).cast("long"))
    assert {r.id: (r.seed, r.max_decode_events) for r in budget.per_id(rows).collect()} == {"a": (11, 111), "b": (23, 11)}
    with pytest.raises(Exception, match="no positive"):
        budget.per_id(rows.withColumn("token_events_trace", F.lit(0).cast("long"))).collect()
    got = one(spark, budget.periodic(F.array(F.lit(5).cast("long"), F.lit(0).cast("long")), F.lit(300).cast("long")))
    assert [(r.trigger_at, r.rollback_tokens) for r in got] == [(100, 5), (200, 1)]


def test_candidates(spark):
    c = spark.createDataFrame([(1, 0, "x", None), (1, 1, "y", -2.0), (1, 2, "y", -2.0), (2, 0, None, None), (3, 0, "a", -1.0), (3, 1, "b", -0.5)], "item_id long, candidate long, answer string, mean_logprob double")
    assert {r.item_id: r.chosen for r in candidates.majority(c).collect()} == {1: 1, 2: 0, 3: 0}
    assert {r.item_id: r.chosen for r in candidates.best_logprob(c).collect()} == {1: 1, 2: 0, 3: 1}


def test_seed_and_hash():
    assert udfs.stable_seed("a", 1) == udfs.stable_seed("a", 1) != udfs.stable_seed("a", 2)
    assert 0 <= udfs.stable_seed(1) < 2**31
    assert udfs.canonical({"b": 1, "a": [1.5]}) == '{"a":[1.5],"b":1}'
    with pytest.raises(ValueError, match="JSON"):
        udfs.canonical(float("nan"))


def test_normalize(spark):
    got = spark.createDataFrame(pd.DataFrame({"t": ["ﬁ x y\r\n z ", None]}), "t string").select(udfs.normalize("t").alias("n")).collect()
    assert [r.n for r in got] == ["fi x y z", None]


def test_config():
    for mode in ABLATIONS:
        ablate(Config(), mode)
    assert ablate(Config(), "token_level").window == WindowConfig(size=1, stride=1)
    assert ablate(Config(), "fixed_k_backtrack").backtrack.fixed_rollback == 128
    assert load(dump(Config()), {"window": {"size": 8}}).window.size == 8
    assert mismatches(Config(), {"window": {"size": 64}, "detector": {"gammas": [0.1, 0.3, 0.5, 0.7]}}) == []
    assert mismatches(Config(), {"window": {"size": 32}}) == ["window.size"]
