"""What only shows in large tables, on small ones."""

import contextlib
import math
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seqscope.config import DetectorConfig
from seqscope.plans import QUERIES, sequences


def test_small_pvalues_of_many_events_are_not_clipped(spark, sf_dir, monkeypatch):
    """The SQL has no clip; the rank of the largest of over a million events is below the detector's."""
    p = 1e-7
    monkeypatch.setattr(sequences, "event_pvalues", lambda spark, sf_dir: spark.range(1).select(F.col("id").alias("event_id"), F.col("id").alias("user_id"), F.lit(p).alias("p")))
    e = sum(g * p ** (g - 1) for g in DetectorConfig.gammas) / 4
    first = lambda name: QUERIES[name](spark, sf_dir).first()
    assert first("t05_betting_mixture").e == pytest.approx(e)
    assert first("t07_log_mixture").log_e == pytest.approx(math.log(e))
    assert first("d02_no_reset").loge == pytest.approx(math.log(e), abs=1e-5)
    assert first("d04_refractory_replay").loge == pytest.approx(math.log(e), abs=1e-5)


def test_generated_runs_are_dealt_to_all_cores(spark, sf_dir):
    """A table of ids is one split of a file, however many runs it stands for."""
    assert QUERIES["g01_generation_accounts"](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


ODD = [None, "", " \t\n", "<s> <s> <s>", "one", "\x0b a b é \x0b", "  lead and trail \r\f", "x" * 5000 + " y " + "x" * 5000, "eightchr ninechars sevench " * 40, " ".join(f"w{i % 9} v{i % 11}" for i in range(700)), " ".join("ab"[i % 2] for i in range(64)), "a b c d e f g h " * 8, "ä ö ü 漢字 😀 " * 50]


@pytest.mark.parametrize("chunk", [500_000, 100])
def test_runs_of_texts_equal_those_of_tokens(spark, chunk, monkeypatch):
    """Windows and repeated n-grams on arrays of a block against those of token rows."""
    from seqscope.operators import runs, sequence

    monkeypatch.setattr(runs, "CHUNK", chunk)
    monkeypatch.setattr(runs, "SMALL_BLOCK", 4000)
    texts = ODD + [" ".join(str((i * j) % 37) for j in range(i * 7)) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    model, tokens = runs.Model(docs), sequence.bigram_tokens(sequence.split_tokens(docs, prev=True)).cache()
    assert model.n > 1
    got = {(r.run_id, r.window_index): r for r in model.windows().collect()}
    want = {(r.run_id, r.window_index): r for r in sequence.window_features(tokens).collect()}
    assert len(want) > 50
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert got[k].asDict() == pytest.approx(r.asDict(), rel=1e-9, abs=1e-11)
    grams = sequence.repeats(sequence.ngrams(tokens)).where("repeated")
    rows = lambda df: {(r.run_id, r.n, r.start_pos, r.end_pos): r.delta for r in df.collect()}
    want = rows(grams)
    assert len(want) > 1000
    assert rows(model.repeated()) == pytest.approx(want, rel=1e-9, abs=1e-11)
    some = spark.createDataFrame([(8,), (11,), (8,)], "run_id long")
    assert rows(model.repeated(some)) == pytest.approx({k: v for k, v in want.items() if k[0] in (8, 11)}, rel=1e-9, abs=1e-11)
    empty = runs.Model(docs.where("doc_id < 3"))
    assert empty.windows().count() == empty.repeated().count() == runs.Model(docs.limit(0)).windows().count() == 0


@pytest.mark.parametrize("name", "w12_window_features w06_confident_loop w15_rescore_ablation d07_direct_threshold c16_score_quantiles".split())
def test_windows_need_no_rows_of_tokens(spark, sf_dir, name):
    """Token rows in a shuffle or a sort are many times the texts' size."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert "posexplode" not in plan


def test_faulty_ngrams_of_alarms_need_no_rows_of_tokens(spark, sf_dir):
    plan = QUERIES["w07_faulty_of_alarms"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan


def test_feature_lines_are_written_compressed(spark, sf_dir, tmp_path, monkeypatch):
    """Plain lines are many times the windows' size."""
    import gzip

    from seqscope.plans import stores

    monkeypatch.setattr(stores, "new_folder", lambda spark: str(tmp_path / "sink"))
    n = QUERIES["k02_feature_sink"](spark, sf_dir).count()
    files = list((tmp_path / "sink").glob("part-*"))
    assert all(f.name.endswith(".json.gz") for f in files)
    assert n == sum(len(gzip.decompress(f.read_bytes()).splitlines()) for f in files) > 0


def shuffled(spark, df):
    """Bytes that the stages of a run of df write for later ones."""
    context = spark.sparkContext

    def stages():
        listed = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(spark._jvm.double, 0), None)
        return {s.stageId(): s.shuffleWriteBytes() for s in map(listed.apply, range(listed.size()))}

    last = max(stages(), default=-1)
    df.write.format("noop").mode("overwrite").save()
    return sum(n for i, n in stages().items() if i > last)


@pytest.mark.parametrize("name", "w12_window_features d07_direct_threshold w15_rescore_ablation w06_confident_loop".split())
def test_windows_shuffle_no_more_than_texts_and_packed_pairs(spark, sf_dir, name):
    """Hashes of pairs as they are would be more than the texts."""
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    assert 0 < shuffled(spark, QUERIES[name](spark, sf_dir)) < 1.2 * text


def left_on_disk(spark):
    """Bytes of each file of an exchange that a local folder has."""
    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    found = {}
    for f in (f for d in folders for f in Path(d).glob("*/shuffle_*.data")):
        with contextlib.suppress(FileNotFoundError):  # it was removed meanwhile
            found[f] = f.stat().st_size
    return found


def grown(spark, before, most):
    """Bytes of files that weren't there before; those that are being removed get some time for it."""
    for _ in range(50):
        n = sum(size for f, size in left_on_disk(spark).items() if f not in before)
        if n <= most:
            break
        time.sleep(0.1)
    return n


def test_words_exchange_is_gone_before_pairs(spark, sf_dir):
    """Words are numbered in a run of its own, whose exchanges don't lie beside those of texts and pairs."""
    from seqscope.operators import runs

    spark.sparkContext._jvm.System.gc()
    before = left_on_disk(spark)
    model = runs.Model(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert grown(spark, before, 1000) <= 1000  # the size of the texts is an exchange of its own
    windows = model.windows()
    assert windows.count() > 0
    asked = windows._jdf.queryExecution().executedPlan().toString()
    assert asked.count("FlatMapGroupsInArrow") == 1  # answers; the words' two steps are not run again
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.mark.parametrize("name", "flagship c05_positional_pvalue c13_threshold_grid d01_cusum d03_first_alert d05_changepoint d09_rollback_positions".split())
def test_texts_are_gone_before_windows_are_ranked(spark, sf_dir, name):
    """Exchanges of texts and pairs don't lie on disk beside those of the windows."""
    import __spark_entry__

    size = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    spark.sparkContext._jvm.System.gc()
    before = left_on_disk(spark)
    df = __spark_entry__.queries()[name](spark, sf_dir)
    assert grown(spark, before, size / 20) <= size / 20
    assert "FlatMapCoGroupsInArrow" not in df._jdf.queryExecution().executedPlan().toString()


def test_blocks_mark_runs(spark, sf_dir):
    """Which windows are of given runs needs no join of windows; a null is no run."""
    from seqscope.operators import runs

    docs = spark.createDataFrame([(i, " ".join(str(j % 5) for j in range(64 + 32 * (i or 0)))) for i in (0, 1, 2, 3, None)], "doc_id long, text string")
    given = spark.createDataFrame([(1,), (3,), (3,), (9,), (None,)], "run_id long")
    windows = runs.Model(docs).scored(runs=given)
    assert "Join" not in windows._jdf.queryExecution().executedPlan().toString()
    got = windows.collect()
    assert len(got) == 1 + 2 + 3 + 4 + 1
    assert all(r.marked == (r.run_id in (1, 3)) for r in got)
    assert not any(r.marked for r in runs.Model(docs).scored(runs=given.limit(0)).collect())
    assert "marked" not in runs.Model(docs).scored().columns


def test_packed_numbers_are_the_same():
    import numpy as np

    from seqscope.operators.runs import packed, unpacked

    for x in (np.zeros(0, "<u8"), np.array([0, 3, 3, 2**64 - 1], "<u8"), np.array([5], "<i8"), np.arange(70_000) * 3, np.array([0.0, -1.5, np.inf, 1e-300])):
        kind = x.dtype.str
        assert unpacked(packed(x), kind).tobytes() == x.tobytes()
        if kind != "<f8":
            assert unpacked(packed(x, True), kind, True).tobytes() == x.tobytes()


def test_texts_are_dealt_in_parts(monkeypatch):
    import pyarrow as pa

    from seqscope.operators import runs

    monkeypatch.setattr(runs, "DEALT", 1000)
    texts = [None, "", "ä x", *("w" * i for i in range(300))]
    table = pa.table({"run_id": [f"r{i}" for i in range(len(texts))], "text": texts, "block": pa.array([i % 3 for i in range(len(texts))], pa.int32())})
    parts = pa.Table.from_batches(runs.dealt(iter(table.to_batches(max_chunksize=7))))
    assert parts.num_rows > 9
    for block in range(3):
        own = runs._docs(parts.filter(pa.compute.equal(parts["block"], block)))
        assert own.to_pylist() == [{"run_id": f"r{i}", "text": t} for i, t in enumerate(texts) if i % 3 == block]


def test_runs_may_have_ids_of_any_kind(spark, monkeypatch):
    """Blocks get a part from each split, and some may have no run at all."""
    from seqscope.operators import runs, sequence

    monkeypatch.setattr(runs, "SMALL_BLOCK", 2000)
    docs = spark.createDataFrame([(f"run {i}", " ".join(str((i * j) % 17) for j in range(i * 9))) for i in range(40)], "doc_id string, text string").repartition(5)
    tokens = sequence.bigram_tokens(sequence.split_tokens(docs, prev=True))
    rows = lambda df: {(r.run_id, r.window_index): list(r)[2:] for r in df.select("run_id", "window_index", "prefix_entropy", "mean_logprob", "n_repeats", "confident_loop").collect()}
    model = runs.Model(docs)
    assert model.n > 1
    got, want = rows(model.windows()), rows(sequence.window_features(tokens))
    assert got.keys() == want.keys() and len(got) > 100
    assert all(got[k] == pytest.approx(v, rel=1e-9, abs=1e-11) for k, v in want.items())
    other = model.repeated(spark.createDataFrame([("run 39",), ("nobody",)], "run_id string"))
    assert {r.run_id for r in other.collect()} == {"run 39"}


def test_quantiles_keep_few_scores(spark, monkeypatch):
    """A percentile of all scores is one task's map of every different one."""
    import random

    from seqscope.operators import calibration

    rng = random.Random(7)
    rows = [(i % 50, by, score) for by, scores in {
        "a": [rng.random() * 3 for _ in range(2001)], "b": [rng.gauss(0, 1e3) for _ in range(1000)], "same": [0.25] * 400, "two": [-5.0, 1e300],
        "one": [2.0], "ends": [0.0] * 10 + [9.0] * 10, None: [1.0, 2.0, float("nan"), float("inf")], "close": [0.1 + i * 1e-9 for i in range(500)],
    }.items() for i, score in enumerate(scores)]
    windows = spark.createDataFrame(rows, "run_id long, by string, score double").cache()
    finite = windows.where("score > double('-inf') and score < double('inf')")
    for q in (0.5, 0.0, 1.0, 0.3, 0.999):
        want = finite.groupBy("by").agg(F.percentile("score", q), F.avg("score"), F.min("score"), F.max("score"), F.count("*"), F.countDistinct("run_id")).collect()
        got = {r.by: list(r)[1:] for r in calibration.score_quantiles(windows, "by", q).collect()}
        assert len(want) == len(got) == 8
        for r in want:
            assert got[r.by] == pytest.approx(list(r)[1:], rel=1e-12, abs=1e-12)
    kept = []
    monkeypatch.setattr(calibration.F, "percentile", lambda c, q, n=None, own=F.percentile: kept.append((c, n)) or own(c, q, 1 if n is None else n))
    calibration.score_quantiles(windows, "by")
    assert [c for c, _ in kept] == ["__class", "__v"]
    assert all(n is not None for _, n in kept)


def test_large_tables_are_taken_in_waves(spark, sf_dir, monkeypatch):
    """A run has a wave's texts in its exchanges, nothing that was used stays, and windows are those of one wave."""
    from seqscope.operators import runs
    from seqscope.sources import scratch

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    good = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("run_id"))
    text = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    rows = lambda df: {(r.run_id, r.window_index): (r.marked, *list(r)[2:-1]) for r in df.select("run_id", "window_index", "marked", "mean_entropy", "mean_logprob", "prefix_entropy", "repetition_rate", "confident_loop", "score").collect()}
    grams = lambda df: sorted((r.run_id, r.n, r.end_pos) for r in df.collect())
    whole = runs.Model(docs)
    want, repeats = rows(whole.scored(runs=good)), grams(whole.repeated())
    assert len(want) > 100
    folders, dealt = [], []
    new = lambda spark, *a: folders.append(scratch.new_folder(spark, *a)) or folders[-1]
    own = runs.Model._texts
    monkeypatch.setattr(runs, "BLOCK", text // 64)
    monkeypatch.setattr(runs, "new_folder", new)
    monkeypatch.setattr(runs.Model, "_texts", lambda self, *a: dealt.append(own(self, *a)) or dealt[-1])
    spark.sparkContext._jvm.System.gc()
    before = left_on_disk(spark)
    model = runs.Model(docs)
    assert model.n >= 64 and model.waves == runs.WAVES == 4
    windows = model.scored(runs=good)
    sizes = [sum(runs._docs(part.toArrow())["text"].nbytes for part in [df]) for df in dealt]
    assert len(sizes) == 2 + 4 + 4  # words, pairs, windows
    assert 0 < max(sizes[:2]) < 0.75 * sum(sizes[:2]) and 0 < max(sizes[2:]) < 0.5 * sum(sizes[2:6])
    assert sum(sizes[:2]) == pytest.approx(sum(sizes[2:6]), rel=0.02) and sizes[2:6] == sizes[6:]
    assert grown(spark, before, 2000) <= 2000
    assert "FlatMap" not in windows._jdf.queryExecution().executedPlan().toString()
    assert rows(windows).keys() == want.keys()
    got = rows(windows)
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)
    left = [f for folder in folders[:-1] for f in Path(folder.removeprefix("file://")).rglob("*.parquet")]
    assert not left
    with pytest.raises(ValueError, match="kept"):
        model.windows()
    again = runs.Model(docs, kept=scratch.save)
    assert rows(again.scored(runs=good)).keys() == want.keys()
    assert grams(again.repeated()) == repeats
