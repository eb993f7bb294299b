"""Queries over files that are written from the driver tables and read back, and over single steps of a controlled run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import BacktrackConfig
from ..functions import columns as C
from ..operators import budget, calibration, detection, scoring, sequence
from ..sources import datasets, jsonl, store
from ..sources.scratch import new_folder
from . import sequences
from .registry import query, rounded, table


@query(f"WITH {sequences._EMB} SELECT CASE WHEN vec_id % 3 = 0 THEN CAST(row_number() OVER (ORDER BY vec_id) * 2 - 1 AS VARCHAR) ELSE 'v' || vec_id END AS run_id, 0::BIGINT AS pos, label AS token, round(-list_sum(list_transform(sh, lambda x: exp(x - lz) * (x - lz))), 6) AS entropy FROM z")
def s01_trace_scan(spark, sf_dir):
    """A trace file with blank lines, in which each third run has no id but its line's number."""
    folder = new_folder(spark)
    token = F.array(F.struct(F.col("label").cast("int").alias("token_id"), F.col("embedding").cast("array<double>").alias("logits")))
    own = F.to_json(F.struct(F.when(F.col("vec_id") % 3 != 0, F.concat(F.lit("v"), F.col("vec_id"))).alias("run_id"), token.alias("tokens")))
    lines = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.array(F.lit(""), own)).alias("value"))
    lines.repartitionByRange(3, "vec_id").sortWithinPartitions("vec_id", "value").select("value").write.text(folder)
    t = jsonl.traces(spark, folder)
    return rounded(t.select("run_id", "pos", "token", C.entropy(F.col("logits")).alias("entropy")))


@query("SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR) AS id, text AS prompt FROM documents WHERE doc_id % 4 <> 0 AND text <> '' AND text IS NOT NULL")
def s02_prompt_scan(spark, sf_dir):
    """Prompts under three names, without ids; a fourth of the rows has none."""
    folder, d = new_folder(spark), table(spark, sf_dir, "documents")
    named = [F.when(F.col("doc_id") % 4 == i, F.col("text")).otherwise("").alias(n) for i, n in ((1, "prompt"), (2, "question"), (3, "input"))]
    d.repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").select(*named).write.json(folder)
    return jsonl.prompts(spark, folder).select("id", "prompt")


@query("SELECT l_linestatus = 'F' AS first_source, l_returnflag AS method, count(*) AS rows, round(avg(l_tax), 6) AS latency FROM lineitem GROUP BY ALL")
def s03_result_scan(spark, sf_dir):
    own, folders = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), F.col("l_returnflag").alias("method"), F.col("l_tax").alias("latency"), "l_linestatus"), [new_folder(spark), new_folder(spark)]
    for folder, status in zip(folders, "FO", strict=True):
        own.where(F.col("l_linestatus") == status).drop("l_linestatus").write.json(folder)
    rows = jsonl.results(spark, folders)
    return rounded(rows.groupBy((F.col("src_ord") == 0).alias("first_source"), "method").agg(F.count("*").alias("rows"), F.avg("latency").alias("latency")))


_GSM = "SELECT o_orderkey, 'How much is ' || o_custkey || '?' AS question, 'It is so. #### ' || o_custkey AS answer FROM orders"


@query(f"SELECT 'gsm8k-test-' || lpad(CAST(row_number() OVER (ORDER BY sha256('7|' || o_orderkey), o_orderkey) - 1 AS VARCHAR), 6, '0') AS id, question, regexp_extract(answer, '#### (.*)', 1) AS reference_answer FROM ({_GSM}) ORDER BY sha256('7|' || o_orderkey), o_orderkey LIMIT 200")
def s06_seeded_items(spark, sf_dir):
    """A data set's first 200 items, the loader's limit, in a seeded order."""
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", F.concat(F.lit("How much is "), "o_custkey", F.lit("?")).alias("question"), F.concat(F.lit("It is so. #### "), "o_custkey").alias("answer"))
    return datasets.items(rows, "gsm8k", "test", "o_orderkey", 200, 7).select("id", "question", "reference_answer")


@query("SELECT c_mktsegment || ':' || (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) AS id, c_mktsegment AS subject, 'train' AS split, c_custkey FROM customer WHERE c_mktsegment IN (SELECT DISTINCT c_mktsegment FROM customer)")
def s07_union_of_configs(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    names = [r[0] for r in c.select("c_mktsegment").distinct().collect()]  # a handful of configurations
    return datasets.union_of({n: c.where(F.col("c_mktsegment") == n) for n in names}, "c_custkey").select("id", "subject", "split", "c_custkey")


@query("SELECT doc_id AS item_id, text AS problem, lang AS subject FROM documents")
def s08_field_map(spark, sf_dir):
    assert jsonl.revision_of("3f1c")
    return jsonl.rename(table(spark, sf_dir, "documents"), {"item_id": "doc_id", "problem": "text", "subject": "lang"})


def _artifacts(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("item_id"), (F.col("doc_id") * 3).alias("item_seed"), F.sha2("lang", 256).alias("content_sha256"), F.length("text").cast("long").alias("n"), F.col("doc_id").alias("place"))
    return items


@query("SELECT CAST(doc_id AS VARCHAR) AS item_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE doc_id % 2 = 0 OR doc_id % 5 = 0")
def s09_artifacts_in_order(spark, sf_dir):
    """Artifacts of two passes over a resumable store, each item's once."""
    items = _artifacts(spark, sf_dir)
    kept = store.Store(spark, new_folder(spark), {"run": 1, "parallel_workers": 6}, "item_id string, n long")
    for divisor in (2, 5):
        kept.resume(items.where(F.col("place") % divisor == 0), lambda todo: todo.select("item_id", "n"))
    return kept.in_order(items, "place").select("item_id", "n")


@query("SELECT CAST(doc_id AS VARCHAR) AS item_id FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0")
def s10_valid_artifacts(spark, sf_dir):
    """Artifacts without those whose hash, seed or content isn't their item's."""
    items, body = _artifacts(spark, sf_dir), ["item_id", "item_seed", "content_sha256", "n"]
    a = items.withColumn("item_seed", F.when(F.col("place") % 7 == 0, 1 - F.col("item_seed")).otherwise(F.col("item_seed")))
    a = a.withColumn("content_sha256", F.when(F.col("place") % 11 == 0, "other").otherwise(F.col("content_sha256")))
    a = a.withColumn("artifact_sha256", store.udfs.canonical_json_sha(F.struct(*body))).withColumn("n", F.when(F.col("place") % 5 == 0, F.col("n") + 1).otherwise(F.col("n")))
    return store.valid(a, items, body).select("item_id")


_EVENTS = "SELECT CAST(user_id AS VARCHAR) AS run_id, CASE event_type WHEN 'click' THEN 'token' WHEN 'view' THEN 'window' ELSE 'backtrack' END AS type, event_id FROM events"


def _trace(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "token").when(F.col("event_type") == "view", "window").otherwise("backtrack")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), kind.alias("type"), F.col("event_id").alias("pos"), F.lit("k").alias("cache"))


@query(f"SELECT u.run_id, CASE WHEN n IS NULL THEN -1 ELSE n END AS token_events FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS run_id FROM events) u LEFT JOIN (SELECT run_id, count(*) AS n FROM ({_EVENTS}) WHERE type = 'token' AND event_id % 3 <> 0 GROUP BY run_id) USING (run_id)")
def s12_token_events(spark, sf_dir):
    """Token events of a trace in which each third line is broken."""
    folder, t = new_folder(spark), _trace(spark, sf_dir).drop("cache")
    lines = F.to_json(F.struct("run_id", "type", "pos"))
    t.select(F.when(F.col("pos") % 3 == 0, F.concat(F.substring(lines, 1, 20))).otherwise(lines).alias("value")).write.text(folder)
    return jsonl.token_events(spark, folder, t.select("run_id").distinct().withColumn("tokens_generated", F.lit(-1).cast("long"))).select("run_id", "token_events")


@query(f"SELECT run_id, type, count(*) AS events, max(event_id) AS last FROM ({_EVENTS}) GROUP BY ALL")
def k01_trace_sink(spark, sf_dir):
    folder = new_folder(spark)
    jsonl.write_events(_trace(spark, sf_dir), folder)
    rows = jsonl.scan(spark, folder, jsonl.EVENT)
    return rows.groupBy("run_id", "type").agg(F.count("*").alias("events"), F.max("pos").alias("last"))


@query(f"SELECT run_id, type, count(*) AS events FROM ({_EVENTS}) GROUP BY ALL UNION ALL SELECT 'left', 'files', 0::BIGINT")
def s11_read_and_delete(spark, sf_dir):
    """A trace's events, and the number of files that are left of it."""
    folder = new_folder(spark)
    jsonl.write_events(_trace(spark, sf_dir), folder)
    rows = jsonl.take_events(spark, folder).groupBy("run_id", "type").agg(F.count("*").alias("events"))
    system = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    left = int(system.exists(spark._jvm.org.apache.hadoop.fs.Path(folder)))
    return rows.unionByName(spark.createDataFrame([("left", "files", left)], "run_id string, type string, events long"))


@query(f"WITH {sequences.WINDOWS} SELECT CAST(run_id AS VARCHAR) AS run_id, window_index, round(repetition_rate, 6) AS repetition_rate, round(score, 6) AS score FROM scored")
def k02_feature_sink(spark, sf_dir):
    """Lines name each feature in each window, so plain ones are many times the windows' size."""
    folder = new_folder(spark)
    jsonl.write_features(sequences.windows_of(spark, sf_dir), folder, compression="gzip")
    return rounded(jsonl.features(spark, folder).select("run_id", "window_index", "repetition_rate", "score"))


def _event_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("window_index"), (F.col("event_id") % 5000).alias("end_pos"), F.round("value", 6).alias("score"))


_POOLED = "w AS (SELECT user_id AS run_id, event_id AS window_index, event_id % 5000 AS end_pos, round(value, 6) AS score FROM events), b AS (SELECT *, " + sequences.BUCKET + " AS bucket FROM w)"


@query(f"WITH {_POOLED} SELECT bucket, count(*) AS n, round(avg(score), 6) AS mean, 1e-6::DOUBLE AS clip FROM b GROUP BY bucket")
def k06_saved_calibrator(spark, sf_dir):
    folder = new_folder(spark)
    store.save_pools(calibration.pools(_event_windows(spark, sf_dir)), folder)
    pools, clip = store.load_pools(spark, folder)
    return rounded(pools.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("score").alias("mean")).withColumn("clip", F.lit(clip)), clip=9)


_OWN = f"""{_POOLED}, p AS (SELECT *, (1 + count(*) OVER (PARTITION BY bucket ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / CAST(1 + count(*) OVER (PARTITION BY bucket) AS DOUBLE) AS p FROM b),
    s AS (SELECT *, sum({sequences.log_mixture_sql('p')}) OVER (PARTITION BY run_id ORDER BY window_index ROWS UNBOUNDED PRECEDING) AS s FROM p),
    l AS (SELECT run_id, s - least(0.0, coalesce(min(s) OVER (PARTITION BY run_id ORDER BY window_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS loge FROM s),
    t AS (SELECT run_id, max(loge) AS top FROM l GROUP BY run_id), grid AS (SELECT i AS k, ln(1.01::DOUBLE) + (ln(1e8::DOUBLE) - ln(1.01::DOUBLE)) * i / 79 AS h FROM range(80) x(i)),
    r AS (SELECT k, h, count_if(top >= h) / count(*) AS rate, count(*) AS runs FROM t, grid GROUP BY ALL)"""


@query(f"WITH {_OWN} SELECT round(h, 6) AS selected_h, round(CASE WHEN rate <= 0.05 THEN rate ELSE 1 END, 6) AS rate, rate <= 0.05 AS feasible, runs FROM r ORDER BY rate > 0.05, CASE WHEN rate <= 0.05 THEN k ELSE -k END LIMIT 1")
def c15_calibrated_threshold(spark, sf_dir):
    """Pools and p-values of the same windows, and the threshold that they select."""
    _, one = calibration.calibrated(_event_windows(spark, sf_dir), detector=sequences.UNCLIPPED)
    return rounded(one.select("selected_h", "rate", "feasible", "runs"))


@query("SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS window_index, round(abs(value) / 1000, 6) AS p_value FROM events WHERE event_id % 4 <> 0")
def c12_run_forms(spark, sf_dir):
    """Runs as lists of p-values, or as windows with a p-value, some of which are null."""
    p = F.when(F.col("event_id") % 4 != 0, F.abs("value") / 1000)
    runs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.array_sort(F.collect_list(F.struct("event_id", p.alias("p_value")))).alias("all"))
    odd = F.col("run_id") % 2 == 1
    forms = runs.select("run_id", F.when(odd, F.transform("all", lambda w: w["p_value"])).alias("p_values"), F.when(~odd, F.col("all")).alias("windows"))
    return rounded(calibration.normalized_runs(forms).select("run_id", F.col("window_index").cast("long").alias("window_index"), "p_value"))


@query(f"WITH {sequences._EMB}, u AS (SELECT vec_id, list_transform(l, lambda x: exp(x / 0.6::DOUBLE - list_max(l) / 0.6::DOUBLE)) AS w, (vec_id * 37 % 101) / 101.0 AS u FROM e) SELECT vec_id, CAST(least(63, len(list_filter(range(64), lambda i: list_sum(w[1:i + 1]) <= u * list_sum(w)))) AS BIGINT) AS token FROM u")
def t16_sampled_token(spark, sf_dir):
    u = (F.col("vec_id") * 37 % 101) / 101.0
    return table(spark, sf_dir, "embeddings").select("vec_id", C.sampled(F.col("embedding"), u, 0.6).cast("long").alias("token"))


@query(f"WITH {sequences.TOK}, n AS (SELECT run_id, count(*) AS n_tokens, count(*) // 2 AS cut FROM tok GROUP BY run_id), k AS (SELECT *, least(n_tokens, cut) AS tokens FROM n) SELECT run_id, tokens, CASE WHEN tokens >= 64 THEN (tokens - 64) // 32 + 1 ELSE 0 END AS windows, CASE WHEN tokens < 64 THEN 0 ELSE ((tokens - 64) // 32 + 1) * 32 END AS next_start FROM k")
def w13_truncated_monitors(spark, sf_dir):
    runs = sequence.split_tokens(table(spark, sf_dir, "documents")).groupBy("run_id").agg(F.count("*").alias("n_tokens"), F.floor(F.count("*") / 2).alias("cut"))
    return sequence.truncated_monitors(runs).select("run_id", "tokens", "windows", "next_start")


_ALARM = "a AS (SELECT user_id AS run_id, event_id AS token_pos, CAST(floor(event_id - abs(value)) AS BIGINT) AS rollback_pos, event_id AS length FROM events WHERE event_type = 'click')"


def _alarms(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'click'")
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("token_pos"), F.floor(F.col("event_id") - F.abs("value")).cast("long").alias("rollback_pos"), F.col("event_id").alias("length"))


@query(f"WITH {_ALARM}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY token_pos) AS k FROM a) SELECT run_id, token_pos, k > 3 AS refused, CAST(least(k, 3) AS BIGINT) AS reroll, CASE WHEN k <= 3 THEN least(greatest(10, rollback_pos), length) END AS cut, CASE WHEN k <= 3 THEN length - least(greatest(10, rollback_pos), length) END AS span FROM n")
def g02_decisions(spark, sf_dir):
    """What the controller does about each alarm: rolled back to its changepoint, or refused."""
    return rounded(detection.decisions(_alarms(spark, sf_dir), prompt_len=10).select("run_id", "token_pos", "refused", "reroll", "cut", "span"))


@query(f"WITH {_ALARM}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY token_pos) AS k FROM a) SELECT run_id, token_pos, CASE WHEN k <= 3 THEN least(greatest(0, token_pos - 128), length) END AS cut FROM n")
def g02_fixed_rollback(spark, sf_dir):
    return detection.decisions(_alarms(spark, sf_dir), BacktrackConfig(fixed_rollback=128)).select("run_id", "token_pos", "cut")


@query(f"WITH {_ALARM}, f AS (SELECT run_id, min(token_pos) AS first FROM a GROUP BY run_id) SELECT user_id AS run_id, event_id AS step, CASE WHEN first IS NOT NULL AND event_id > first THEN 0.6 ELSE 1.0 END AS temperature, CASE WHEN first IS NOT NULL AND event_id > first THEN 1.1 ELSE 1.0 END AS penalty FROM events LEFT JOIN f ON user_id = run_id")
def g04_redecode_overrides(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"))
    found = _alarms(spark, sf_dir).select("run_id", F.col("token_pos").alias("step"))
    return rounded(detection.redecoded(t, found).select("run_id", "step", "temperature", "penalty"))


@query("""WITH RECURSIVE e AS (SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_quantity AS BIGINT) * 8, l_linenumber * 9) AS k, CAST(l_quantity AS BIGINT) * 8 AS t, CAST(l_linenumber * 9 AS BIGINT) AS r FROM lineitem),
    f AS (SELECT run_id, 0::BIGINT AS k, 0::BIGINT AS length, 0::BIGINT AS sampled, 0::BIGINT AS deleted, 0::BIGINT AS rollbacks FROM (SELECT DISTINCT run_id FROM e)
        UNION ALL
        SELECT f.run_id, e.k, CASE WHEN ok THEN p - d ELSE f.length END, CASE WHEN ok THEN f.sampled + p - f.length ELSE f.sampled END, CASE WHEN ok THEN f.deleted + d ELSE f.deleted END, CASE WHEN ok THEN f.rollbacks + 1 ELSE f.rollbacks END
        FROM f JOIN e ON e.run_id = f.run_id AND e.k = f.k + 1, LATERAL (SELECT greatest(e.t, f.length + 1) AS p) x, LATERAL (SELECT least(p, greatest(1, e.r)) AS d, f.sampled + p - f.length <= 300 AS ok) y)
    SELECT run_id, 300::BIGINT AS sampled, arg_max(deleted, k) AS deleted, 300 - arg_max(deleted, k) AS emitted, arg_max(rollbacks, k) AS rollbacks FROM f GROUP BY run_id""")
def g06_scheduled_accounts(spark, sf_dir):
    """Accounts of runs that are rolled back by a schedule, without a detector."""
    e = F.struct((F.col("l_quantity").cast("long") * 8).alias("trigger_at"), (F.col("l_linenumber") * 9).cast("long").alias("rollback_tokens"))
    runs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.collect_list(e).alias("schedule"))
    return budget.scheduled_accounts(runs, 300)


@query("""SELECT l_orderkey, l_linenumber, d AS dataset, CASE WHEN d = 'other' AND l_linenumber % 2 = 0 THEN NULL WHEN l_orderkey % 4 = 0 THEN 1.0 ELSE 0.0 END AS correct, CASE WHEN d = 'other' AND l_linenumber % 2 = 0 THEN NULL ELSE true END AS answer_extraction_ok
    FROM (SELECT *, ['math500', 'gsm8k', 'other'][l_orderkey % 3 + 1] AS d FROM lineitem)""")
def a11_scorer_dispatch(spark, sf_dir):
    """Each data set's own scorer, and nulls where there is nothing to score with."""
    d = F.element_at(F.array(*map(F.lit, ("math500", "gsm8k", "other"))), (F.col("l_orderkey") % 3 + 1).cast("int"))
    n = F.col("l_quantity").cast("long")
    math, given = d == "math500", F.when(F.col("l_orderkey") % 4 == 0, n).otherwise(n + 1)
    text = F.when(math, F.concat(F.lit("So \\boxed{\\frac{"), given, F.lit("}{7}}."))).otherwise(F.concat(F.lit("Then #### "), given))
    reference = F.when(math, F.concat(F.lit("\\dfrac{"), n, F.lit("}{7}"))).when((d == "other") & (F.col("l_linenumber") % 2 == 0), F.lit(None)).otherwise(F.concat(F.lit("#### "), n))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", d.alias("dataset"), text.alias("text"), reference.cast("string").alias("reference"))
    return rounded(scoring.score(rows).select("l_orderkey", "l_linenumber", "dataset", "correct", "answer_extraction_ok"))
