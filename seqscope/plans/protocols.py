"""Queries of the data set protocol, answer scoring, statistics, budgets, candidates, sources and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config, DetectorConfig, WindowConfig
from ..functions import columns as C
from ..functions import udfs
from ..operators import budget, candidates, protocol, stats
from ..sources import jsonl, store
from ..sources.scratch import new_folder
from ..streaming import monitor
from . import sequences
from .registry import query, rounded, table

SEED = protocol.SEED
ITEMS = f"""
    norms AS (SELECT doc_id, lang, source, trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS normal FROM documents),
    hashed AS (SELECT *, sha256(normal) AS content_sha256 FROM norms),
    items AS (SELECT *, sha256('{SEED}|' || content_sha256) AS selection_key, 'source:' || doc_id || ':' || substr(content_sha256, 1, 16) AS item_id FROM hashed),
    firsts AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY content_sha256 ORDER BY doc_id) = 1)"""


def items_of(spark: SparkSession, sf_dir: str, ascii_only: bool = True) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return protocol.items(docs, "text", "doc_id", ["doc_id"], ascii_only)


def firsts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.dedupe(items_of(spark, sf_dir))


def _short(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "content_sha256", "selection_key", "item_id", "lang")


@query(f"WITH {ITEMS} SELECT doc_id, content_sha256 FROM items")
def p01_normalize_hash(spark, sf_dir):
    return items_of(spark, sf_dir).select("doc_id", "content_sha256")


@query("SELECT doc_id, sha256(trim(regexp_replace(nfc_normalize(text), '[ \\t\\n\\r\\f]+', ' ', 'g'))) AS content_sha256 FROM documents")
def p01_normalize_nfkc(spark, sf_dir):
    return items_of(spark, sf_dir, ascii_only=False).select("doc_id", "content_sha256")


@query(f"WITH {ITEMS} SELECT doc_id, selection_key, item_id FROM items")
def p03_selection_key(spark, sf_dir):
    return items_of(spark, sf_dir).select("doc_id", "selection_key", "item_id")


@query(f"WITH {ITEMS} SELECT doc_id, CAST(('0x' || substr(h, 1, 16))::UBIGINT & 9223372036854775807::UBIGINT AS BIGINT) AS item_seed FROM (SELECT doc_id, sha256('{SEED}|' || item_id) AS h FROM items)")
def p04_item_seed(spark, sf_dir):
    return items_of(spark, sf_dir).select("doc_id", "item_seed")


@query()
def p05_blake2_seed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", udfs.stable_seed_udf(SEED, "int4")("doc_id").alias("seed"))


@query("SELECT conv_id, turn, coalesce(nullif(CASE WHEN role = 'user' THEN text END, ''), nullif(role, ''), '') AS problem FROM conversations")
def p06_fallback_fields(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.select("conv_id", "turn", F.when(F.col("role") == "user", F.nullif(F.col("text"), F.lit(""))).alias("problem"), F.nullif(F.col("role"), F.lit("")).alias("question"))
    return rows.select("conv_id", "turn", F.coalesce(protocol.fallback("problem", "question", "solution", present=rows.columns), F.lit("")).alias("problem"))


@query(f"WITH {ITEMS} SELECT doc_id, content_sha256 FROM firsts")
def p07_dedupe_first(spark, sf_dir):
    return firsts_of(spark, sf_dir).select("doc_id", "content_sha256")


@query(f"WITH {ITEMS} SELECT doc_id, content_sha256 FROM items WHERE normal <> '' QUALIFY row_number() OVER (PARTITION BY content_sha256 ORDER BY doc_id DESC) = 1")
def p08_dedupe_last(spark, sf_dir):
    return protocol.dedupe(items_of(spark, sf_dir), "last", skip_empty=True).select("doc_id", "content_sha256")


@query(f"WITH {ITEMS}, n AS (SELECT *, row_number() OVER (ORDER BY selection_key, item_id) AS rank FROM firsts) SELECT doc_id, rank, CASE WHEN rank <= 300 THEN 'reference' ELSE 'development' END AS role FROM n WHERE rank <= 400")
def p09_split_roles(spark, sf_dir):
    return rounded(protocol.fixed_split(firsts_of(spark, sf_dir), 300, 100).select("doc_id", "rank", "role"))


_ROLES = f"""{ITEMS},
    ra AS (SELECT *, 'reference' AS role FROM firsts WHERE lang = 'en' ORDER BY selection_key, item_id LIMIT 100),
    rb AS (SELECT *, 'development' AS role FROM firsts WHERE content_sha256 NOT IN (SELECT content_sha256 FROM ra) ORDER BY selection_key, item_id LIMIT 80),
    rc AS (SELECT *, 'test' AS role FROM firsts WHERE content_sha256 NOT IN (SELECT content_sha256 FROM ra UNION ALL SELECT content_sha256 FROM rb) ORDER BY selection_key, item_id LIMIT 60),
    manifest AS (SELECT * FROM ra UNION ALL SELECT * FROM rb UNION ALL SELECT * FROM rc)"""


def manifest_of(spark, sf_dir):
    f = firsts_of(spark, sf_dir)
    return protocol.role_split({"reference": f.where("lang = 'en'"), "development": f, "test": f}, {"reference": 100, "development": 80, "test": 60})


@query(f"WITH {_ROLES} SELECT doc_id, role FROM manifest")
def p10_role_split(spark, sf_dir):
    return manifest_of(spark, sf_dir).select("doc_id", "role")


_RANKED = "n AS (SELECT doc_id, content_sha256, row_number() OVER (ORDER BY selection_key, item_id) AS rank FROM firsts), m AS (SELECT doc_id, content_sha256, row_number() OVER (ORDER BY selection_key, item_id) AS rank FROM firsts WHERE doc_id % 9 <> 4)"


@query(f"WITH {ITEMS}, {_RANKED} SELECT (SELECT count(*) FROM n WHERE rank <= 300) AS grown, (SELECT count(*) FROM n o WHERE rank <= 200 AND NOT EXISTS (SELECT 1 FROM n x WHERE x.rank = o.rank AND x.rank <= 300 AND x.doc_id = o.doc_id)) AS mismatches, (SELECT count(*) FROM n o LEFT JOIN (SELECT * FROM m WHERE rank <= 300) x USING (rank) WHERE o.rank <= 200 AND (x.doc_id IS DISTINCT FROM o.doc_id OR x.content_sha256 IS DISTINCT FROM o.content_sha256)) AS after_loss")
def p11_derive_prefix(spark, sf_dir):
    """A selection that only grew has no mismatches; one whose source lost rows has."""
    f = firsts_of(spark, sf_dir)
    old, new, less = protocol.ranked(f, 200), protocol.ranked(f, 300), protocol.ranked(f.where("doc_id % 9 <> 4"), 300)
    bad = [protocol.prefix_mismatches(old, x, ["doc_id", "content_sha256"]).agg(F.count("*").alias(n)) for x, n in ((new, "mismatches"), (less, "after_loss"))]
    return new.agg(F.count("*").alias("grown")).crossJoin(bad[0]).crossJoin(bad[1])  # a row each


_LEAK = f"{ITEMS}, b AS (SELECT sha256(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'))) AS content_sha256 FROM benchmark), both_roles AS (SELECT content_sha256, 'train' AS role FROM items UNION ALL SELECT content_sha256, 'test' AS role FROM b)"


def _bench(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", C.content_hash(C.normalized_ascii(F.col("text"))).alias("content_sha256"))


@query(f"WITH {_LEAK} SELECT content_sha256, count(DISTINCT role) AS roles, count(*) AS rows FROM both_roles GROUP BY content_sha256 HAVING count(DISTINCT role) > 1")
def p12_leakage(spark, sf_dir):
    train = items_of(spark, sf_dir).select("content_sha256", F.lit("train").alias("role"))
    return protocol.overlaps(train.unionByName(_bench(spark, sf_dir).select("content_sha256", F.lit("test").alias("role"))), "content_sha256")


@query(f"""WITH {_ROLES} SELECT 'missing item_id' AS rule, count(*) AS n FROM manifest WHERE item_id IS NULL UNION ALL SELECT 'missing lang', count(*) FROM manifest WHERE lang IS NULL
    UNION ALL SELECT 'count reference', abs(count(*) - 100) FROM manifest WHERE role = 'reference' UNION ALL SELECT 'count test', abs(count(*) - 60) FROM manifest WHERE role = 'test'
    UNION ALL SELECT 'repeated item_id', count(*) FROM (SELECT role, item_id FROM manifest GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'shared item_id', count(*) FROM (SELECT item_id FROM manifest GROUP BY ALL HAVING count(DISTINCT role) > 1)
    UNION ALL SELECT 'repeated content_sha256', count(*) FROM (SELECT role, content_sha256 FROM manifest GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'shared content_sha256', count(*) FROM (SELECT content_sha256 FROM manifest GROUP BY ALL HAVING count(DISTINCT role) > 1)""")
def p13_violations(spark, sf_dir):
    return protocol.violations(manifest_of(spark, sf_dir), {"reference": 100, "test": 60}, ["item_id", "lang"])


@query(f"WITH {_LEAK} SELECT item_id FROM (SELECT item_id, sha256(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'))) AS h FROM benchmark) WHERE h IN (SELECT content_sha256 FROM items)")
def p14_independent(spark, sf_dir):
    return protocol.independent(_bench(spark, sf_dir), items_of(spark, sf_dir)).select("item_id")


@query(f"WITH {ITEMS} SELECT doc_id, item_id || '|replicate:0' AS item_id, item_id AS source_item_id, 0::BIGINT AS replicate_seed FROM items")
def p15_units(spark, sf_dir):
    return rounded(protocol.units(items_of(spark, sf_dir), [0]).select("doc_id", "item_id", "source_item_id", "replicate_seed"))


@query()
def p15_units_replicated(spark, sf_dir):
    return protocol.units(items_of(spark, sf_dir), [0, 1, 2]).select("doc_id", "item_id", "replicate_seed", "item_seed")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) ORDER BY doc_id LIMIT 150")
def p16_include_exclude(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return protocol.select_ids(d, "doc_id", lab.select("doc_id"), lab.where("toxic = 1").select("doc_id"), 150).select("doc_id", "lang")


@query("SELECT count(DISTINCT doc_id) AS ids, sha256(string_agg(DISTINCT CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR)) || chr(10)) AS ids_sha256 FROM labels")
def p17_ids_digest(spark, sf_dir):
    return protocol.ids_digest(table(spark, sf_dir, "labels"), "doc_id")


@query("WITH i AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM documents), p AS (SELECT substr(sha256(id), 1, 3) AS b, count(*) AS n, sha256(string_agg(id, chr(10) ORDER BY id)) AS h FROM i GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS ids, sha256(string_agg(b || ':' || h, chr(10) ORDER BY b || ':' || h)) AS ids_sha256 FROM p")
def p17_ids_digests(spark, sf_dir):
    return protocol.ids_digests(table(spark, sf_dir, "documents"), "doc_id")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def p18_missing(spark, sf_dir):
    return protocol.missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"quality\":' || coalesce(CAST(quality AS VARCHAR), 'null') || ',\"toxic\":' || coalesce(CAST(toxic AS VARCHAR), 'null') || '}') AS sha256 FROM labels")
def p19_canonical_json_sha(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    return rows.select("doc_id", udfs.canonical_json_sha(F.struct("doc_id", "quality", "toxic")).alias("sha256"))


@query("SELECT count(*) AS items, count_if(l.doc_id IS NOT NULL) AS imported FROM (SELECT DISTINCT doc_id FROM labels) u JOIN documents l USING (doc_id)")
def p24_import_artifacts(spark, sf_dir):
    u = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id")).distinct()
    s = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "lang")
    return store.imported(u, s, "earlier").agg(F.count("*").alias("items"), F.count("lineage.campaign").alias("imported"))


@query("SELECT count_if(o_orderkey % 7 <> 0) AS units, count_if(o_orderkey % 7 = 0) AS left_only, 0::BIGINT AS right_only, count_if(o_orderkey % 7 <> 0) AS same_o_custkey, count_if(o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0) AS same_o_totalprice FROM orders")
def p25_repro_compare(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    other = o.where("o_orderkey % 7 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return protocol.reproducibility(o, other, "o_orderkey", ["o_custkey", "o_totalprice"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 3 = 0 ORDER BY 1 LIMIT 10")
def p25_first_mismatches(spark, sf_dir):
    """The first ten units, a report's limit, that two runs disagree on."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    other = o.where("o_orderkey % 7 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return protocol.first_mismatches(o, other, "o_orderkey", "o_totalprice")


def _answers(spark, sf_dir):
    n = F.col("l_quantity").cast("long").cast("string")
    form = F.when(F.col("l_orderkey") % 5 == 0, "none").when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("1,"), F.lpad(n, 3, "0"))).otherwise(F.concat(n, F.lit(".50")))
    text = F.concat(F.lit("We have "), F.col("l_linenumber").cast("string"), F.lit(" parts. #### "), form)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", text.alias("answer"))


_CANON = "CASE WHEN l_orderkey % 5 = 0 THEN NULL WHEN l_orderkey % 3 = 0 THEN CAST(1000 + CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.5' END"


@query("SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS digit_runs FROM conversations")
def a02_digit_runs(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_count("text", F.lit("[0-9]+")).cast("long").alias("digit_runs"))


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 2 END AS BIGINT) AS n_numbers, CAST(l_linenumber AS VARCHAR) AS first_number FROM lineitem")
def a02_numbers(spark, sf_dir):
    n = C.numbers(F.col("answer"))
    return _answers(spark, sf_dir).select("l_orderkey", F.col("l_linenumber"), F.size(n).cast("long").alias("n_numbers"), F.element_at(n, 1).alias("first_number"))


@query(f"SELECT l_orderkey, l_linenumber, {_CANON} AS reference FROM lineitem")
def a04_reference(spark, sf_dir):
    return _answers(spark, sf_dir).select("l_orderkey", "l_linenumber", C.reference_answer(F.col("answer")).alias("reference"))


@query(f"SELECT l_orderkey, l_linenumber, coalesce({_CANON}, CAST(l_linenumber AS VARCHAR)) AS prediction FROM lineitem")
def a05_model_answer(spark, sf_dir):
    return _answers(spark, sf_dir).select("l_orderkey", "l_linenumber", C.model_answer(F.col("answer")).alias("prediction"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 <> 0 AND l_linenumber % 2 = 0 THEN 1.0 ELSE 0.0 END AS correct, true AS answer_extraction_ok, l_orderkey % 5 <> 0 AS reference_extraction_ok FROM lineitem")
def a06_score(spark, sf_dir):
    a = _answers(spark, sf_dir)
    given = F.when(F.col("l_linenumber") % 2 == 0, F.col("answer")).otherwise(F.lit("it is -7"))
    ref, got = C.reference_answer(F.col("answer")), C.model_answer(given)
    correct = F.when(F.coalesce(ref == got, F.lit(False)), 1.0).otherwise(0.0)
    return a.select("l_orderkey", "l_linenumber", correct.alias("correct"), got.isNotNull().alias("answer_extraction_ok"), ref.isNotNull().alias("reference_extraction_ok"))


def _latex(spark, sf_dir):
    q, n = F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber").cast("string")
    forms = [F.concat(F.lit("$\\boxed{\\frac{"), q, F.lit("}{"), n, F.lit("}}$")), F.concat(F.lit("the final answer is "), q, F.lit(".50")), F.concat(F.lit("x\n\n#### "), n, F.lit("\\sqrt{"), q, F.lit("}")), F.concat(q, F.lit("^\\circ"))]
    k = F.col("l_orderkey") % 4
    text = F.when(k == 0, forms[0]).when(k == 1, forms[1]).when(k == 2, forms[2]).otherwise(forms[3])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("answer"))


_MATH = "CASE l_orderkey % 4 WHEN 0 THEN q || '/' || n WHEN 1 THEN q || '.5' WHEN 2 THEN n || 'sqrt(' || q || ')' ELSE q END FROM (SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, CAST(l_linenumber AS VARCHAR) AS n FROM lineitem)"


@query(f"SELECT l_orderkey, l_linenumber, {_MATH.replace(' FROM', ' AS normal FROM', 1)}")
def a09_math_normalize(spark, sf_dir):
    return _latex(spark, sf_dir).select("l_orderkey", "l_linenumber", udfs.normal_math_answer("answer").alias("normal"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 1.0 ELSE 0.0 END AS correct FROM lineitem")
def a10_score_math(spark, sf_dir):
    a = _latex(spark, sf_dir).withColumn("normal", udfs.normal_math_answer("answer"))
    other = F.when(F.col("l_linenumber") % 2 == 0, F.col("normal")).otherwise(F.lit("\\text{none}"))
    return a.withColumn("given", other).select("l_orderkey", "l_linenumber", F.when(F.col("normal") == udfs.normalize_math("given"), 1.0).otherwise(0.0).alias("correct"))


@query("SELECT item_id, concat('Solve the following grade-school math problem step by step. Finish with a line in the form #### <answer>.', chr(10), chr(10), 'Question: ', trim(text), chr(10), chr(10), 'Solution:') AS prompt FROM benchmark")
def a01_prompts(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", C.gsm_prompt(F.col("text")).alias("prompt"))


@query("SELECT doc_id, array_to_string(list_slice(w, 4, len(w)), ' ') AS completion FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS w FROM documents)")
def a12_completion(spark, sf_dir):
    words = F.filter(F.split("text", r"[ \t\n\r\f]+"), lambda w: w != "")
    return table(spark, sf_dir, "documents").select("doc_id", C.completion(words, F.lit(3)).alias("completion"))


def _results(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("method"),
        F.col("l_linestatus").alias("precision"),
        F.when(F.col("l_linenumber") == 7, None).otherwise(F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0)).alias("correct"),
        (F.col("l_discount") > 0.02).alias("answer_extraction_ok"),
        F.col("l_quantity").alias("tokens_generated"),
        (F.col("l_quantity") + F.col("l_linenumber")).alias("token_events_trace"),
        F.col("l_linenumber").cast("double").alias("extra_sampled"),
        F.col("l_tax").alias("latency"),
        (F.col("l_linenumber") % 3).alias("n_alerts"),
        (F.col("l_linenumber") % 2).alias("n_backtracks"),
        F.when(F.col("l_linenumber") > 3, F.col("l_discount")).alias("budget_match_relative_error"),
    )


_RES = """res AS (SELECT l_returnflag AS method, l_linestatus AS precision, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END AS correct, l_discount > 0.02 AS ok,
    l_quantity AS tokens, l_quantity + l_linenumber AS events, CAST(l_linenumber AS DOUBLE) AS extra, l_tax AS latency, l_linenumber % 3 AS alerts, l_linenumber % 2 AS backs, CASE WHEN l_linenumber > 3 THEN l_discount END AS err FROM lineitem)"""


@query(f"WITH {_RES} SELECT method, round(avg(coalesce(correct, 0)), 6) AS accuracy, round(avg(tokens), 6) AS tokens_generated, round(avg(latency), 6) AS latency, 0.0 AS number_of_alerts, 0.0 AS number_of_backtracks, 0.0 AS false_alert_rate, 0.0 AS degeneration_rate FROM res GROUP BY method")
def m01_metrics(spark, sf_dir):
    return rounded(stats.metrics(_results(spark, sf_dir), "method"))


_GROUPS = """SELECT precision, method, count(*) AS num_instances, round(count_if(correct = 1) / count_if(correct IS NOT NULL), 6) AS accuracy, count_if(correct = 1) AS num_correct, count_if(correct IS NOT NULL) AS num_scored, count_if(correct IS NOT NULL AND NOT ok) AS num_answer_extraction_failures,
    max(extra) AS max_extra_sampled, round(avg(tokens), 6) AS mean_tokens_generated, round(avg(events), 6) AS mean_token_events_trace, round(avg(extra), 6) AS mean_extra_sampled, round(avg(latency), 6) AS mean_latency, round(avg(alerts), 6) AS mean_alerts, round(avg(backs), 6) AS mean_backtracks, round(avg(backs), 6) AS mean_interventions,
    round(avg(tokens), 6) AS mean_primary_tokens_generated, round(avg(tokens), 6) AS mean_final_tokens_generated, round(avg(events), 6) AS mean_total_decode_tokens, round(avg(extra), 6) AS mean_extra_decode_tokens, round(coalesce(avg(err), 0), 6) AS mean_budget_match_relative_error FROM res GROUP BY precision, method"""


@query(f"WITH {_RES} {_GROUPS}")
def m02_group_summary(spark, sf_dir):
    return rounded(stats.group_summary(_results(spark, sf_dir)))


@query(f"WITH {_RES}, g AS ({_GROUPS}) SELECT precision, method, mean_extra_decode_tokens, mean_total_decode_tokens, mean_latency, round((mean_extra_decode_tokens - 3.0) / 3.0, 4) + 0.0 AS relative_error_to_profile, abs((mean_extra_decode_tokens - 3.0) / 3.0) <= 0.05 AS within_five_percent FROM g")
def m03_budget_summary(spark, sf_dir):
    return rounded(stats.budget_summary(stats.group_summary(_results(spark, sf_dir)), 3.0), relative_error_to_profile=4)


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, greatest(0, CAST(l_quantity AS BIGINT) - l_linenumber) AS tokens_generated, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS BIGINT) + 5 END AS ev, 40 AS budget, CASE WHEN l_linenumber % 3 = 0 THEN 0.0 ELSE 4.0 END AS target FROM lineitem),
    y AS (SELECT *, coalesce(ev, tokens_generated) AS decode_token_events_total FROM x), z AS (SELECT *, greatest(0, decode_token_events_total - tokens_generated) AS extra_sampled FROM y)
    SELECT l_orderkey, l_linenumber, tokens_generated, decode_token_events_total, extra_sampled, decode_token_events_total <= budget AS decode_budget_compliant, CASE WHEN target <> 0 THEN round((extra_sampled - target) / target, 6) + 0.0 END AS budget_match_relative_error FROM z""")
def m04_derived_row(spark, sf_dir):
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("n_tokens"), n.alias("prompt_tokens"), F.when(n % 2 == 0, F.col("l_quantity").cast("long") + 5).alias("trace_events"), F.lit(40).alias("budget"), F.when(n % 3 == 0, 0.0).otherwise(4.0).alias("target_extra"))
    return rounded(stats.derived_rows(rows).select("l_orderkey", "l_linenumber", "tokens_generated", "decode_token_events_total", "extra_sampled", "decode_budget_compliant", "budget_match_relative_error"))


_RUNS = "runs AS (SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source, d.n_chars, d.doc_id % 3 AS seed FROM labels l JOIN documents d USING (doc_id))"


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id").withColumn("seed", F.col("doc_id") % 3)


@query(f"""WITH {_RUNS} SELECT lang AS method, count(*) AS items, round(avg(quality), 6) AS accuracy, round(avg(CAST(n_chars > 100 AS INT)), 6) AS extractability, round(avg(toxic), 6) AS truncation_rate, round(avg(CAST(toxic > 0 AS INT)), 6) AS items_with_alarm_rate, round(avg(CAST(toxic * quality > 0 AS INT)), 6) AS items_with_reroll_rate,
    CAST(sum(n_chars) AS BIGINT) AS sampled_tokens, CAST(sum(n_chars - toxic) AS BIGINT) AS emitted_tokens, CAST(sum(toxic) AS BIGINT) AS deleted_tokens, round(avg(n_chars), 6) AS mean_sampled_tokens, round(avg(n_chars / 100), 6) AS mean_latency_seconds, max(n_chars) AS peak_vram_bytes FROM runs GROUP BY lang""")
def m05_method_summary(spark, sf_dir):
    x = _runs(spark, sf_dir)
    rows = x.select(F.col("lang").alias("method"), F.col("quality").alias("correct"), (F.col("n_chars") > 100).alias("extractable"), (F.col("toxic") == 1).alias("truncated"), F.col("toxic").alias("alarms"), (F.col("toxic") * F.col("quality")).alias("rerolls"), F.col("n_chars").alias("sampled"), (F.col("n_chars") - F.col("toxic")).alias("emitted"), F.col("toxic").alias("deleted"), (F.col("n_chars") / 100).alias("latency"), F.col("n_chars").alias("vram"))
    return rounded(stats.method_summary(rows))


@query(f"WITH {_RUNS} SELECT lang AS method, CASE WHEN toxic = 1 THEN 'max_new_tokens' WHEN quality = 1 THEN 'eos' ELSE 'unknown' END AS reason, count(*) AS n FROM runs GROUP BY ALL")
def m05_terminations(spark, sf_dir):
    reason = F.when(F.col("toxic") == 1, "max_new_tokens").when(F.col("quality") == 1, "eos")
    return stats.terminations(_runs(spark, sf_dir).select(F.col("lang").alias("method"), reason.alias("termination_reason")))


@query(f"WITH {_RUNS} SELECT lang AS method, seed, source AS subject, count(*) AS items, round(avg(quality), 6) AS accuracy FROM runs GROUP BY GROUPING SETS ((lang), (lang, seed), (lang, source))")
def m06_grouping_sets(spark, sf_dir):
    rows = _runs(spark, sf_dir).select(F.col("lang").alias("method"), "seed", F.col("source").alias("subject"), F.col("quality").alias("correct"))
    return rounded(stats.grouped_accuracy(rows))


@query(f"WITH {_RUNS}, s AS (SELECT lang, seed, avg(quality) AS a FROM runs GROUP BY ALL) SELECT lang AS method, count(*) AS seeds, round(coalesce(stddev_samp(a), 0), 6) AS accuracy_seed_std FROM s GROUP BY lang")
def m06_seed_spread(spark, sf_dir):
    return rounded(stats.seed_spread(_runs(spark, sf_dir).select(F.col("lang").alias("method"), "seed", F.col("quality").alias("correct"))))


@query(f"WITH {_RUNS} SELECT lang AS method, round(avg(CAST(quality = 1 OR toxic = 1 AS INT)), 6) AS candidate_oracle_pass_rate FROM runs WHERE seed > 0 GROUP BY lang")
def m06_oracle_pass_rate(spark, sf_dir):
    c = F.when(F.col("seed") > 0, F.array(F.col("quality").cast("double"), F.col("toxic").cast("double")))
    return rounded(stats.oracle_pass_rate(_runs(spark, sf_dir).select(F.col("lang").alias("method"), c.alias("candidates"))))


_PAIR = f"{_RUNS}, u AS (SELECT doc_id, lang, source, seed, quality AS v, 1 - toxic AS m FROM runs)"
_PAIRED = "count(*) AS paired_units, round(avg(v), 6) AS baseline_accuracy, round(avg(m), 6) AS method_accuracy, round(avg(m - v), 6) + 0.0 AS difference, count_if(v = 0 AND m = 1) AS corrections, count_if(v = 1 AND m = 0) AS regressions"


def _both(spark, sf_dir):
    x = _runs(spark, sf_dir)
    a = x.select("doc_id", "lang", "source", F.col("quality").alias("correct"))
    b = x.select("doc_id", "lang", "source", (1 - F.col("toxic")).alias("correct"))
    return stats.pairs(a, b, ["doc_id", "lang", "source"])


@query(f"WITH {_PAIR} SELECT lang, {_PAIRED} FROM u GROUP BY lang")
def m07_paired(spark, sf_dir):
    return rounded(stats.paired(_both(spark, sf_dir), ["lang"]).drop("p"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def m07_unpaired(spark, sf_dir):
    return stats.unpaired(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query(f"WITH {_PAIR} SELECT source, count(*) AS units, round(avg(m - v), 6) + 0.0 AS mean_difference FROM u GROUP BY source")
def m08_cluster_paired(spark, sf_dir):
    return rounded(stats.cluster_means(_both(spark, sf_dir), "source"))


@query(f"WITH {_RUNS} SELECT count_if(toxic = 0) AS no_alarm_units, count_if(toxic = 0 AND n_chars % 5 <> 0) AS identical, round(count_if(toxic = 0 AND n_chars % 5 <> 0) / count_if(toxic = 0), 6) AS rate FROM runs")
def m08_token_identity(spark, sf_dir):
    left = F.array(F.col("n_chars"), F.col("doc_id"))
    rows = _runs(spark, sf_dir).select(F.col("toxic").alias("alarms"), left.alias("left_tokens"), F.when(F.col("n_chars") % 5 != 0, left).alias("right_tokens"))
    return rounded(stats.token_identity(rows))


_MC = """mc AS (SELECT lang, c, d, CASE WHEN c + d = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(c, d) + 1), lambda i: exp(lgamma(c + d + 1) - lgamma(i + 1) - lgamma(c + d - i + 1) - (c + d) * ln(2))))) END AS p
    FROM (SELECT lang, count_if(v = 0 AND m = 1) AS c, count_if(v = 1 AND m = 0) AS d FROM u GROUP BY lang))"""


@query(f"WITH {_PAIR}, {_MC} SELECT lang, c AS corrections, d AS regressions, round(p, 6) AS p FROM mc")
def t13_mcnemar(spark, sf_dir):
    return rounded(stats.paired(_both(spark, sf_dir), ["lang"]).select("lang", "corrections", "regressions", "p"))


@query(f"WITH {_PAIR}, {_MC}, o AS (SELECT lang, p, row_number() OVER (ORDER BY p, lang) AS k, count(*) OVER () AS n FROM mc) SELECT lang AS name, round(max(least(1.0, (n - k + 1) * p)) OVER (ORDER BY k), 6) AS holm_p FROM o")
def m10_holm(spark, sf_dir):
    return rounded(stats.holm(stats.paired(_both(spark, sf_dir), ["lang"]).withColumnRenamed("lang", "name")).select("name", "holm_p"))


@query()
def m09_bootstrap_ci(spark, sf_dir):
    c = stats.cluster_means(_both(spark, sf_dir), "source").withColumn("name", F.lit("all")).withColumn("__order", F.col("source"))
    return rounded(stats.bootstrap(c, "mean_difference"))


@query(f"""WITH {_PAIR}, c AS (SELECT row_number() OVER (ORDER BY source) - 1 AS k, avg(m - v) AS v FROM u GROUP BY source), n AS (SELECT count(*) AS n FROM c),
    draws AS (SELECT b, i, ('0x' || substr(sha256('7:' || b || ':' || i), 1, 13))::BIGINT % n AS k FROM n, range(200) x(b), range(0, (SELECT n FROM n)) y(i)),
    means AS (SELECT b, avg(v) AS mean FROM draws JOIN c USING (k) GROUP BY b) SELECT round(quantile_cont(mean, 0.025), 6) + 0.0 AS low, round(quantile_cont(mean, 0.975), 6) + 0.0 AS high FROM means""")
def m09_bootstrap_hashed(spark, sf_dir):
    c = stats.cluster_means(_both(spark, sf_dir), "source")
    return rounded(stats.bootstrap_hashed(c.withColumn("k", F.row_number().over(Window.partitionBy().orderBy("source")) - 1), "mean_difference"))


@query(f"WITH {_PAIR}, {_MC} SELECT m.lang AS name, round(a.acc, 6) AS accuracy, round(p, 6) AS p FROM mc m JOIN (SELECT lang, avg(m) AS acc FROM u GROUP BY lang) a USING (lang)")
def m11_campaign_analysis(spark, sf_dir):
    out = stats.holm(stats.paired(_both(spark, sf_dir), ["lang"]).withColumnRenamed("lang", "name"))
    return rounded(out.select("name", F.col("method_accuracy").alias("accuracy"), "p"))


@query("SELECT user_id, event_id, count(*) OVER w AS completed, round(avg(CASE WHEN event_type = 'click' THEN 1.0 WHEN event_type = 'view' THEN 0.0 END) OVER w, 6) AS running_accuracy, round(avg(value) OVER w, 8) AS mean_sampled FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def k05_running_progress(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("correct", F.when(F.col("event_type") == "click", 1.0).when(F.col("event_type") == "view", 0.0)).withColumn("sampled", F.col("value"))
    return rounded(stats.running_progress(e, ["ts", "event_id"], "user_id").select("user_id", "event_id", "completed", "running_accuracy", "mean_sampled"), mean_sampled=8)


@query("SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def m13_status(spark, sf_dir):
    return rounded(stats.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"]))


def _orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("id", F.col("o_orderkey"))
    seed, base = (F.col("o_custkey") % 5).alias("seed"), F.lit("m").alias("base_model")
    vanilla = o.select("id", seed, base, (F.col("o_totalprice") % 1000).cast("long").alias("tokens_generated"))
    span = F.col("o_custkey") % 90
    events = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.struct((F.lit(200) + span).cast("long").alias("token_pos"), F.lit(200).cast("long").alias("rollback_pos"), F.lit(None).cast("long").alias("alert_rollback_pos")))).otherwise(F.array().cast("array<struct<token_pos:bigint,rollback_pos:bigint,alert_rollback_pos:bigint>>"))
    controlled = o.select("id", seed, base, span.cast("double").alias("extra_sampled"), events.alias("backtracks"), (F.col("o_totalprice") % 1000).cast("long").alias("decode_events"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("alarms"))
    return vanilla, controlled


def _line_no():
    """A line item's place in its source: line numbers alone aren't unique."""
    return F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("line_no")


@query("SELECT count(*) AS num_examples, round(avg(o_custkey % 90), 6) AS mean_extra_decode_tokens, round(avg(CAST(floor(o_totalprice % 1000) AS BIGINT)), 6) AS mean_vanilla_tokens_generated, round(avg(CAST(floor(o_totalprice % 1000) AS BIGINT)), 6) AS mean_decode_events, round(avg(CAST(o_orderkey % 3 = 0 AS INT)), 6) AS activation_rate, round(avg(CAST(o_orderkey % 3 = 0 AS INT)), 6) AS mean_backtracks FROM orders")
def b01_profile(spark, sf_dir):
    return rounded(budget.profile(budget.templates(*_orders(spark, sf_dir), ["base_model"])))


@query("SELECT o_orderkey AS id, CAST(greatest(1, o_custkey % 90) AS BIGINT) AS rollback_length FROM orders WHERE o_orderkey % 3 = 0")
def b01_rollback_lengths(spark, sf_dir):
    t = budget.templates(*_orders(spark, sf_dir), ["base_model"])
    return t.select("id", F.explode("rollback_lengths").alias("rollback_length"))


@query("SELECT 0::BIGINT AS unpaired, 0::BIGINT AS mismatched, 1::BIGINT AS conditions")
def b01_pairing_errors(spark, sf_dir):
    v, c = _orders(spark, sf_dir)
    return budget.pairing_errors(v, c, budget.templates(v, c, ["base_model"]), ["base_model"])


@query("SELECT l_orderkey AS id, CAST(l_suppkey AS BIGINT) AS seed, CAST(l_quantity AS BIGINT) AS decode_events, CAST(floor(CAST(l_quantity AS BIGINT) * (1::DOUBLE + 0.1::DOUBLE)) AS BIGINT) AS max_decode_events FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 2, l_linenumber, l_partkey, l_suppkey, l_quantity) = 1")
def b02_per_id_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("seed"), F.lit(None).cast("long").alias("token_events_trace"), F.col("l_quantity").cast("long").alias("decode_token_events_total"), F.lit(1).cast("long").alias("tokens_generated"), (F.col("l_linenumber") % 2).alias("src_ord"), _line_no())
    return budget.per_id(rows)


@query("WITH x AS (SELECT o_orderkey, list_filter([o_custkey % 4, o_custkey % 3], lambda s: s > 0) AS spans, o_custkey % 7 AS deleted FROM orders) SELECT count(*) AS num_examples, round(avg(deleted), 6) AS mean_extra_decode_tokens, round(avg(CAST(len(spans) > 0 AS INT)), 6) AS activation_rate, round(avg(len(spans)), 6) AS mean_backtracks FROM x")
def b03_campaign_profile(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return rounded(budget.campaign_profile(o.select(F.array(F.col("o_custkey") % 4, F.col("o_custkey") % 3).alias("spans"), (F.col("o_custkey") % 7).alias("deleted"))))


@query()
def b04_assigned_template(spark, sf_dir):
    order = udfs.shuffled(10, udfs.stable_seed(SEED, "int4", "budget-profile"))
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    return rows.withColumn("template", F.get(F.array(*map(F.lit, order)), (F.col("c_custkey") % 10).cast("int")))


@query()
def b05_random_schedule(spark, sf_dir):
    t = budget.templates(*_orders(spark, sf_dir), ["base_model"]).where("backtrack_count > 0")
    return budget.random_schedule(t.select("id", "rollback_lengths", "reference_primary_tokens"), SEED)


@query("SELECT o_orderkey AS id, i AS k, greatest(64, CAST(floor((i + 1) * greatest(65, CAST(floor(o_totalprice % 1000) AS BIGINT)) / 3.0) AS BIGINT)) AS trigger_at, CASE WHEN i = 0 THEN 8 ELSE greatest(1, o_custkey % 90) END AS rollback_tokens FROM orders, range(2) r(i)")
def b06_periodic_schedule(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = budget.periodic(F.array(F.lit(8).cast("long"), F.col("o_custkey") % 90), (F.col("o_totalprice") % 1000).cast("long"))
    return rounded(o.select(F.col("o_orderkey").alias("id"), F.posexplode(s).alias("k", "e")).select("id", "k", "e.*"))


@query()
def b07_restart_subset(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") - 1).alias("index"))
    return budget.restart_subset(rows, "index", 30.0, 200.0, SEED, "int4").select("c_custkey")


@query("SELECT o_orderstatus, greatest(1, CAST(round_even(avg(o_custkey % 90), 0) AS BIGINT)) AS revision_budget, least(count(*), CAST(greatest(0, round_even(count(*) * avg(o_custkey % 90) / greatest(1.0, avg(o_totalprice)), 0)) AS BIGINT)) AS restarts FROM orders GROUP BY o_orderstatus")
def b08_revision(spark, sf_dir):
    extra = F.avg(F.col("o_custkey") % 90)
    out = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(extra.alias("extra"), F.count("*").alias("n"), F.avg("o_totalprice").alias("plain"))
    return out.select("o_orderstatus", budget.revision_budget(F.col("extra")).alias("revision_budget"), budget.restart_count(F.col("n"), F.col("extra"), F.col("plain")).alias("restarts"))


@query("SELECT o_orderkey AS id, n AS budget FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def b09_lookup(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").where("l_linenumber > 2").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("budget"))
    return budget.lookup(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), b)


@query("SELECT l_orderkey AS id, CAST(l_suppkey AS BIGINT) AS seed FROM lineitem WHERE l_returnflag = 'N' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linestatus = 'F', l_linenumber, l_partkey, l_suppkey, l_quantity) = 1")
def s05_first_source_seed(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("method"), F.col("l_suppkey").alias("seed"), (F.col("l_linestatus") == "F").cast("int").alias("src_ord"), _line_no())
    return jsonl.seeds(rows, "N")


@query("SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM labels")
def s04_id_set(spark, sf_dir):
    """The ids of two files of JSON lines."""
    rows, folders = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), "quality"), [new_folder(spark), new_folder(spark)]
    for i, folder in enumerate(folders):
        rows.where(f"quality = {i}").unionByName(rows.where("quality = 1")).write.json(folder)
    return jsonl.ids(spark, folders)


_CANDS = "c AS (SELECT conv_id AS item_id, turn AS candidate, CASE WHEN length(text) % 4 = 0 THEN NULL ELSE role || (length(text) % 3) END AS answer, CASE WHEN length(text) % 5 = 0 THEN NULL ELSE -(length(text) % 17) END AS lp, length(text) AS n FROM conversations)"


def _cands(spark, sf_dir):
    n = F.length("text")
    answer = F.when(n % 4 == 0, None).otherwise(F.concat("role", (n % 3).cast("string")))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item_id"), F.col("turn").alias("candidate"), answer.alias("answer"), F.when(n % 5 == 0, None).otherwise((-(n % 17)).cast("double")).alias("mean_logprob"), n.cast("long").alias("sampled"), (n / 100).alias("seconds"), n.cast("long").alias("vram"))


@query(f"WITH {_CANDS}, v AS (SELECT item_id, answer, count(*) AS n, min(candidate) AS first FROM c WHERE answer IS NOT NULL GROUP BY ALL), b AS (SELECT item_id, first FROM v QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, first) = 1) SELECT i.item_id, coalesce(first, 0) AS chosen FROM (SELECT DISTINCT item_id FROM c) i LEFT JOIN b USING (item_id)")
def g10_majority_answer(spark, sf_dir):
    return candidates.majority(_cands(spark, sf_dir))


@query(f"WITH {_CANDS} SELECT item_id, candidate AS chosen FROM c QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY coalesce(lp, -1e300) DESC, candidate) = 1")
def g11_best_logprob(spark, sf_dir):
    return candidates.best_logprob(_cands(spark, sf_dir))


@query(f"WITH {_CANDS} SELECT item_id, CAST(sum(n) AS BIGINT) AS sampled, round(sum(n / 100), 4) AS seconds, CAST(max(n) AS BIGINT) AS vram FROM c GROUP BY item_id")
def g12_rollup(spark, sf_dir):
    return rounded(candidates.rollup(_cands(spark, sf_dir)), 4)


@query()
def g09_candidate_seeds(spark, sf_dir):
    return candidates.expand(items_of(spark, sf_dir).select("item_id", "item_seed"), 3)


_EV = "ev AS (SELECT user_id AS run_id, event_id AS pos, CASE event_type WHEN 'click' THEN 'backtrack' WHEN 'view' THEN 'alarm' ELSE 'token' END AS type, CAST(floor(abs(value)) AS BIGINT) AS span FROM events)"


def _events(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "backtrack").when(F.col("event_type") == "view", "alarm").otherwise("token")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("pos"), kind.alias("type"), F.floor(F.abs("value")).cast("long").alias("span"))


@query(f"WITH {_EV} SELECT run_id, count_if(type = 'token') AS sampled, CAST(coalesce(sum(span) FILTER (type = 'backtrack'), 0) AS BIGINT) AS deleted, count_if(type = 'alarm') AS alarms, count_if(type = 'backtrack') AS rerolls, max(pos) AS last, count_if(type = 'token') - CAST(coalesce(sum(span) FILTER (type = 'backtrack'), 0) AS BIGINT) AS emitted FROM ev GROUP BY run_id")
def g13_accounting(spark, sf_dir):
    return rounded(candidates.accounts(_events(spark, sf_dir)))


@query(f"WITH {_EV} SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY pos) - 1 AS k, pos, span FROM ev WHERE type = 'backtrack'")
def g13_spans(spark, sf_dir):
    return rounded(candidates.spans(_events(spark, sf_dir)))


@query(f"WITH {_RUNS} SELECT doc_id, CASE WHEN toxic = 1 THEN true WHEN quality = 1 THEN n_chars >= 1000 ELSE false END AS truncated FROM runs")
def g15_truncation(spark, sf_dir):
    rows = _runs(spark, sf_dir).select("doc_id", F.when(F.col("toxic") == 1, "max_new_tokens").when(F.col("quality") == 0, "eos").alias("termination_reason"), F.lit(False).alias("eos"), F.col("n_chars").alias("n_tokens"))
    return candidates.truncated(rows, 1000).select("doc_id", "truncated")


@query("SELECT doc_id AS item_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def k04_resume_pending(spark, sf_dir):
    return store.pending(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id")))


_FORMS = ", ".join("'" + f.replace("'", "''") + "'" for f in jsonl.FORMS)


@query(f"SELECT 'sample-' || lpad(CAST(i AS VARCHAR), 4, '0') AS id, replace(replace(replace([{_FORMS}][i % 10 + 1], '{{a}}', CAST(12 + (i * 7) % 89 AS VARCHAR)), '{{b}}', CAST(3 + (i * 5) % 47 AS VARCHAR)), '{{c}}', CAST(20 + (i * 11) % 180 AS VARCHAR)) AS prompt FROM range(100) r(i)")
def k07_prompt_templates(spark, sf_dir):
    return jsonl.sample_prompts(spark, 100)


@query("""SELECT o_orderkey AS key, CAST(o_orderkey * 3 AS VARCHAR) AS expected, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey ELSE o_orderkey * 3 END AS VARCHAR) END AS actual FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 4 = 0
    UNION ALL SELECT -1 - o_orderkey, NULL, 'new' FROM orders WHERE o_orderkey % 6 = 0""")
def p21_environment_differences(spark, sf_dir):
    """Two tables of settings that differ: values that changed, that are gone and that are new."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    expected = o.select("key", (F.col("key") * 3).cast("string").alias("value"))
    actual = o.where("key % 5 <> 0").select("key", F.when(F.col("key") % 4 == 0, F.col("key")).otherwise(F.col("key") * 3).cast("string").alias("value"))
    actual = actual.unionByName(o.where("key % 6 = 0").select((-1 - F.col("key")).alias("key"), F.lit("new").alias("value")))
    return store.differences(expected, actual).select("key", "expected", "actual")


STREAM = Config(window=WindowConfig(size=8, stride=4, ngram_min=2, ngram_max=3), detector=DetectorConfig(threshold=20.0, refractory=1))
POOLS = {"0-512": [0.1 * i for i in range(40)]}


def stream_tokens(events: DataFrame) -> DataFrame:
    """Events of a user as tokens: the type and value's class is the token, the value its log probability and entropy."""
    code = (F.ascii("event_type") + F.floor(F.abs("value") / 20)) % 12
    return events.select(F.col("user_id").cast("string").alias("run_id"), code.cast("int").alias("token"), (-F.abs("value") / 100).alias("logprob"), (F.abs("value") / 50).alias("entropy"), "event_id")


def positioned(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("pos", (F.row_number().over(Window.partitionBy("run_id").orderBy("event_id")) - 1).cast("long"))


_LM = """lm AS (SELECT CAST(user_id AS VARCHAR) AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, CAST((ascii(event_type) + CAST(floor(abs(value) / 20) AS BIGINT)) % 12 AS VARCHAR) AS token, -abs(value) / 100 AS logprob, abs(value) / 50 AS entropy FROM events)"""
_ONLINE = sequences.windows_sql(sequences.repeats_sql(f"{_LM}, grams AS ({' UNION ALL '.join(map(sequences.gram_sql, (2, 3)))})"), 8, 4)


@query(f"""WITH {_ONLINE}, pool AS (SELECT 0.1::DOUBLE * i AS x FROM range(40) r(i)),
    ps AS (SELECT s.*, (1 + count(x)) / 41.0::DOUBLE AS p FROM scored s LEFT JOIN pool ON x >= score GROUP BY ALL),
    sums AS (SELECT *, sum({sequences.log_mixture_sql("p")}) OVER (PARTITION BY run_id ORDER BY window_index ROWS UNBOUNDED PRECEDING) AS total FROM ps),
    st AS (SELECT *, total - least(0.0, coalesce(min(total) OVER (PARTITION BY run_id ORDER BY window_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS e FROM sums),
    c AS (SELECT *, coalesce(max(CASE WHEN e <= 0 THEN window_index END) OVER (PARTITION BY run_id ORDER BY window_index ROWS UNBOUNDED PRECEDING), 0) AS cp FROM st)
    SELECT run_id, window_index, end_pos, round(score, 6) + 0.0 AS score, round(p, 6) AS p_value, round(e, 6) + 0.0 AS "logE", e >= ln(20) AS alarm, CASE WHEN e >= ln(20) THEN cp END AS changepoint, CASE WHEN e >= ln(20) THEN greatest(0, 4 * cp - 64) END AS rollback_pos FROM c""")
def g01_stream_monitor(spark, sf_dir):
    """The batch form of the stream (their equality is tested)."""
    return rounded(monitor.monitor_batch(positioned(stream_tokens(table(spark, sf_dir, "events"))), STREAM, POOLS))


@query()
def g01_generation_accounts(spark, sf_dir):
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("run_id"))
    return monitor.generate(runs, monitor.looping_source(), STREAM, POOLS, 120).drop("tokens")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'restart' WHEN 1 THEN 'self_correct' ELSE 'periodic_backtrack' END AS method, CAST(l_quantity AS BIGINT) AS f, CAST(l_suppkey % 40 AS BIGINT) AS s2, l_orderkey % 2 = 0 AS chosen, CASE WHEN l_orderkey % 5 = 0 THEN 30 END AS budget FROM lineitem),
    y AS (SELECT *, CASE WHEN method = 'restart' AND chosen THEN s2 WHEN method = 'self_correct' THEN least(s2, 20) ELSE 0 END AS wanted, least(f, coalesce(budget, f)) AS p FROM x), z AS (SELECT *, least(wanted, coalesce(budget - p, wanted)) AS extra FROM y)
    SELECT method, CAST(sum(p) AS BIGINT) AS primary_tokens, CAST(sum(extra) AS BIGINT) AS extra_tokens, CAST(sum(CASE WHEN method = 'restart' AND extra > 0 THEN extra ELSE p + extra END) AS BIGINT) AS final_tokens, count_if(p < f OR extra < wanted) AS exhausted FROM z GROUP BY method""")
def g08_matched_baselines(spark, sf_dir):
    n = F.col("l_linenumber") % 3
    method = F.when(n == 0, "restart").when(n == 1, "self_correct").otherwise("periodic_backtrack")
    rows = table(spark, sf_dir, "lineitem").select(method.alias("method"), F.col("l_quantity").cast("long").alias("first_tokens"), (F.col("l_suppkey") % 40).cast("long").alias("second_tokens"), (F.col("l_orderkey") % 2 == 0).alias("chosen"), F.when(F.col("l_orderkey") % 5 == 0, F.lit(30)).alias("budget"))
    out = budget.matched_accounts(rows, 20)
    return out.groupBy("method").agg(F.sum("primary_tokens_generated").alias("primary_tokens"), F.sum("extra_decode_tokens").alias("extra_tokens"), F.sum("final_tokens_generated").alias("final_tokens"), F.count_if("exhausted").alias("exhausted"))
