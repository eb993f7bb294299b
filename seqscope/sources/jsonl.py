"""Line-delimited JSON: traces, prompts, result rows, id and seed lists; and their sinks.

Schemas are explicit. Where a row's place in its source matters, lines are numbered by two levels:
the splits' line counts, and places within a split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import remove, save

TRACE = "run_id string, prompt_tokens array<int>, tokens array<struct<token_id:int,logits:array<double>>>"
PROMPT = "id string, prompt string, question string, input string, answer string"
RESULT = "id string, method string, precision string, base_model string, dataset string, threshold_path string, seed long, tokens_generated long, token_events_trace long, decode_token_events_total long, extra_sampled double, correct double, answer_extraction_ok boolean, latency double, line_no long"
EVENT = "run_id string, type string, pos long, token_id int, entropy double, logprob double, window_index long, start_pos long, end_pos long, score double, p_value double, logE double, alert boolean, rollback_pos long, rollback_span long, timestamp double"


def scan(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped. Broken lines are errors if strict, else left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, line_no): all lines, blank ones too, by files' names, numbered from 0.

    A split's rows have rising ids; the splits' counts, a row a split, give each one's first number.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "start", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return lines.join(splits, ["file", "start"]).select("value", (F.col("base") + F.col("id") - F.col("low")).alias("line_no"))


def parsed(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Rows of JSON lines with line_no; blank lines are skipped but numbered, broken lines are errors."""
    rows = numbered(spark, path).where(F.trim("value") != "")
    return rows.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), "line_no").select("r.*", "line_no")


def traces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(run_id, pos, token, logits) of a trace file; a run without an id has its line's number."""
    rows = parsed(spark, path, TRACE).withColumn("run_id", F.coalesce("run_id", F.col("line_no").cast("string")))
    out = rows.select("run_id", F.posexplode("tokens").alias("pos", "t"))
    bad = F.col("t.logits").isNull()
    logits = F.when(bad, F.raise_error(F.concat(F.lit("a token without logits in run "), F.col("run_id"))).cast("array<double>")).otherwise(F.col("t.logits"))
    return out.select("run_id", F.col("pos").cast("long").alias("pos"), F.col("t.token_id").alias("token"), logits.alias("logits"))


def prompts(spark: SparkSession, path: str | list[str], limit: int | None = None) -> DataFrame:
    """(id, prompt, answer): the first of prompt, question and input that isn't empty; rows without any are left out.

    The limit takes the first ones in the source's order. A row without an id has the number of prompts
    before it, so only sources that lack ids are ranked as a whole.
    """
    filled = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("prompt", "question", "input")])
    out = parsed(spark, path, PROMPT).select("id", filled.alias("prompt"), "answer", "line_no").where("prompt is not null")
    out = out if limit is None else out.orderBy("line_no").limit(max(0, limit))
    if out.where("id is null").limit(1).count():
        out = out.withColumn("id", F.coalesce("id", (F.row_number().over(Window.orderBy("line_no")) - 1).cast("string")))
    return out.select("id", "prompt", "answer")


def results(spark: SparkSession, paths: Sequence[str], schema: str = RESULT) -> DataFrame:
    """Result rows of several sources with src_ord, the source's place in the list."""
    out: DataFrame | None = None
    for i, path in enumerate(paths):
        rows = scan(spark, path, schema).withColumn("src_ord", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no sources")
    return out


def ids(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Different ids of JSON lines; a broken line is an error."""
    return scan(spark, paths, "id string").select("id").distinct()


def seeds(rows: DataFrame, method: str = "vanilla", precision: str | None = None) -> DataFrame:
    """(id, seed) of a method's rows: the first in source order."""
    own = rows.where(F.col("method") == method)
    own = own if precision is None else own.where(F.col("precision") == precision)
    return own.groupBy("id").agg(F.min_by("seed", F.struct("src_ord", "line_no")).alias("seed"))


def token_events(spark: SparkSession, path: str, runs: DataFrame, fallback: str = "tokens_generated") -> DataFrame:
    """runs with token_events: the token events in the trace, without broken lines, or the fallback where a run has none."""
    counted = scan(spark, path, EVENT, strict=False).where("type = 'token'").groupBy("run_id").agg(F.count("*").alias("__n"))
    return runs.join(counted, "run_id", "left").withColumn("token_events", F.coalesce("__n", fallback)).drop("__n")


def rename(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The generic item source: our names from the source's by a field map."""
    return rows.select(*[F.col(there).alias(here) for here, there in fields.items()])


def revision_of(revision: str) -> str:
    """An immutable revision; a placeholder or a branch name is an error."""
    if revision.startswith("REPLACE_") or not revision or revision in ("main", "master"):
        raise ValueError("a source needs an immutable revision")
    return revision


def write_events(events: DataFrame, path: str, mode: str = "error") -> None:
    """Token, window and backtrack events as JSON lines, without a model's cache."""
    events.drop("cache").write.mode(mode).json(path)


FEATURES = "run_id string, features struct<window_index:long,start_pos:long,end_pos:long,mean_entropy:double,mean_logprob:double,repetition_rate:double,confident_loop:double,local_pos:double,local_neg:double>, score double"


def write_features(windows: DataFrame, path: str, mode: str = "error", compression: str | None = None) -> None:
    """Window features as JSON lines: run_id, features and score. compression: a codec such as gzip."""
    names = [f.split(":")[0] for f in FEATURES[FEATURES.index("<") + 1 : FEATURES.index(">")].split(",")]
    windows.select(F.col("run_id").cast("string").alias("run_id"), F.struct(*names).alias("features"), "score").write.mode(mode).json(path, compression=compression)


def features(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Windows of feature lines: run_id, the features' columns and score."""
    return scan(spark, path, FEATURES).select("run_id", "features.*", "score")


def take_events(spark: SparkSession, path: str) -> DataFrame:
    """A trace's events, which are then removed from where they were: they are written to a table of our own first."""
    rows = save(scan(spark, path, EVENT))
    remove(spark, path)
    return rows


#: The forms of sample prompts.
FORMS = (
    "Solve step by step. A train leaves city A at {a} km/h and another leaves city B at {b} km/h. They are {c} km apart and travel toward each other. When do they meet?",
    "Solve step by step. A shop discounts an item by {a}% and then adds {b}% tax. If the original price is {c} euros, what is the final price?",
    "Solve step by step. A rectangle has perimeter {a} and one side is {b}. What is its area?",
    "Solve step by step. A recipe uses {a} grams of flour for {b} servings. How much flour is needed for {c} servings?",
    "Solve step by step. A number is multiplied by {a}, then {b} is added, giving {c}. What was the original number?",
    "Solve step by step. A tank is filled by one pipe in {a} hours and another in {b} hours. How long do they take together?",
    "Solve step by step. A class has {a} students. {b}% are absent today. How many students are present?",
    "Solve step by step. A sequence starts at {a} and increases by {b} each term. What is the {c}th term?",
    "Solve step by step. A cyclist travels {a} km in {b} hours, then {c} km in 1 hour. What is the average speed?",
    "Solve step by step. A bag contains {a} red balls, {b} blue balls, and {c} green balls. What is the probability of drawing a blue ball?",
)


def sample_prompts(spark: SparkSession, n: int) -> DataFrame:
    """(id, prompt): n arithmetic prompts over numbers that follow from their place, whose id is sample- and four digits."""
    x = F.col("id")
    values = {"a": 12 + (x * 7) % 89, "b": 3 + (x * 5) % 47, "c": 20 + (x * 11) % 180}
    text = F.element_at(F.array(*map(F.lit, FORMS)), (x % len(FORMS) + 1).cast("int"))
    for name, value in values.items():
        text = F.replace(text, F.lit(f"{{{name}}}"), value.cast("string"))
    place = x.cast("string")
    return spark.range(n).select(F.concat(F.lit("sample-"), F.lpad(place, 4, "0") if n <= 10_000 else F.when(x < 10_000, F.lpad(place, 4, "0")).otherwise(place)).alias("id"), text.alias("prompt"))
