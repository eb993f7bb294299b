"""Item sources: tables of questions and answers as items with ids, seeded order and limits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def place(rows: DataFrame, order: str, seed: int | None) -> Column:
    """What rows are ordered by: the source's order, or a keyed hash of it (a shuffle that needs no generator's state)."""
    return F.col(order) if seed is None else F.struct(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(order).cast("string")), 256), order)


def items(rows: DataFrame, dataset: str, split: str, order: str, limit: int | None = None, seed: int | None = None, id: str | None = None, prefix: str | None = None) -> DataFrame:
    """Rows (question, answer) as items: id, dataset, split, question, answer, reference_answer, prompt.

    The first ones by place stay (none for a limit below 0, all for one beyond their number). A row whose id column is
    null, or a source without one, gets prefix-split-number. The limit is a top-k; only sources without ids and without
    a limit are numbered as a whole.
    """
    own = rows.withColumn("__place", place(rows, order, seed))
    own = own if limit is None else own.orderBy("__place").limit(max(0, limit))
    number = F.lpad((F.row_number().over(Window.orderBy("__place")) - 1).cast("string"), 6, "0")
    named = F.concat(F.lit(f"{prefix or dataset}-{split}-"), number)
    gsm = dataset == "gsm8k"
    return own.select(
        (named if id is None else F.coalesce(F.col(id).cast("string"), named)).alias("id"),
        F.lit(dataset).alias("dataset"),
        F.lit(split).alias("split"),
        "question",
        "answer",
        (C.reference_answer(F.col("answer")) if gsm else F.col("answer")).alias("reference_answer"),
        (C.gsm_prompt if gsm else C.math_prompt)(F.col("question")).alias("prompt"),
    )


def union_of(configs: Mapping[str, DataFrame], order: str, split: str = "train") -> DataFrame:
    """The rows of several configurations, in order of their names, with id (name:number), subject and split."""
    out: DataFrame | None = None
    for name in sorted(configs):
        number = (F.row_number().over(Window.orderBy(order)) - 1).cast("string")
        own = configs[name].withColumns({"id": F.concat(F.lit(f"{name}:"), number), "subject": F.lit(name), "split": F.lit(split)})
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no configurations")
    return out
