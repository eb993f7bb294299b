"""Scores of answers, by the kind of data set that an item comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import udfs


def score(rows: DataFrame) -> DataFrame:
    """rows (dataset, text, reference) with reference_answer, prediction_answer, correct, answer_extraction_ok and reference_extraction_ok.

    math500 compares normal forms; gsm8k, and any other data set's row that has a reference, compares
    numbers; rows of other data sets without a reference aren't scored, and all five are null.
    """
    math = F.coalesce(F.col("dataset") == "math500", F.lit(False))
    scored = math | F.coalesce(F.col("dataset") == "gsm8k", F.lit(False)) | F.col("reference").isNotNull()
    want = F.when(math, udfs.normalize_math("reference")).when(scored, C.reference_answer(F.col("reference")))
    got = F.when(math, udfs.normal_math_answer("text")).when(scored, C.model_answer(F.col("text")))
    out = rows.withColumns({"reference_answer": want, "prediction_answer": got})
    right = F.when(scored, F.coalesce(F.col("reference_answer") == F.col("prediction_answer"), F.lit(False)).cast("double"))
    return out.withColumns({"correct": right, "answer_extraction_ok": F.when(scored, F.col("prediction_answer").isNotNull()), "reference_extraction_ok": F.when(scored, F.col("reference_answer").isNotNull())})
