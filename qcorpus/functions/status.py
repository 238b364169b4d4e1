"""Row-level status rules of corpus curation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: separator between a predicted SQL and its database id in the
# file the external execution-accuracy scorer reads.
PREDICTION_TAG = "\t----- bird -----\t"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Strip leading/trailing whitespace of every kind (Python ``str.strip``),
    not only spaces as SQL ``trim`` does."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def is_blank(c: Column | str) -> Column:
    return F.coalesce(strip_ws(_col(c)), F.lit("")) == ""


def check_required(sql: Column | str, db_id: Column | str) -> Column:
    """STRUCT(status, validation_error): rejected/MISSING_FIELD when the
    SQL or the database id is empty, else pending_validation."""
    missing = (F.coalesce(_col(sql), F.lit("")) == "") | (F.coalesce(_col(db_id), F.lit("")) == "")
    return F.struct(
        F.when(missing, F.lit("rejected")).otherwise(F.lit("pending_validation")).alias("status"),
        F.when(missing, F.lit("MISSING_FIELD")).alias("validation_error"),
    )


def apply_judgment(executed_ok: Column, parsed: Column) -> Column:
    """Status from an execution flag and a parsed judgment
    STRUCT(is_correct BOOLEAN, reasoning STRING) (null = nothing parsed).

    failed execution -> execution_failed; no parse -> judge_failed with
    judge_error generation_failed; is_correct or reasoning missing ->
    judge_failed / invalid_output_format; else valid_quality / invalid_quality.
    """
    no_parse = parsed.isNull()
    incomplete = parsed["is_correct"].isNull() | parsed["reasoning"].isNull()
    status = (F.when(~executed_ok, F.lit("execution_failed"))
              .when(no_parse | incomplete, F.lit("judge_failed"))
              .when(parsed["is_correct"], F.lit("valid_quality"))
              .otherwise(F.lit("invalid_quality")))
    error = (F.when(~executed_ok, F.lit(None).cast("string"))
             .when(no_parse, F.lit("generation_failed"))
             .when(incomplete, F.lit("invalid_output_format")))
    return F.struct(status.alias("status"), error.alias("judge_error"))


def accuracy_band(accuracy_pct: Column | str) -> Column:
    """<50 warning, >=80 excellent, otherwise good."""
    a = _col(accuracy_pct)
    return F.when(a < 50, "warning").when(a >= 80, "excellent").otherwise("good")


def tag_prediction(sql: Column | str, db_id: Column | str) -> Column:
    """``sql<TAB>----- bird -----<TAB>db_id`` for the external scorer."""
    return F.concat(_col(sql), F.lit(PREDICTION_TAG), _col(db_id))
