"""The data subject of an access request: one record of up to seven values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.functions import scalars as S
from veilmark.functions.patterns import SUBJECT_FIELDS


class SubjectError(ValueError):
    pass


def subject_values(subject: dict) -> list[str]:
    """Values to keep visible.  Name parts come from ``full_name`` unless given."""
    given = {k: str(subject.get(k) or "").strip() for k in SUBJECT_FIELDS}
    values = {v for v in given.values() if v}
    if not values:
        raise SubjectError("set at least one of: " + ", ".join(SUBJECT_FIELDS))
    parts = given["full_name"].split()
    if len(parts) >= 2:
        values.update(
            part for key, part in (("first_name", parts[0]), ("last_name", parts[-1])) if not given[key]
        )
    return sorted(values)


def subject_table(subjects: DataFrame) -> DataFrame:
    """Same rule for a table of subjects, as rows ``(value)``."""
    have = {k: S.strip(F.col(k).cast("string")) for k in SUBJECT_FIELDS if k in subjects.columns}
    filled = {k: F.nullif(v, F.lit("")) for k, v in have.items()}
    candidates = list(filled.values())
    if "full_name" in filled:
        name = filled["full_name"]
        for key, part in (("first_name", S.first_word(name)), ("last_name", S.last_word(name))):
            missing = filled[key].isNull() if key in filled else F.lit(True)
            candidates.append(F.when(S.is_multi_word(name) & missing, part))
    return (
        subjects.select(F.explode(F.array(*candidates)).alias("value"))
        .filter(F.col("value").isNotNull())
        .distinct()
    )
