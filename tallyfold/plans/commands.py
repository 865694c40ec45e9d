"""The commands that stop at the first failed file, over listings with an ``error`` column.

The index goes on where a file fails (:func:`tallyfold.operators.index.run_index`); these do not, because a match or an audit
of a part of the files would mislead.  The failure is raised inside the plan, by the task that meets it: there is no
pass before the result.  A side that the plan need not read at all (the other one being empty) is not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import stop_at_failure
from ..operators import audit, match


def find(src: DataFrame, dest: DataFrame, exact: bool = False) -> DataFrame:
    return match.find_matches(stop_at_failure(src), stop_at_failure(dest), exact)


def diff(src: DataFrame, dest: DataFrame, exact: bool = False) -> DataFrame:
    return match.diff(stop_at_failure(src), stop_at_failure(dest), exact)


def missing(src: DataFrame, dest: DataFrame, exact: bool = False) -> DataFrame:
    return match.missing(stop_at_failure(src), stop_at_failure(dest), exact)


def validate(observed: DataFrame, files: DataFrame, images: DataFrame) -> DataFrame:
    """A file that is not recorded is passed over before it is read, so that its failure does not matter."""
    known = files.select("path", F.lit(True).alias("__recorded"))
    # The error counts where both sides meet, so that the check cannot move below the join.
    met = observed.join(known, "path", "left").withColumn("__error", F.when(F.col("__recorded"), F.col("error")))
    return audit.validate(stop_at_failure(met, "__error").drop("__recorded", "__error"), files, images)


def broken(content: DataFrame, images: DataFrame, redecoded: DataFrame) -> DataFrame:
    return audit.broken(stop_at_failure(content), images, redecoded)
