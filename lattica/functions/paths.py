"""Predicates on file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders and endings of tests, and further names: marks before or behind, and declarations without code.
TEST_FOLDER = r"(?i:(^|/)(tests?|__tests__)(/|$))|(?i:\.(test|spec)\.[^/]+$)"
TEST_NAME = r"(^|/)test[_-][^/]*$|_test\.(py|go|rb)$|\.d\.ts$"


def is_test_path(path: Column, names: bool = True) -> Column:
    """Whether a path is a test's, whichever way its slashes lean; false for none.

    Class diagrams go by folders and endings alone; all else takes the further ``names`` too.
    """
    pattern = f"{TEST_FOLDER}|{TEST_NAME}" if names else TEST_FOLDER
    return F.coalesce(F.replace(path, F.lit("\\"), F.lit("/")).rlike(pattern), F.lit(False))
