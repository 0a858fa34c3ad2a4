"""Classes of tasks by their wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of each class; the first class with one of its words in the task wins.
TASK_WORDS = [
    ("code_review", r"review|current changes|diff|pr|pull request"),
    ("impact_analysis", r"impact|impacted|affected|blast radius|what files"),
    ("test_generation", r"test|tests|spec|coverage"),
    ("explain_flow", r"explain|flow|trace|walk through|how does|what is|what are|what does|what's|whats|purpose|used for|use of|describe|overview|tell me about"),
    ("bug_fix", r"fix|bug|broken|error|issue|failing|failure|regression"),
]


def task_type(task: Column) -> Column:
    """The class of a task; words are bounded by anything but ASCII letters, digits and underscores."""
    low, found = F.lower(F.coalesce(task, F.lit(""))), F.lit("feature_change")
    for name, words in reversed(TASK_WORDS):
        found = F.when(low.rlike(rf"(?<![A-Za-z0-9_])({words})(?![A-Za-z0-9_])"), name).otherwise(found)
    return found
