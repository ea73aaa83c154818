"""A looser pattern finds its span in a text that holds nothing else."""

import pytest

from lmdata.llm import pii

ALONE = [
    ("email", "write to anna [AT] example [DOT] com"),
    ("email", "write to anna AT example DOT com"),
    ("email", "write to anna (at) example.com"),
    ("email", "write to anna at example dot com"),
    ("ip", "host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 is up"),
    ("card", "paid by 3782 822463 10005 today"),
    ("phone", "call (415) 555-2671 now"),
    ("phone", "call 415.555-2671 now"),
]


@pytest.mark.parametrize("kind, text", ALONE)
def test_loose_pattern_alone(spark, kind, text):
    row = pii.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert {k: len(row[f"c_{k}"]) for k in pii.KINDS} == {k: int(k == kind) for k in pii.KINDS}
