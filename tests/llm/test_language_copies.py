"""The sample of a language that is made of copies for the most part."""

from __future__ import annotations

import pytest

from glyphweave.llm.language import SAMPLE_ROWS, fit


def word(k):
    return "".join(chr(97 + k // 26**j % 26) for j in range(4))


@pytest.mark.parametrize(("groups", "copies", "singles"), [(3, 5000, 300), (20, 2000, 5000), (1, 10_000, 0)])
def test_copies_count_once(spark, groups, copies, singles):
    rows = spark.range(groups * copies + singles).selectExpr(f"CASE WHEN id < {groups * copies} THEN id % {groups} ELSE id END AS k")
    words = "array_join(transform(sequence(0, 3), j -> char(97 + cast(k div cast(pow(26, j) AS long) AS long) % 26)), '')"
    content = fit(rows.selectExpr(f"{words} AS text", "'xx' AS lang"))["xx"].decode().split()
    every = {word(k) for k in [*range(groups), *range(groups * copies, groups * copies + singles)]}
    assert len(content) == len(set(content)) == min(SAMPLE_ROWS, len(every)) and set(content) <= every
