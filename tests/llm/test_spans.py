"""Matches of a pattern in texts with any number of them."""

import re

import pytest
from pyspark.sql import functions as F

from duetframe.llm import common


@pytest.mark.parametrize("group", [None, 1])
def test_spans_of_many_matches(spark, monkeypatch, group):
    monkeypatch.setattr(common, "RUN", 7)
    pattern = "([a-zé]+)@x"
    texts = ["", "é no", "é@x", *(" é".join(f"{'ab'[k % 2]}@x" for k in range(n)) + "!" for n in (6, 7, 8, 14, 50, 500)), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["s"] for r in df.select("i", common.find_spans(F.coalesce("t", F.lit("")), pattern, group=group).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i]] == [(m.start(), m.end(), m.group(group or 0)) for m in re.finditer(pattern, t or "")]
