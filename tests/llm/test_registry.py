from __future__ import annotations

import re

import __spark_entry__ as spark_entry


def test_each_operator_has_one_query():
    numbers = sorted(int(m[1]) for n in spark_entry.queries() if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 14))
    assert "pipeline" in spark_entry.queries()
