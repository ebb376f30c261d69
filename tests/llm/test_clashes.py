"""Operators that hand on all columns get every name that the package writes in quotes as an extra column."""

import pathlib
import re

import pytest
from pyspark.sql import functions as F

import segpanel.llm
from segpanel.llm.contamination import without_contaminated
from segpanel.llm.line_dedup import dedup_lines
from segpanel.llm.mixing import mix_sources
from segpanel.llm.quality_rules import keep_good
from segpanel.llm.sharding import shard_documents, uniform_tree
from segpanel.llm.similar_sets import one_of_each
from tests.llm.cases import documents

OWN = ("doc_id", "text", "lang", "source", "n_chars")


def names():
    source = "\n".join(p.read_text() for p in pathlib.Path(segpanel.llm.__file__).parent.glob("*.py"))
    found = {n.lower() for n in re.findall(r"[\"']([A-Za-z_][A-Za-z_0-9]{0,20})[\"']", source)}
    return sorted(found - set(OWN))


def others(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    return labels, bench


@pytest.mark.parametrize("name", ["dedup_lines", "mix_sources", "shard_documents", "keep_good", "one_of_each", "without_contaminated"])
def test_extra_columns_of_any_name(spark, name):
    labels, bench = others(spark)
    run, added = {
        "dedup_lines": (dedup_lines, ("n_lines", "n_exact", "n_near")), "mix_sources": (mix_sources, ("n_copies", "copy", "order_key")),
        "shard_documents": (lambda d: shard_documents(d, uniform_tree(5)), ("shard",)), "keep_good": (lambda d: keep_good(d, labels), ()),
        "one_of_each": (one_of_each, ()), "without_contaminated": (lambda d: without_contaminated(d, bench), ()),
    }[name]
    plain = documents(spark)
    extra = [n for n in names() if n not in added]
    assert len(extra) > 100
    wide = plain.withColumns({n: F.lit(f"own {n}") for n in extra})
    got = run(wide)
    assert got.columns == [*OWN, *extra, *added]
    rows = got.collect()
    assert all(r[n] == f"own {n}" for r in rows for n in extra)

    def key(r):
        return tuple(str(r[c]) for c in (*OWN, *added))
    assert sorted(map(key, rows)) == sorted(map(key, run(plain).collect()))
