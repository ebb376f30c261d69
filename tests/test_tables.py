"""Order of written tables, replaced tables, and selection by counting."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segpanel.operators import selection
from segpanel.operators.evaluate import top_k_capture
from segpanel.operators.selection import kth_places, place_of, with_place
from segpanel.sources import order, versions
from segpanel.sources.writers import write_parquet


# ---- order ---------------------------------------------------------------------------------------

def numbers(spark, n=1000):
    return spark.range(n).select(F.when(F.col("id") % 17 == 0, None).otherwise(F.col("id") % 91).alias("a"), F.col("id").alias("b"))


def test_sorted_write_is_in_total_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(order, "BLOCK_ROWS", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_parquet(numbers(spark), str(tmp_path / "t"), ["a", "b"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = order.order_report(spark, str(tmp_path / "t"), ["a", "b"], strict=True).collect()
    assert len(files) > 1 and sum(f.rows for f in files) == 1000
    assert not any(f.breaks or f.overlaps for f in files)
    want = sorted(numbers(spark).collect(), key=lambda r: (r.a is None, r.a, r.b) if r.a is not None else (True, 0, r.b))
    got = sorted(order.with_positions(spark, str(tmp_path / "t")).collect(), key=lambda r: r.position)
    assert [(r.a, r.b) for r in got] == [(r.a, r.b) for r in want] and [r.position for r in got] == list(range(1, 1001))


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_damage_is_seen(spark, tmp_path, monkeypatch, block):
    """Two rows swapped inside a file; two files in the wrong order; equal rows; nulls first."""
    monkeypatch.setattr(order, "BLOCK_ROWS", block)

    def write(name, *files):
        for rows in files:
            spark.createDataFrame([(x,) for x in rows], "a int").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        # Names of appended files begin alike, so they are put in the order given.
        parts = sorted((tmp_path / name).glob("part-*.parquet"), key=lambda p: p.stat().st_mtime_ns)
        for i, p in enumerate(parts):
            p.rename(tmp_path / name / f"part-{i:05d}-x.parquet")
            crc = p.with_name(f".{p.name}.crc")
            if crc.exists():
                crc.rename(tmp_path / name / f".part-{i:05d}-x.parquet.crc")
        return [(r.breaks, r.overlaps) for r in order.order_report(spark, str(tmp_path / name), ["a"]).orderBy("file_no").collect()]
    assert write("good", [1, 2, 2, 3, 4, 5, 6, 7], [7, 8, None, None]) == [(0, False), (0, False)]
    assert write("swapped", [1, 2, 3, 5, 4, 6, 7, 8]) == [(1, False)]
    assert write("files", [5, 6, 7], [1, 2, 3]) == [(0, False), (0, True)]
    assert write("nulls", [None, 1, 2]) == [(1, False)]
    strict = order.order_report(spark, str(tmp_path / "good"), ["a"], strict=True).orderBy("file_no").collect()
    assert [(r.breaks, r.overlaps) for r in strict] == [(1, False), (1, True)]
    total = order.in_order([("good", order.order_report(spark, str(tmp_path / "good"), ["a"])), ("files", order.order_report(spark, str(tmp_path / "files"), ["a"]))])
    assert {(r.name, r.rows, r.breaks, r.sound) for r in total.collect()} == {("good", 12, 0, True), ("files", 6, 1, False)}


def test_order_report_reads_the_sort_columns_alone(spark, tmp_path, plan):
    write_parquet(numbers(spark).withColumn("wide", F.lit("x" * 50)), str(tmp_path / "t"), ["a", "b"])
    text = plan(order.order_report(spark, str(tmp_path / "t"), ["a"]))
    assert "wide" not in text.split("ReadSchema:")[1].split("\n")[0]


# ---- versions ------------------------------------------------------------------------------------

def ids(df):
    return sorted(r.id for r in df.collect())


def test_replacing_leaves_readers_a_whole_table(spark, tmp_path):
    root = str(tmp_path / "t")
    assert versions.current(spark, root) is None
    with pytest.raises(FileNotFoundError):
        versions.read_table(spark, root)
    versions.replace_table(spark.range(10), root, ["id"])
    old = versions.read_table(spark, root)
    versions.replace_table(old.filter("id >= 5"), root, ["id"])  # from the table itself
    assert ids(old) == list(range(10)) and ids(versions.read_table(spark, root)) == list(range(5, 10))
    assert ids(versions.read_table(spark, root, 1)) == list(range(10))
    assert [v.number for v in versions.versions(spark, root)] == [1, 2]
    assert versions.read_table(spark, root, schema="id bigint").schema == T.StructType([T.StructField("id", T.LongType())])


def test_failed_write_leaves_the_old_table(spark, tmp_path):
    root = str(tmp_path / "t")
    versions.replace_table(spark.range(10), root, ["id"])
    broken = spark.range(0, 10_000, 1, 8).withColumn("id", F.when(F.col("id") == 9_999, F.raise_error(F.lit("torn")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="torn"):
        versions.replace_table(broken, root, ["id"])
    assert ids(versions.read_table(spark, root)) == list(range(10)) and versions.current(spark, root).number == 1
    versions.replace_table(spark.range(3), root, ["id"])
    assert ids(versions.read_table(spark, root)) == [0, 1, 2]
    # The folder of the failed write goes with the old versions.
    gone = versions.expire(spark, root, keep=1)
    assert len(gone) >= 1 and [v.number for v in versions.versions(spark, root)] == [2] and ids(versions.read_table(spark, root)) == [0, 1, 2]
    with pytest.raises(ValueError):
        versions.expire(spark, root, keep=0)


def test_second_writer_of_a_version_fails(spark, tmp_path):
    root = str(tmp_path / "t")
    versions.replace_table(spark.range(10), root, ["id"])
    versions.replace_table(spark.range(4), root, ["id"], after=1)
    with pytest.raises(versions.TableChanged):
        versions.replace_table(spark.range(7), root, ["id"], after=1)
    assert ids(versions.read_table(spark, root)) == [0, 1, 2, 3]
    assert not [p for p in (tmp_path / "t" / "versions").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


# ---- selection -----------------------------------------------------------------------------------

def cells(seed, n=400):
    random.seed(seed)
    out = []
    for i in range(n):
        group = random.choice(["a", "a", "a", "b", None])
        value = random.choice([0.0, 0.0, 1.0, -1.5, random.random() * 1000, random.random() * 1e-6, -random.random()])
        out.append((group, value, random.choice(["x", "y", None]), f"{i:04d}"))
    return out + [("one", 5.0, "x", "k")]


@pytest.mark.parametrize("limit", [1, 10, 1000])
@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 1.0])
def test_kth_places_equal_sorting(spark, limit, share):
    data = cells(int(share * 10))
    df = spark.createDataFrame(data, "g string, v double, c1 string, c2 string").repartition(5)
    places = kth_places(df, ["g"], "v", ["c1", "c2"], lambda n: F.greatest(F.lit(1), F.ceil(n * share)), limit)
    chosen = with_place(df, places, ["g"]).filter(place_of("v", ["c1", "c2"]) <= F.col("place")).select("g", "v", "c1", "c2")
    want = set()
    for g in {d[0] for d in data}:
        rows = sorted((d for d in data if d[0] == g), key=lambda d: (-d[1], d[2] is None, d[2] or "", d[3]))
        want |= set(rows[:max(1, -int(-len(rows) * share // 1))])
    assert {tuple(r) for r in chosen.collect()} == want


def test_top_k_capture_does_not_sort_the_cells(spark, plan, monkeypatch):
    monkeypatch.setattr(selection, "RANKED_ROWS", 2)
    rows = [("m", 1, f"{i:02d}", i % 7, float(i % 5)) for i in range(50)]
    df = spark.createDataFrame(rows, "method string, week int, c string, actual bigint, predicted double")
    out = top_k_capture(df, ["c"], "0.2")
    by = [sorted(rows, key=lambda r: (-r[at], r[2]))[:10] for at in (3, 4)]
    got = out.collect()[0]
    assert (got.avg_k, got.top_events, got.captured_events) == (10.0, sum(r[3] for r in by[0]), sum(r[3] for r in set(by[0]) & set(by[1])))
    assert "rangepartitioning" not in plan(out)
    assert top_k_capture(df.limit(0), ["c"]).collect() == []
