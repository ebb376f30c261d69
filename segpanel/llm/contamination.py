"""Benchmark decontamination by winnowing.

The hashes of all runs of ``gram`` words are laid out in the order of the text, and in every window of
``span - gram + 1`` of them the smallest is kept: two texts that share ``span`` words in a row keep the same hash inside
the shared run, so no such run is missed, while only about two of ``span - gram + 2`` hashes are compared. Kept
hashes of documents are joined with those of the benchmark items. Each hit is then extended: the runs of ``span`` words around it
are looked up among the items' runs and compared word by word. An item with fewer words than ``span`` is one
run, as long as the item; runs of these few lengths are looked up as they are (a window of one hash).

A text leaves its row as hashes only. Texts with a hit are read again, one row for each distinct text, and just these
are extended. Runs of the benchmark are made distinct before they meet the documents, so a place in a text
meets one run at most, however many items hold it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segpanel.llm.stage import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tables that bear at most so many rows of under 100 bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 300_000
_KEY = ["k1", "k2"]


def lower_ascii(text: Column) -> Column:
    """A-Z as a-z, all other letters as they are."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_keys(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes that name a text."""
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("text"), text).alias("k2")


def with_words(rows: DataFrame, text: str) -> DataFrame:
    """Add ``words``; null and empty texts have none."""
    cut = rows.withColumn("_cut", F.split(lower_ascii(F.coalesce(text, F.lit(""))), NO_WORD, -1))
    head = (F.get("_cut", F.lit(0)) == "").cast("int")
    tail = ((F.size("_cut") > 1) & (F.get("_cut", F.size("_cut") - 1) == "")).cast("int")
    return cut.withColumn("words", F.slice("_cut", head + 1, F.size("_cut") - head - tail)).drop("_cut")


def _shifted(a: str, b: str, step: int, f: Callable[[Column, Column], Column]) -> Column:
    """f of each element of ``a`` and the one of ``b`` that is ``step`` places on."""
    n = F.greatest(F.size(b) - step, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(step + 1), n), f)


def with_grams(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """Add ``_g<k>`` for each of ``sizes``: the hash of the ``k`` words from each place on, by doubling."""
    done = {1}
    rows = rows.withColumn("_g1", F.transform("words", lambda w: F.xxhash64(w)))

    def need(k: int) -> None:
        nonlocal rows
        if k not in done:
            low = 1 << (k - 1).bit_length() - 1
            need(low)
            need(k - low)
            rows = rows.withColumn(f"_g{k}", _shifted(f"_g{low}", f"_g{k - low}", low, lambda x, y: F.xxhash64(x, y)))
            done.add(k)
    for k in sizes:
        need(k)
    return rows


def with_minima(rows: DataFrame, gram: int, width: int) -> DataFrame:
    """Add ``_min``: the smallest of each ``width`` gram hashes in a row."""
    rows, now = rows.withColumn("_min", F.col(f"_g{gram}")), 1
    while now < width:
        step = min(now, width - now)
        rows, now = rows.withColumn("_min", _shifted("_min", "_min", step, lambda x, y: F.least(x, y))), now + step
    return rows


def _short(h: Column, size: int) -> Column:
    """Hashes of whole short items are told apart from grams and from other sizes."""
    return F.xxhash64(h, F.lit(size))


def _all_short(grams: str, size: int) -> Column:
    return F.transform(grams, lambda h: _short(h, size))


def item_runs(benchmark: DataFrame, span: int) -> DataFrame:
    """item_id, size, h, ws: every run of ``span`` words of each item, or the whole of a shorter one; and the hash of its words."""
    items = with_words(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text"), "text")
    items = items.filter(F.size("words") > 0).select("item_id", "words")
    n = F.size("words")
    starts = F.sequence(F.lit(0), F.greatest(n - span, F.lit(0)))
    runs = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, F.lit(span)))).alias("ws"))
    return runs.select("item_id", F.size("ws").alias("size"), F.xxhash64("ws").alias("h"), "ws")


def item_fingerprints(benchmark: DataFrame, span: int, gram: int) -> tuple[DataFrame, list[int]]:
    """fp: the distinct kept hashes of all items; and the sizes of items shorter than ``span`` (at most ``span - 1`` numbers)."""
    items = with_words(benchmark.select("text"), "text").filter(F.size("words") > 0).select("words")
    sizes = sorted(r["n"] for r in items.filter(F.size("words") < span).select(F.size("words").alias("n")).distinct().collect())
    grown = with_minima(with_grams(items, [gram, *sizes]), gram, span - gram + 1)
    kept = [F.col("_min")] + [F.when(F.size("words") == s, F.array(_short(F.get(f"_g{s}", F.lit(0)), s))).otherwise(F.array().cast("array<bigint>")) for s in sizes]
    return grown.select(F.explode(F.concat(*kept)).alias("fp")).distinct(), sizes


def _sized(rows: DataFrame) -> DataFrame:
    """``rows`` (a written table) marked for a broadcast if it is small."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _probed(docs: DataFrame, fingerprints: DataFrame, sizes: list[int], span: int, gram: int) -> DataFrame:
    """doc_id, k1, k2, n_words, copies (equal rows) and met (a kept hash of the text is an item's too)."""
    rows = with_words(docs.select("doc_id", "text", *text_keys(F.coalesce("text", F.lit("")))), "text").drop("text")
    rows = with_minima(with_grams(rows, [gram, *sizes]), gram, span - gram + 1)
    kept = F.array_distinct(F.concat("_min", *[_all_short(f"_g{s}", s) for s in sizes]))
    probes = rows.select("doc_id", *_KEY, F.size("words").cast("long").alias("n_words"), F.posexplode_outer(kept).alias("at", "fp"))
    met = probes.join(fingerprints.withColumn("one", F.lit(1)), "fp", "left")
    return met.groupBy("doc_id", *_KEY, "n_words").agg(
        F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("copies"), F.coalesce(F.max("one") == 1, F.lit(False)).alias("met"))


def _candidates(texts: DataFrame, fingerprints: DataFrame, sizes: list[int], span: int, gram: int) -> DataFrame:
    """k1, k2, at, ws: the runs of words around each hit, and those as long as a short item."""
    width, n = span - gram + 1, F.size("words")
    rows = with_minima(with_grams(with_words(texts, "text").drop("text"), [gram, *sizes]), gram, width)
    # A hash is kept where it is the smallest of one of the windows that it lies in (the last place holds null: greatest() wants two).
    laid = F.transform(f"_g{gram}", lambda g, i: F.struct(i.alias("i"), g.alias("fp"), F.greatest(*[F.get("_min", i - d) for d in range(width)], F.lit(None).cast("long")).alias("top")))
    around = F.transform(F.filter(laid, lambda x: x["fp"] == x["top"]), lambda x: F.struct(
        x["fp"].alias("fp"), F.greatest(x["i"] - (width - 1), F.lit(0)).alias("first"),
        F.least(x["i"], n - span).alias("last"),
        F.slice("words", F.greatest(x["i"] - (width - 1), F.lit(0)) + 1, F.lit(span + width - 1)).alias("near")))
    hits = rows.select(*_KEY, F.inline(around)).join(fingerprints, "fp", "left_semi")
    runs = F.transform(F.sequence(F.col("first"), F.col("last")), lambda s: F.struct(
        s.alias("at"), F.slice("near", s - F.col("first") + 1, F.lit(span)).alias("ws")))
    out = hits.select(*_KEY, F.inline(runs))
    for s in sizes:
        places = F.transform(f"_g{s}", lambda h, i: F.struct(_short(h, s).alias("fp"), i.alias("at"), F.slice("words", i + 1, F.lit(s)).alias("ws")))
        out = out.unionByName(rows.select(*_KEY, F.inline(places)).join(fingerprints, "fp", "left_semi").select(*_KEY, "at", "ws"))
    return out.withColumn("h", F.xxhash64("ws"))


def occurrences(docs: DataFrame, benchmark: DataFrame, span: int = 10, gram: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables, all written: every document's doc_id, k1, k2, n_words, copies, met; every occurrence's k1, k2, at (place of its first
    word in the text with that key), size (words) and run; and each run with its item_id."""
    if not 1 <= gram <= span:
        raise ValueError("gram must lie between 1 and span")
    prints, sizes = item_fingerprints(benchmark, span, gram)
    prints = _sized(staged(prints, "item-prints"))
    runs = staged(item_runs(benchmark, span).withColumn("run", F.md5(F.array_join("ws", " "))), "item-runs")
    base = staged(_probed(docs, prints, sizes, span, gram), "doc-probes")
    # One row stands for all that have the same text.
    wanted = staged(base.filter("met").groupBy(*_KEY).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("r")).select(
        *_KEY, F.col("r.doc_id").alias("rep")), "met-texts")
    texts = docs.select("doc_id", "text", *text_keys(F.coalesce("text", F.lit("")))).join(_sized(wanted), _KEY).filter(
        F.col("doc_id").eqNullSafe(F.col("rep"))).select(*_KEY, "text")
    found = _candidates(texts, prints, sizes, span, gram).join(_sized(staged(runs.select("h", "ws", "size", "run").distinct(), "runs")), ["h", "ws"])
    return base, staged(found.select(*_KEY, "at", "size", "run").distinct(), "occurrences"), runs.select("run", "item_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10, gram: int = 4) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``.

    n_hit: words that lie in an occurrence of a run of ``span`` consecutive words of an item (or of a whole
    shorter item); A-Z count as a-z. n_items: items with such runs; items_sha256: of their ids, sorted as strings, joined
    by commas (of the empty text if there are none). Null and empty texts have no words and are clean; repeated rows get a row
    each; items without words meet nothing; rows of ``benchmark`` with one item_id are one item, those without one are the
    item ''. Other columns of both tables are not looked at. No benchmark: all are clean; no documents: no rows.
    """
    base, found, items = occurrences(docs, benchmark, span, gram)
    covered = F.max(F.col("at") + F.col("size")).over(Window.partitionBy(*_KEY).orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1))
    words = found.select(*_KEY, "at", "size").distinct().withColumn("before", F.coalesce(covered, F.lit(0)))
    new = F.greatest(F.col("at") + F.col("size") - F.greatest("before", "at"), F.lit(0))
    n_hit = words.groupBy(*_KEY).agg(F.sum(new).cast("long").alias("n_hit"))
    pairs = found.select(*_KEY, "run").distinct().join(items, "run").select(*_KEY, "item_id").distinct()
    names = pairs.groupBy(*_KEY).agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    results = staged(n_hit.join(names, _KEY), "hit-texts")
    out = base.join(_sized(results), _KEY, "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, span: int = 10, gram: int = 4) -> DataFrame:
    """The rows of ``docs`` that share no run with an item, with all their columns."""
    _, found, _ = occurrences(docs, benchmark, span, gram)
    dirty = _sized(staged(found.select(*_KEY).distinct(), "dirty-texts"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *text_keys(F.coalesce("text", F.lit(""))))
    return rows.join(dirty, _KEY, "left_anti").select("_row.*")


def oracle(span: int = 10) -> str:
    """DuckDB SQL: every run of every document against every run of the items, as text."""
    fold = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    words = f"list_filter(regexp_split_to_array({fold}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    runs = "array_to_string(ws[i + 1:i + {n}], ' ')"
    return f"""WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {words} AS ws FROM benchmark),
r AS (SELECT DISTINCT item_id, least(len(ws), {span}) AS n, unnest(list_transform(range(greatest(len(ws) - {span}, 0) + 1), lambda i: array_to_string(ws[i + 1:i + {span}], ' '))) AS run
  FROM i WHERE len(ws) > 0),
d AS (SELECT row_number() OVER () AS row_no, doc_id, {words} AS ws FROM documents),
s AS (SELECT DISTINCT n FROM r),
p AS (SELECT row_no, n, unnest(range(len(ws) - n + 1)) AS pos, unnest(list_transform(range(len(ws) - n + 1), lambda i: {runs.format(n="n")})) AS run FROM d, s WHERE len(ws) >= n),
h AS (SELECT p.row_no, p.n, p.pos, r.item_id FROM p JOIN r ON p.run = r.run AND p.n = r.n),
w AS (SELECT row_no, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT row_no, unnest(range(pos, pos + n)) AS x FROM (SELECT DISTINCT row_no, n, pos FROM h)) GROUP BY row_no),
t AS (SELECT row_no, count(DISTINCT item_id) AS n_items, sha256(array_to_string(list_sort(list(DISTINCT item_id)), ',')) AS digest FROM h GROUP BY row_no)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(w.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  coalesce(t.digest, sha256('')) AS items_sha256, coalesce(w.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w ON d.row_no = w.row_no LEFT JOIN t ON d.row_no = t.row_no"""
