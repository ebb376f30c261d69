"""N-gram Jaccard join with PartEnum signatures, and its groups.

Two sets with Jaccard similarity of at least J and sizes a, c differ in at most (1 - J) / (1 + J) * (a + c)
elements and a >= J * c. Sizes are cut into bands; a set takes part in its own band and, if a partner
may be there, in the next. In a band whose largest size is r, the feature domain (64-bit shingle hashes) is
cut into more equal parts than two sets of the band can have differences, so at least ``need`` parts hold
the same elements of both. The signature of a part is the sum of its scrambled elements: enumerating
the parts one by one, similar sets share at least ``need`` signatures, of which only as many can be of empty
parts as the set has. That gives an exact filter: a set stays if enough of its signatures are shared, and
may leave out the ``need - 1`` most common of those, as the rarest that a pair shares is never among them.

Sets are identified by a hash of the whole set, so copies are one node however many there are.
Signatures travel packed, four bytes each (their bucket is the rest of them; a false match costs a
check and no more). What is similar is decided on the texts' whole sets. Groups are found in three
rounds: each set is checked against the most common set of some of its signature groups, then of all
groups that are not connected yet, and at last against the centre of all sets that signatures connect with it. What
two sets of a cluster have apart follows from what each has apart from the centre, so sets whose differences are their own
cannot be linked and go; only the others are compared in pairs. So a large group of copies with edits of their own costs its
size and not its square, and no link that connects anything is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segpanel.llm.components import components
from segpanel.llm.stage import shuffle_partitions, staged
from segpanel.llm.words import by_size, mix, shingle_sets

_U = np.uint64
#: Texts to check are found with a broadcast of their keys if there are at most so many (about 16 bytes each).
BROADCAST_KEYS = 1_000_000
ROWS = ("kind int, bucket int, doc_id long, text_key long, n_shingles long, node long, "
        "nodes binary, bands binary, needs binary, items binary, signatures binary")
_TYPES = pa.schema([
    ("kind", pa.int32()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()),
    ("node", pa.int64()), *[(c, pa.binary()) for c in ("nodes", "bands", "needs", "items", "signatures")],
])
MEMBERS = "kind int, doc_id long, text_key long, n_shingles long, node long, signature long, band int, need int, size int"


@dataclass(frozen=True)
class Scheme:
    """Bands, parts and differences for a similarity of ``percent`` / 100 or more."""

    percent: int = 80

    def bounds(self, upto: int) -> list[int]:
        """Least sizes of the bands; each is about half as large again as the one before."""
        out = [1]
        while out[-1] <= upto:
            out.append(max(out[-1] + 1, max(out[-1] * 3 // 2, -(-out[-1] * 100 // self.percent))))
        return out

    def differences(self, a, c):
        """Most elements in which two similar sets of these sizes can differ."""
        return (a + c) * (100 - self.percent) // (100 + self.percent)

    def parts(self, largest: int) -> int:
        k = int(self.differences(largest, largest))
        return k + 1 + (k // 10 + 2 if k else 0)

    def largest_partner(self, a):
        return a * 100 // self.percent

    def similar(self, both, a, c):
        return both * 100 >= self.percent * (a + c - both)


def set_nodes(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Identity of each set: a hash of all its elements (0 for the empty set)."""
    out = np.zeros(len(counts), _U)
    full = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[full]
    if len(full):
        out[full] = mix(np.add.reduceat(mix(shingles ^ _U(0xA5A5A5A5A5A5A5A5)), starts) ^ counts[full].astype(_U))
    return out


def signatures(shingles: np.ndarray, counts: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, ...]:
    """Items (a set in a band): set number, band, shared signatures needed; and per signature: item, value."""
    bounds = np.array(scheme.bounds(int(counts.max(initial=1)) * 2), np.int64)
    parts = np.array([scheme.parts(int(b) - 1) for b in bounds[1:]], np.int64)
    own = np.searchsorted(bounds, counts, side="right") - 1
    reach = scheme.largest_partner(counts)
    here = np.flatnonzero(counts)
    up = here[reach[here] >= bounds[own[here] + 1]]
    sets, bands = np.concatenate([here, up]), np.concatenate([own[here], own[up] + 1])
    starts = np.cumsum(counts) - counts
    size = counts[sets]
    total = int(size.sum())
    if not total:
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, _U),)
    item = np.repeat(np.arange(len(sets)), size)
    source = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[sets], size)
    elements = shingles[source]
    n = parts[bands]
    # Elements ascend, so the parts of a set (equal ranges of the domain) follow each other.
    part = ((elements >> _U(32)) * np.repeat(n, size).astype(_U)) >> _U(32)
    new = np.ones(total, bool)
    new[1:] = (part[1:] != part[:-1]) | (item[1:] != item[:-1])
    at = np.flatnonzero(new)
    sums = np.add.reduceat(mix(elements), at)
    owner, place = item[at], part[at]
    value = mix(sums ^ mix((place << _U(20)) ^ bands[owner].astype(_U) ^ _U(1 << 60)))
    filled = np.bincount(owner, minlength=len(sets))
    largest = np.minimum(reach[sets], bounds[bands + 1] - 1)
    need = n - scheme.differences(size, largest) - (n - filled)
    # Sets with so many empty parts that these alone could agree: their empty parts are signatures too.
    owners, values = [owner], [value]
    for i in np.flatnonzero(need <= 0):
        a, b = np.searchsorted(owner, [i, i + 1])  # items ascend
        empty = np.setdiff1d(np.arange(n[i], dtype=_U), place[a:b])
        owners.append(np.full(len(empty), i))
        values.append(mix(mix((empty << _U(20)) ^ _U(bands[i]) ^ _U(1 << 61))))
    return sets, bands, np.maximum(need, 1), np.concatenate(owners), np.concatenate(values)


def signature_rows(docs: DataFrame, width: int, scheme: Scheme, buckets: int) -> DataFrame:
    """A row (kind 0) for each document and packed signatures (kind 1) for each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist()
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for a, b in by_size(texts):
                shingles, counts = shingle_sets(texts[a:b], width)
                nodes = set_nodes(shingles, counts).view(np.int64)
                full = counts > 0
                # Any bucket will do for a document; copies must not meet in one.
                yield _rows(kind=np.zeros(b - a, np.int32), bucket=((np.arange(b - a) + (ids[a] or 0)) % buckets).astype(np.int32),
                            doc_id=ids[a:b], text_key=keys[a:b], n_shingles=counts, node=pa.array(nodes, mask=~full))
                if len(sent) > 1_000_000:
                    sent.clear()  # only saves sending copies again
                fresh = np.zeros(b - a, bool)
                for i in np.flatnonzero(full):
                    if (x := int(nodes[i])) not in sent:
                        sent.add(x)
                        fresh[i] = True
                own = np.repeat(fresh, counts)
                sets, bands, needs, owner, value = signatures(shingles[own], np.where(fresh, counts, 0), scheme)
                bucket = (value % _U(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                short = (value >> _U(32)).astype(np.uint32)
                out: dict[str, list] = {c: [] for c in ("bucket", "nodes", "bands", "needs", "items", "signatures")}
                for k in np.flatnonzero(np.diff(edges)):
                    at = order[edges[k]:edges[k + 1]]
                    items, inside = np.unique(owner[at], return_inverse=True)
                    for c, v in (("bucket", k), ("nodes", nodes[sets[items]].tobytes()), ("bands", bands[items].astype(np.int32).tobytes()),
                                 ("needs", needs[items].astype(np.int32).tobytes()), ("items", inside.astype(np.uint32).tobytes()),
                                 ("signatures", short[at].tobytes())):
                        out[c].append(v)
                if out["bucket"]:
                    yield _rows(kind=np.ones(len(out["bucket"]), np.int32), **out)
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    return keyed.mapInArrow(run, ROWS)


def _rows(**columns) -> pa.RecordBatch:
    n = len(columns["kind"])
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns and not isinstance(columns[f.name], pa.Array)
         else columns.get(f.name, pa.nulls(n, f.type)) for f in _TYPES], schema=_TYPES)


def shared_signatures(rows: DataFrame, buckets: int) -> DataFrame:
    """Documents (kind 0) as they came, and (kind 1) each set of each signature that several sets have."""
    names = [c.split()[0] for c in MEMBERS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            own = batch.filter(pa.array(kind == 0))
            if own.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [own.column(c) for c in names[:5]] + [pa.nulls(own.num_rows, t) for t in (pa.int64(), *[pa.int32()] * 3)], names)
            for r in batch.filter(pa.array(kind == 1)).select(["bucket", "nodes", "bands", "needs", "items", "signatures"]).to_pylist():
                at = np.frombuffer(r["items"], np.uint32)
                parts = held.setdefault(r["bucket"], [[], [], [], []])
                parts[0].append(np.frombuffer(r["signatures"], np.uint32))
                for column, (c, t) in zip(parts[1:], (("nodes", np.int64), ("bands", np.int32), ("needs", np.int32))):
                    column.append(np.frombuffer(r[c], t)[at])
        for bucket, parts in held.items():
            value, node, band, need = (np.concatenate(p) for p in parts)
            parts.clear()
            order = np.argsort(value, kind="stable")
            twice = np.zeros(len(order), bool)
            same = value[order][1:] == value[order][:-1]
            twice[1:] |= same
            twice[:-1] |= same
            order = order[twice]  # signatures that stand alone go here
            value, node, band, need = value[order], node[order], band[order], need[order]
            order = np.lexsort((node, band, value))
            value, node, band, need = value[order], node[order], band[order], need[order]
            new = np.ones(len(value), bool)
            new[1:] = (value[1:] != value[:-1]) | (band[1:] != band[:-1]) | (node[1:] != node[:-1])
            value, node, band, need = value[new], node[new], band[new], need[new]
            head = np.ones(len(value), bool)
            head[1:] = (value[1:] != value[:-1]) | (band[1:] != band[:-1])
            group = np.cumsum(head) - 1
            size = np.bincount(group)[group] if len(group) else group
            many = np.flatnonzero(size > 1)
            signature = value[many].astype(np.int64) * buckets + bucket
            for a in range(0, len(many), 100_000):
                at = many[a:a + 100_000]
                n = len(at)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(node[at]),
                    pa.array(signature[a:a + 100_000]), pa.array(band[at]), pa.array(need[at]), pa.array(size[at].astype(np.int32))], names)
    dealt = rows.repartition(buckets, "bucket")
    return dealt.mapInArrow(run, MEMBERS)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, scheme: Scheme) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar. ``texts``: node, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None  # pairs of one node often follow each other
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            good = np.zeros(len(a), bool)
            for i in range(len(a)):
                if a[i] != last:
                    last, own = a[i], shingle_sets([left[i].encode()], width)[0]
                other = shingle_sets([right[i].encode()], width)[0]
                both = len(own) + len(other) - len(np.union1d(own, other))
                good[i] = scheme.similar(both, len(own), len(other))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _texts_of(docs: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """node, text for each of ``nodes``: the text of one of its documents."""
    reps = members.filter("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("r"))
    keys = staged(nodes.join(reps, "node").select("node", F.col("r.doc_id").alias("doc_id"), F.col("r.text_key").alias("text_key")), "text-keys")
    small = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    k = (F.broadcast(keys) if small else keys).alias("k")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")).alias("d")
    found = d.join(k, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.text_key") == F.col("k.text_key")))
    # Repeated rows have the same text.
    return found.groupBy("k.node").agg(F.first("d.text").alias("text"))


_GROUP = ["signature", "band"]


def _star_pairs(shared: DataFrame) -> DataFrame:
    """Pairs of each set with the set of its signature group whose signatures are the most common.

    The original of many near copies has such signatures; it is similar to more of them than they are to each other.
    Sets with a label are paired with one of another label only.
    """
    top = shared.groupBy(*_GROUP).agg(F.max(F.struct("weight", "node", *[c for c in ("label",) if c in shared.columns])).alias("top"))
    pairs = shared.join(top, _GROUP).filter(F.col("node") != F.col("top.node"))
    if "label" in shared.columns:
        pairs = pairs.filter(F.col("label") != F.col("top.label"))
    return pairs.select(F.col("node").alias("a"), F.col("top.node").alias("b")).distinct()


def _unconnected(shared: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``shared`` with their ``label``, of signature groups with several labels and of sets that may have a link to another label.

    Such a link needs ``need`` signatures that sets of different labels share.
    """
    labelled = staged(_labelled(shared, found), "labelled")
    open_groups = labelled.groupBy(*_GROUP).agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select(*_GROUP)
    rest = labelled.join(open_groups, _GROUP, "left_semi")
    of_set = Window.partitionBy("node", "band")
    return staged(rest.withColumn("n", F.count("*").over(of_set)).filter("n >= need").drop("n"), "unconnected")


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")


def _centres(open_rows: DataFrame) -> DataFrame:
    """node, cluster, centre: sets that signature groups connect are a cluster, and its set with the most common signatures is the centre."""
    top = open_rows.groupBy(*_GROUP).agg(F.max(F.struct("weight", "node")).alias("top"))
    told = open_rows.join(top, _GROUP).select("node", "weight", F.col("top.node").alias("other"))
    roots = staged(components(staged(told.filter("node != other").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct(), "cluster-links")), "clusters")
    clustered = _labelled(open_rows.groupBy("node").agg(F.max("weight").alias("weight")), roots).withColumnRenamed("label", "cluster")
    centre = clustered.groupBy("cluster").agg(F.max_by("node", F.struct("weight", "node")).alias("centre"))
    return clustered.select("node", "cluster").join(centre, "cluster")


def _differences(sets: DataFrame, texts: DataFrame, width: int, scheme: Scheme) -> DataFrame:
    """Adds to ``sets`` (node, cluster, centre) the size of each set, whether it is linked with the centre, and the elements that one of the two has alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, middle = None, np.empty(0, _U)  # sets of one centre often follow each other
        for batch in batches:
            centre, other = batch.column("centre").to_pylist(), batch.column("other").to_pylist()
            for i, text in enumerate(batch.column("text").to_pylist()):
                if centre[i] != last:
                    last, middle = centre[i], shingle_sets([other[i].encode()], width)[0]
                own = shingle_sets([text.encode()], width)[0]
                apart = np.setxor1d(own, middle, assume_unique=True)
                both = (len(own) + len(middle) - len(apart)) // 2
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(i, 1) for c in ("node", "cluster", "centre")]
                    + [pa.array([len(own)]), pa.array([scheme.similar(both, len(own), len(middle))]), pa.array([apart.view(np.int64)], pa.list_(pa.int64()))],
                    ["node", "cluster", "centre", "length", "linked", "apart"])
    middle = texts.select(F.col("node").alias("centre"), F.col("text").alias("other"))
    rows = sets.join(texts, "node").join(middle, "centre").select("node", "cluster", "centre", "text", "other")
    return rows.mapInArrow(run, "node long, cluster long, centre long, length long, linked boolean, apart array<long>")


def _open_sets(sets: DataFrame, percent: int) -> DataFrame:
    """node, label, cluster, length, slack, shared, need, elements for those of ``sets`` (node, label, cluster, length, apart) that may have a link to another label.

    Two sets of a cluster differ in just the elements in which their differences from the centre differ. So a link asks that these
    have ``need`` elements in common: half of what their sizes exceed the differences that the similarity allows (one at least, as
    both would be linked with the centre otherwise). ``elements`` are those in which a set of another label differs too. Sets that
    have too few for the best partner left go, and the counts are made again.
    """
    slack = (100 + percent) * F.size("apart") - (100 - percent) * F.col("length")
    sets = staged(sets.select("node", "label", "cluster", "length", slack.alias("slack"), F.col("apart").alias("elements")), "open-sets")
    while True:
        before = sets.count()
        single = sets.select("node", "label", "cluster", F.explode("elements").alias("element"))
        met = single.groupBy("cluster", "element").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).filter("x < y")
        # The rarest first; ties by the element, so that all sets have one order.
        shared = single.join(met, ["cluster", "element"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "element"))).alias("shared"))
        best = sets.groupBy("cluster").agg(F.min(F.struct("slack", "label")).alias("best"))
        second = sets.join(best, "cluster").filter("label != best.label").groupBy("cluster").agg(F.min("slack").alias("second"))
        partner = F.when(F.col("label") == F.col("best.label"), F.col("second")).otherwise(F.col("best.slack"))
        need = F.greatest(F.lit(1), F.ceil((F.col("slack") + partner) / (2 * (100 + percent)))).cast("int")
        counted = sets.drop("elements", "shared", "need").join(best.join(second, "cluster"), "cluster").join(shared, "node").withColumn("need", need)  # clusters of one label go
        sets = staged(counted.filter(F.size("shared") >= F.col("need")).select(
            "node", "label", "cluster", "length", "slack", F.size("shared").alias("shared"), "need", F.transform("shared", lambda x: x["element"]).alias("elements")), "open-sets")
        left = sets.count()
        if left > 0.95 * before or not left:
            return sets


def similar_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key, n_shingles, node, root for every row of ``docs``.

    Rows with equal root are connected by links: 100 * intersection >= ``percent`` * union of their sets of
    distinct ``width``-word shingles, A-Z as a-z. node identifies the set; both are null where a text has no
    word (null and empty texts too), which links with nothing. Repeated rows stay; other columns are not
    looked at; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scheme, buckets = Scheme(percent), shuffle_partitions(spark)
    rows = staged(shared_signatures(signature_rows(docs, width, scheme, buckets), buckets), "signatures")
    members = rows.filter("kind = 0").select("doc_id", "text_key", "n_shingles", "node")
    of_set = Window.partitionBy("node", "band")  # at most as many rows as the band has parts
    shared = rows.filter("kind = 1").select("signature", "node", "band", "need", "size")
    shared = shared.withColumn("n", F.count("*").over(of_set)).withColumn("weight", F.avg("size").over(of_set)).filter("n >= need").drop("n")
    shared = staged(shared, "shared-signatures")
    texts = staged(_texts_of(docs, shared.select("node").distinct(), members), "pair-texts")
    # Round 1: some of the signatures, whichever; round 2: all groups with sets that are not connected yet.
    links = staged(_verified(staged(_star_pairs(shared.filter(F.pmod("signature", F.lit(8)) == 0)), "star-pairs"), texts, width, scheme), "star-links")
    rest = _unconnected(shared, components(links))
    more = staged(_verified(staged(_star_pairs(rest), "star-pairs"), texts, width, scheme), "star-links")
    links = links.union(more)
    # Round 3: each set against the centre of its cluster, and then every pair that shares a signature, may be similar by
    # their differences from the centre, and is not connected yet.
    rest = _unconnected(rest.drop("label"), components(links))
    apart = staged(_differences(staged(_centres(rest), "centres"), texts, width, scheme), "differences")
    links = links.union(apart.filter("linked and node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b")))
    labels = rest.select("node", "label").distinct()
    told = apart.join(labels, "node").join(labels.select(F.col("node").alias("centre"), F.col("label").alias("middle")), "centre")
    held = _open_sets(told.withColumn("label", F.when(F.col("linked"), F.col("middle")).otherwise(F.col("label"))), percent)
    # Two sets with ``need`` elements in common have one of the rarest of each in common.
    kept = staged(held.withColumn("element", F.explode(F.expr("slice(elements, 1, shared - need + 1)"))).drop("elements", "need"), "open-groups")
    right = kept.select("cluster", "element", *[F.col(c).alias(f"{c}_b") for c in ("node", "label", "length", "slack", "shared")])
    may = ((F.col("label") < F.col("label_b")) & (100 * F.least("length", "length_b") >= percent * F.greatest("length", "length_b"))
           & (2 * (100 + percent) * F.least("shared", "shared_b") >= F.col("slack") + F.col("slack_b")))
    cross = kept.join(right, ["cluster", "element"]).filter(may).select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()
    last = staged(_verified(staged(cross, "cross-pairs"), texts, width, scheme), "cross-links")
    roots = staged(components(links.union(last)), "roots")
    roots = roots.withColumnRenamed("node", "_n")
    return members.join(roots, F.col("node") == F.col("_n"), "left").select(
        "doc_id", "text_key", "n_shingles", "node", F.coalesce("root", "node").alias("root"))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach; a document without words is alone."""
    groups = staged(similar_groups(docs, width, percent), "similar-groups")
    least = groups.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return groups.join(least, "root", "left").select(
        "doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without words, and of every group of linked rows the one with the smallest doc_id.

    A row without doc_id stays only if no other of its group has one. All columns stay.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    keep = similar_groups(docs, width, percent).filter("root is not null").groupBy("root").agg(F.min(order).alias("k"))
    keep = staged(keep.select(F.col("k.doc_id").alias("_doc"), F.col("k.text_key").alias("_key")), "kept-keys")
    bare = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r")) == ""
    columns = docs.columns
    rows = docs.filter(~bare).select(F.struct(*columns).alias("_row"), F.col("doc_id").cast("long").alias("_d"), F.xxhash64("text").alias("_k"))
    kept = rows.join(keep, F.col("_d").eqNullSafe(F.col("_doc")) & (F.col("_k") == F.col("_key")))
    kept = kept.groupBy("_d", "_k").agg(F.first("_row").alias("_row")).select("_row.*")
    return docs.filter(bare).unionByName(kept)
