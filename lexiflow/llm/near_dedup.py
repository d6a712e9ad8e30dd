"""Near-duplicate groups: MinHash bands for candidates, odd sketches to verify them.

Every text is the set of its distinct five-word shingles. Equal sets form a class, so
copies cost one row each and nothing more. MinHash samples of a class give its band keys
and, folded into a parity bitmap (an odd sketch), an estimate of high similarities: the
population count of the XOR of two bitmaps. Estimates only rule pairs out; every link is
confirmed on the full sets.

Buckets of any size are handled without emitting their pairs:

1. The hub of a bucket is its class with the most company over all of its buckets, which
   is the original where copies of it were edited. Of the hubs that its estimates allow,
   each class joins the cluster of the one with the most company, and the two are compared.
2. In a cluster, classes that are not linked to the hub are compared with all the others,
   in blocks of about BLOCK classes a side that hold the full sets. A block returns a
   spanning forest of its links at most.
3. Classes that share a bucket but neither cluster nor, by now, component meet in a join on
   the bucket whose condition is the estimate, and are compared.

A pair inside one component cannot change it, so every banded pair is accounted for.

Null or empty texts and texts without words have no shingles and are alone. Repeated rows
fall in one class. A null doc_id never names a component that holds another id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.graph import components
from lexiflow.llm.words import mix, pieces, seeds, shingles
from lexiflow.session import stage

WIDTH = 5
SIMILAR = 75  # percent
BANDS, ROWS = 32, 5
SAMPLES = 320  # folded into the sketch; the first BANDS * ROWS make the bands
SKETCH_BITS = 1024
MARGIN = 0.13  # about five standard deviations of the estimate
BLOCK = 256

SIGNED = "doc_id long, n_shingles long, node binary, bands array<long>, sketch array<long>"


def most_differing_bits(samples: int, bits: int, similarity: float) -> int:
    """Expected XOR count of two odd sketches of sets with this similarity."""
    return int(np.ceil(bits / 2 * (1 - np.exp(-4 * samples * (1 - similarity) / bits))))


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints, band keys and odd sketches of non-empty sets."""
    values = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.empty((len(sets), SAMPLES), np.uint64)
    for k, factor in enumerate(seeds(SAMPLES, 3)):
        least[:, k] = np.minimum.reduceat(values * factor, starts)
    prints = np.empty((len(sets), 2), np.uint64)
    for k, seed in enumerate(seeds(2, 5)):
        prints[:, k] = np.add.reduceat(mix(values ^ seed), starts)
    rows = seeds(ROWS, 7)
    keys = (least[:, : BANDS * ROWS].reshape(len(sets), BANDS, ROWS) * rows).sum(axis=2, dtype=np.uint64)
    keys = mix(keys ^ seeds(BANDS, 9))
    bits = (mix(least ^ seeds(SAMPLES, 11)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    bits += np.arange(len(sets))[:, None] * SKETCH_BITS
    odd = np.bincount(bits.ravel(), minlength=len(sets) * SKETCH_BITS) & 1
    sketch = np.packbits(odd.astype(np.uint8).reshape(len(sets), SKETCH_BITS), axis=1)
    return prints, keys, sketch.view(np.uint64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_shingles", pa.int64()),
            ("node", pa.binary()),
            ("bands", pa.list_(pa.int64())),
            ("sketch", pa.list_(pa.int64())),
        ]
    )
    for batch in batches:
        ids = batch.column(0)
        for first, texts in pieces(batch.column(1).to_pylist()):
            sets = shingles(texts, WIDTH)
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            nodes, bands, sketches = ([None] * len(sets) for _ in range(3))
            if len(full):
                prints, keys, sketch = _signatures([sets[i] for i in full])
                for at, i in enumerate(full):
                    nodes[i] = prints[at].tobytes()
                    bands[i] = keys[at].view(np.int64)
                    sketches[i] = sketch[at].view(np.int64)
            columns = [ids.slice(first, len(sets)), sizes, nodes, bands, sketches]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema)],
                schema=schema,
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed sets of the texts that have the fingerprint asked for, once per class.

    The rows of an id follow each other, so repeated rows are seen by their id.
    """
    last, done = None, set()
    for batch in batches:
        ids, nodes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for first, texts in pieces(batch.column(4).to_pylist()):
            kept, items = [], []
            for i, found in enumerate(shingles(texts, WIDTH), first):
                if ids[i] != last:
                    last, done = ids[i], set()
                if not len(found) or nodes[i] in done:
                    continue
                prints = np.array([mix(found ^ s).sum(dtype=np.uint64) for s in seeds(2, 5)])
                if prints.tobytes() == nodes[i]:
                    done.add(nodes[i])
                    kept.append(i)
                    items.append(found.tobytes())
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column(1), rows.column(2), rows.column(3), pa.array(items, pa.binary())], names=["node", "hub", "is_hub", "items"]
            )


def _similar(common, mine: int, other):
    return 100 * common >= SIMILAR * (mine + other - common)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links, last, hub = [], None, np.zeros(0, np.uint64)
        for a, b, mine, other in zip(*(batch.column(k) for k in range(4))):
            a, b, mine = a.as_py(), b.as_py(), np.frombuffer(mine.as_py(), np.uint64)
            if b != last:
                last, hub = b, np.frombuffer(other.as_py(), np.uint64)
            at = np.minimum(np.searchsorted(hub, mine), len(hub) - 1)
            if _similar(int((hub[at] == mine).sum()), len(mine), len(hub)):
                links.append((a, b))
        columns = zip(*links) if links else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["a", "b"])


def confirm(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of met (a, b, items, other) whose full sets are similar."""
    return stage(met.select("a", "b", "items", "other").mapInArrow(_compare, "a binary, b binary"), "links")


def _block_links(block: pa.Table) -> pa.Table:
    """A spanning forest of the links between left classes and right classes of a block."""
    nodes, linked = block.column("node").to_pylist(), block.column("linked").to_pylist()
    left = block.column("left").to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in block.column("items").to_pylist()]
    rows = [i for i in range(len(nodes)) if not left[i]]
    root = {nodes[i]: b"" if linked[i] else nodes[i] for i in range(len(nodes))}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    links = []
    if rows:
        values, places = np.unique(np.concatenate([sets[i] for i in rows]), return_inverse=True)
        sizes = np.array([len(sets[i]) for i in rows])
        starts = np.cumsum(sizes) - sizes
        for i in (i for i in range(len(nodes)) if left[i]):
            at = np.minimum(np.searchsorted(values, sets[i]), len(values) - 1)
            present = np.zeros(len(values), np.int64)
            present[at[values[at] == sets[i]]] = 1
            common = np.add.reduceat(present[places], starts)
            for k in np.flatnonzero(_similar(common, len(sets[i]), sizes)):
                a, b = find(nodes[i]), find(nodes[rows[k]])
                if a != b:
                    child, parent = (a, b) if a else (b, a)
                    root[child] = parent
                    links.append((nodes[i], nodes[rows[k]]))
    columns = zip(*links) if links else ((), ())
    return pa.Table.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["a", "b"])


def cluster_links(sets: DataFrame, links: DataFrame) -> DataFrame:
    """Links of classes not linked to their hub with the other classes of their cluster.

    sets: (node, hub, items) of all classes with a hub; links: (a, b) of those linked to it.
    """
    rows = sets.select(F.col("node").alias("a"), F.col("hub").alias("b"))
    rows = rows.join(links.withColumn("linked", F.lit(True)), ["a", "b"], "left")
    rows = stage(rows.select("a", "b", F.coalesce("linked", F.lit(False)).alias("linked")), "cluster_rows")
    counts = rows.groupBy("b").agg(F.count("*").alias("n"), F.sum(F.when(~F.col("linked"), 1).otherwise(0)).alias("open"))
    counts = counts.filter("open > 0 and n > 1")
    many, few = F.ceil(F.col("n") / BLOCK).cast("int"), F.ceil(F.col("open") / BLOCK).cast("int")
    counts = stage(counts.select("b", many.alias("rights"), few.alias("lefts")), "cluster_sizes")
    rows = stage(rows.join(counts, "b"), "open_rows")
    placed = stage(rows.join(sets.select(F.col("node").alias("a"), "items"), "a"), "cluster_sets")
    spot = F.xxhash64("a")

    def dealt(kept: DataFrame, left: bool) -> DataFrame:
        own, others = ("lefts", "rights") if left else ("rights", "lefts")
        mine = F.pmod(spot, F.col(own)).cast("int")
        across = F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        pair = (mine.alias("l"), across.alias("r")) if left else (across.alias("l"), mine.alias("r"))
        return kept.select("b", *pair, F.col("a").alias("node"), "linked", F.lit(left).alias("left"), "items")

    met = dealt(placed.filter(~F.col("linked")), True).union(dealt(placed, False).select("b", "l", "r", "node", "linked", "left", "items"))
    return stage(met.groupBy("b", "l", "r").applyInArrow(_block_links, "a binary, b binary"), "block_links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("body"))
    signed = stage(texts.mapInArrow(_sign, SIGNED), "signed")
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")]
    classes = signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), *firsts)
    classes = stage(classes, "classes")

    banded = classes.select("node", F.explode("bands").alias("key"))
    shared = stage(banded.groupBy("key").agg(F.count("*").alias("company")).filter("company > 1"), "shared")
    members = stage(banded.join(shared, "key"), "members")
    company = stage(members.groupBy("node").agg(F.sum("company").alias("company")), "company")
    most_met = F.max_by("node", F.struct("company", "node")).alias("hub")
    hubs = stage(members.select("key", "node").join(company, "node").groupBy("key").agg(most_met), "hubs")

    most = most_differing_bits(SAMPLES, SKETCH_BITS, SIMILAR / 100 - MARGIN)
    sketches = classes.select("node", "n_shingles", "sketch")

    def promising(left: str, right: str):
        """Sizes allow the similarity, and so does the estimate."""
        words = [F.bit_count(F.col(f"{left}sketch")[i].bitwiseXOR(F.col(f"{right}sketch")[i])) for i in range(SKETCH_BITS // 64)]
        low, high = F.least(f"{left}n_shingles", f"{right}n_shingles"), F.greatest(f"{left}n_shingles", f"{right}n_shingles")
        return (low * 100 >= high * SIMILAR) & (sum(words[1:], words[0]) <= most)

    stars = members.select("key", "node").join(hubs, "key").filter("node != hub").select("node", "hub").distinct()
    hub_rows = sketches.join(company, "node").select(
        F.col("node").alias("hub"), F.col("n_shingles").alias("h_n_shingles"), F.col("sketch").alias("h_sketch"), "company"
    )
    met = stars.join(sketches, "node").join(hub_rows, "hub").filter(promising("", "h_"))
    clusters = stage(met.groupBy("node").agg(F.max_by("hub", F.struct("company", "hub")).alias("hub")), "clusters")

    wanted = company.select("node").join(classes.select("node", F.col("doc_id").alias("member")), "node")
    wanted = wanted.join(clusters, "node", "left")
    is_hub = clusters.select(F.col("hub").alias("node")).distinct().withColumn("is_hub", F.lit(True))
    wanted = wanted.join(is_hub, "node", "left").select("member", "node", "hub", F.coalesce("is_hub", F.lit(False)).alias("is_hub"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("body"))
    met = texts.join(stage(wanted, "wanted").hint("merge"), texts.doc_id.eqNullSafe(F.col("member")))
    met = met.select("doc_id", "node", "hub", "is_hub", "body")
    sets = stage(met.mapInArrow(_sets, "node binary, hub binary, is_hub boolean, items binary"), "sets")

    mine = sets.filter("hub is not null").select("hub", F.col("node").alias("a"), "items")
    hub_sets = sets.filter("is_hub").select(F.col("node").alias("b"), F.col("items").alias("other"))
    links = confirm(mine.join(hub_sets, mine.hub == hub_sets.b))
    links = links.union(cluster_links(sets.filter("hub is not null"), links))
    joined = components(links)

    placed = members.select("key", "node").join(joined, "node", "left").join(clusters, "node", "left")
    placed = placed.select("key", "node", F.coalesce("root", "node").alias("root"), "hub")
    placed = stage(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
    open_rows = stage(placed.join(mixed.select("key"), "key").join(sketches, "node"), "open")
    met = open_rows.alias("l").join(
        open_rows.alias("r"),
        (F.col("l.key") == F.col("r.key"))
        & (F.col("l.node") > F.col("r.node"))
        & (F.col("l.root") != F.col("r.root"))
        & ~F.coalesce(F.col("l.hub") == F.col("r.hub"), F.lit(False))
        & promising("l.", "r."),
    )
    more = stage(met.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct(), "pairs")
    if not more.isEmpty():
        mine = sets.select(F.col("node").alias("a"), "items")
        other = sets.select(F.col("node").alias("b"), F.col("items").alias("other"))
        found = confirm(more.join(mine, "a").join(other, "b"))
        joined = components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found))

    rooted = classes.select("node", "doc_id").join(joined, "node", "left")
    rooted = stage(rooted.select("node", "doc_id", F.coalesce("root", "node").alias("root")), "rooted")
    least = stage(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    named = stage(rooted.join(least, "root").select("node", "component_id"), "named")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return (
        signed.select("doc_id", "n_shingles", "node")
        .join(named, "node", "left")
        .select("doc_id", "n_shingles", component)
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each near-duplicate group, all columns kept.

    Rows that repeat the id of a kept document with the same text count once; a row
    without an id stays if no other row of its group has one.
    """
    kept = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.join(kept, docs.doc_id.eqNullSafe(kept.kept_id), "left_semi")
    return rows.dropDuplicates(["doc_id", "text"])
