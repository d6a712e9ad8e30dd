"""Language-model scores by deleted interpolation of n-gram estimates.

P(w | context) mixes the maximum-likelihood estimates of all orders up to ORDER and a
uniform share for unseen words. The weights depend on how often the context occurs, in
buckets by powers of two. They are learned by expectation-maximisation on held-out counts:
blocks of the training text whose own counts are deleted from the totals.

Counting and scoring ask one question, "how often does this n-gram occur in training?", for
every position. Documents are dealt into blocks by a hash. A block sends each distinct
n-gram once, as a hash (64 bits of words, 56 of longer n-grams: of 10^10 different ones
one in seven million meets another) with its own training count, packed by hash range; the
ranges add up the counts and answer in the same packing, with the mark whether another
block sent the n-gram too; the block puts the answers back at their positions. Words and
pairs are asked in the first round, longer n-grams in a round each, and only those whose
two shorter parts, without the first and without the last word, stand in another block
too: of all others every occurrence is in the block, and its own count is the total. The
count of a context is that of the n-gram one word earlier. So an n-gram that is everywhere
costs one entry per block, nothing is capped, and a task holds one block or one range. Both
grow with the text only through their number.

Words are lower-cased (A-Z); every text ends with one end token; contexts before the text
are a begin token. Null texts are empty. Repeated rows count as often as they occur. Without
training documents every estimate is 0 and all scores are those of the uniform share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.words import mix, pieces, seeds, words
from lexiflow.session import stage

ORDER = 2
BLOCK_CHARS = 8_000_000
RANGE_BLOCKS = 2  # blocks of keys that a range answers, about
FIRST_ROUND = 2  # orders asked at once
HELD_BYTES = 16 << 20  # of texts in a task before they are sent to their blocks
PACK_TOKENS = 200_000
ROUNDS = 12
BUCKETS = 40
DELETED = 10  # every tenth block is held out for the weights
LONG_HASH = np.uint64(0xFFFFFFFFFFFFFF00)  # bits kept of the hashes of several words
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def squeeze(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, so that leading zeros compress away."""
    columns = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize)
    return zstandard.ZstdCompressor(level=3).compress(columns.T.tobytes())


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(width, -1).T).view(kind).ravel()


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, np.uint64), dtype=np.uint64)


class Grams:
    """n-gram hashes of a block of texts, by position."""

    def __init__(self, texts: list[bytes], trained: np.ndarray, order: int):
        hashes, sizes = [], []
        for _, piece in pieces(texts):
            owner, found = words([t.lower() for t in piece])
            counts = np.bincount(owner, minlength=len(piece))
            at = np.cumsum(counts + 1) - 1
            out = np.full(len(found) + len(piece), END, np.uint64)
            inner = np.ones(len(out), bool)
            inner[at] = False
            out[inner] = found
            hashes.append(out)
            sizes.append(counts + 1)
        self.sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.tokens = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.trained = trained[self.text] if len(self.text) else np.zeros(0, bool)
        self.order, factors = order, seeds(order, 21)
        self.grams = [self.tokens]
        context = np.zeros(len(self.tokens), np.uint64)
        for n in range(1, order):
            earlier = np.full(len(self.tokens), BEGIN, np.uint64)
            earlier[n:] = self.tokens[:-n]
            place = np.arange(len(self.tokens)) - self.first[self.text]
            earlier[place < n] = BEGIN
            context = mix(context + earlier * factors[n])
            self.grams.append(mix(context ^ (self.tokens * factors[0])) & LONG_HASH)

    def asked(self, question: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of one order: the distinct hashes, the place of each position's, and training counts."""
        keys, at = np.unique(self.grams[question], return_inverse=True)
        return keys, at, np.bincount(at, self.trained, minlength=len(keys)).astype(np.uint32)

    def open(self, shared: np.ndarray) -> np.ndarray:
        """Positions whose n-gram may stand in another block; shared: those whose n-gram one word shorter does."""
        before = np.ones(len(shared), bool)
        before[1:] = shared[:-1]
        before[self.first] = True
        return shared & before


def _bounds(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of hashes begins among sorted keys."""
    edges = (np.arange(1, ranges, dtype=object) * (1 << 64) // ranges).astype(np.uint64) if ranges > 1 else []
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]]).astype(np.int64)


PACKED = "block int, doc_id array<long>, trained array<boolean>, sizes array<int>, bodies binary"
ASK = "question int, part int, block int, keys binary, counts binary"
ANSWER = "question int, part int, block int, n int, shared binary, counts binary, n_distinct long"
COUNTED = (
    "doc_id array<long>, trained array<boolean>, sizes array<long>, counts binary, deleted binary, "
    "n_deleted long, n_distinct long, n_trained long"
)


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a task by block, compressed together."""
    kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary()]
    held: dict[int, list] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        rows = []
        for block, docs in held.items():
            ids, trained, bodies = zip(*docs)
            packed = zstandard.ZstdCompressor(level=3).compress(b"".join(bodies))
            rows.append((block, ids, trained, [len(b) for b in bodies], packed))
        held.clear()
        columns = zip(*rows) if rows else ((),) * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_names(PACKED))

    for batch in batches:
        for doc_id, trained, body, block in zip(*(batch.column(i).to_pylist() for i in range(4))):
            held.setdefault(block, []).append((doc_id, trained, body))
            size += len(body)
            if size >= HELD_BYTES:
                yield flush()
                size = 0
    yield flush()


def _unpack(packs: pa.Table) -> tuple[list, np.ndarray, list[bytes]]:
    """Ids, training marks and texts of a block."""
    ids, trained, bodies = [], [], []
    for pack_ids, marks, sizes, data in zip(*(packs.column(c).to_pylist() for c in ("doc_id", "trained", "sizes", "bodies"))):
        text, at = zstandard.ZstdDecompressor().decompress(data), 0
        for size in sizes:
            bodies.append(text[at : at + size])
            at += size
        ids += pack_ids
        trained += marks
    return ids, np.array(trained, bool), bodies


def _questions(number: int, ranges: int, questions: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    """Rows (question, range) of a block from (question, sorted keys, own counts)."""
    rows = []
    for question, keys, counts in questions:
        edges = _bounds(keys, ranges)
        for part in range(ranges):
            a, b = edges[part], edges[part + 1]
            if b > a:
                rows.append((question, part, number, squeeze_sorted(keys[a:b]), squeeze(counts[a:b])))
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    columns = zip(*rows) if rows else ((),) * 5
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_names(ASK))


def _ask(order: int, ranges: int):
    """The questions of the first round: all words and pairs of a block."""

    def run(packs: pa.Table) -> pa.Table:
        _, trained, bodies = _unpack(packs)
        first = min(order, FIRST_ROUND)
        grams = Grams(bodies, trained, first)
        asked = ((question, *grams.asked(question)) for question in range(first))
        return _questions(packs.column("block")[0].as_py(), ranges, [(q, keys, own) for q, keys, _, own in asked])

    return run


class Answers:
    """What the rounds so far answered on the n-grams of a block, order by order."""

    def __init__(self, grams: Grams, answers: pa.Table, ranges: int):
        self.grams, self.ranges = grams, ranges
        columns = (answers.column(x).to_pylist() for x in ("question", "part", "n", "shared", "counts"))
        self.got = {(q, p): rest for q, p, *rest in zip(*columns)}

    def _found(self, question: int) -> list[tuple[int, bytes, bytes]]:
        return [self.got[question, p] for p in range(self.ranges) if (question, p) in self.got]

    def shared(self, question: int, keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Whether another block holds each of the keys."""
        out = np.zeros(len(keys), bool)
        marks = [np.unpackbits(np.frombuffer(marks, np.uint8), count=n) for n, marks, _ in self._found(question)]
        out[asked] = np.concatenate(marks) if marks else False
        return out

    def totals(self, question: int, own: np.ndarray, asked: np.ndarray) -> np.ndarray:
        out = own.astype(np.int64)
        counts = [unsqueeze(packed, np.int64) for _, _, packed in self._found(question)]
        if counts:
            out[asked] = np.concatenate(counts)
        return out

    def orders(self, questions: range) -> Iterator[tuple]:
        """Of each order: keys, place of each position's, own counts, and marks of the keys asked.

        The orders are those of one round and of the rounds that follow it.
        """
        shared = None
        for question in questions:
            keys, at, own = self.grams.asked(question)
            asked = np.ones(len(keys), bool)
            if question >= FIRST_ROUND:
                asked[:] = False
                asked[at[self.grams.open(shared)]] = True
            yield question, keys, at, own, asked
            if question + 1 >= FIRST_ROUND and question + 1 in questions:
                shared = self.shared(question, keys, asked)[at]


def _ask_open(question: int, ranges: int):
    """The questions of a later round: n-grams whose shorter parts stand in other blocks too."""

    def run(packs: pa.Table, answers: pa.Table) -> pa.Table:
        _, trained, bodies = _unpack(packs)
        answered = Answers(Grams(bodies, trained, question + 1), answers, ranges)
        for number, keys, _, own, asked in answered.orders(range(FIRST_ROUND - 1, question + 1)):
            if number == question:
                return _questions(packs.column("block")[0].as_py(), ranges, [(question, keys[asked], own[asked])])

    return run


def _answer(asked: pa.Table) -> pa.Table:
    """Total counts of the keys of one range, in the packing they came in, and marks of those of several blocks."""
    keys = [unsqueeze_sorted(k) for k in asked.column("keys").to_pylist()]
    counts = np.concatenate([unsqueeze(c, np.uint32) for c in asked.column("counts").to_pylist()])
    sizes = [len(k) for k in keys]
    ends = np.cumsum(sizes)[:-1]
    _, at, blocks = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    total = np.zeros(len(blocks), np.int64)
    np.add.at(total, at, counts.astype(np.int64))
    parts = [squeeze(p) for p in np.split(total[at], ends)]
    marks = [np.packbits(p).tobytes() for p in np.split((blocks > 1)[at], ends)]
    distinct = [int((total > 0).sum())] + [0] * (len(parts) - 1)
    columns = [asked.column("question"), asked.column("part"), asked.column("block")]
    columns += [pa.array(sizes, pa.int32()), pa.array(marks, pa.binary()), pa.array(parts, pa.binary()), pa.array(distinct, pa.int64())]
    return pa.Table.from_arrays(columns, names=_names(ANSWER))


def _collect(order: int, ranges: int):
    def run(packs: pa.Table, answers: pa.Table) -> pa.Table:
        ids, trained, bodies = _unpack(packs)
        grams = Grams(bodies, trained, order)
        answered = Answers(grams, answers, ranges)
        distinct = sum(n for q, n in zip(*(answers.column(x).to_pylist() for x in ("question", "n_distinct"))) if q == 0)
        counts, deleted = [], []
        for question, _, at, own, asked in answered.orders(range(order)):
            total = answered.totals(question, own, asked)
            counts.append(total[at])
            deleted.append((total - own)[at])
        counts, deleted = np.stack(counts), np.stack(deleted)
        learn = packs.column("block")[0].as_py() % DELETED == 0
        own_tokens = int(grams.trained.sum())
        ends = grams.first + grams.sizes
        rows, begin = [], 0
        while begin < len(ids):
            end = max(begin + 1, int(np.searchsorted(ends, grams.first[begin] + PACK_TOKENS, side="right")))
            a, b = grams.first[begin], ends[end - 1]
            kept = np.repeat(trained[begin:end], grams.sizes[begin:end])
            rows.append((
                ids[begin:end], trained[begin:end], grams.sizes[begin:end], squeeze(counts[:, a:b]),
                squeeze(deleted[:, a:b][:, kept]) if learn and kept.any() else None,
                own_tokens, 0 if begin else distinct, int(kept.sum()),
            ))
            begin = end
        kinds = [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()] + [pa.int64()] * 3
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_names(COUNTED))

    return run


def count_grams(docs: DataFrame, trained, order: int = ORDER, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Packs of documents with the training counts of their n-grams of every order, by position."""
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(16, -(-size // block_chars))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long"), trained.alias("trained"), body.alias("body"), block.alias("block"))
    ranges = -(-blocks // RANGE_BLOCKS)
    dealt = rows.mapInArrow(_pack, PACKED)
    asked = dealt.groupBy("block").applyInArrow(_ask(order, ranges), ASK)
    answered = asked.groupBy("question", "part").applyInArrow(_answer, ANSWER)
    for question in range(FIRST_ROUND, order):
        marks = answered.filter(F.col("question") >= FIRST_ROUND - 1).withColumn("counts", F.lit(None).cast("binary"))
        met = dealt.groupBy("block").cogroup(marks.groupBy("block"))
        asked = met.applyInArrow(_ask_open(question, ranges), ASK)
        answered = answered.union(asked.groupBy("question", "part").applyInArrow(_answer, ANSWER))
    met = dealt.groupBy("block").cogroup(answered.groupBy("block"))
    return stage(met.applyInArrow(_collect(order, ranges), COUNTED), "gram_counts")


def _estimates(counts: np.ndarray, sizes: np.ndarray, total: float, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimates at each position of some texts, uniform first, and the weight set of its context.

    counts: one row per order. A context is the n-gram that ended one word before; before
    the first word it is the begin token, as frequent as the end token.
    """
    order, size = counts.shape
    estimates, bucket = np.zeros((order + 1, size)), np.zeros(size, np.int64)
    estimates[0] = 1 / (distinct + 1)
    if total > 0:
        estimates[1] = counts[0] / total
    last = np.cumsum(sizes) - 1
    first = last + 1 - sizes
    for n in range(1, order):
        context = np.empty(size)
        context[1:] = counts[n - 1, :-1]
        context[first] = counts[0, last]
        seen = context > 0
        estimates[n + 1, seen] = counts[n, seen] / context[seen]
        bucket[seen] = n * BUCKETS + np.minimum(np.log2(context[seen]).astype(np.int64), BUCKETS - 1)
    return estimates, bucket


def learn_weights(counted: DataFrame, order: int, total: int, distinct: int, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (bucket, uniform and orders) by expectation-maximisation on deleted counts."""
    kept = F.transform(F.filter(F.arrays_zip("sizes", "trained"), lambda x: x["trained"]), lambda x: x["sizes"])
    held = counted.filter("deleted is not null").select("deleted", "n_deleted", kept.alias("sizes"))
    weights = np.full((order * BUCKETS, order + 1), 1 / (order + 1))
    for _ in range(rounds):
        shared = counted.sparkSession.sparkContext.broadcast(weights)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            current, sums = shared.value, np.zeros((order * BUCKETS, order + 1))
            for batch in batches:
                for packed, own, sizes in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    counts = unsqueeze(packed, np.int64).reshape(order, -1)
                    estimates, bucket = _estimates(counts, np.array(sizes), total - own, distinct)
                    share = current[bucket].T * estimates
                    share /= share.sum(axis=0)
                    for n in range(order + 1):
                        sums[:, n] += np.bincount(bucket, share[n], minlength=len(sums))
            bucket, n = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), pa.array(n), pa.array(sums[bucket, n])], names=["bucket", "n", "uses"]
            )

        used = held.mapInArrow(expect, "bucket long, n long, uses double").groupBy("bucket", "n")
        expected = np.full_like(weights, 1e-3)
        for row in used.agg(F.sum("uses").alias("uses")).collect():  # buckets x orders rows at most
            expected[row.bucket, row.n] += row.uses
        weights = expected / expected.sum(axis=1, keepdims=True)
        shared.unpersist()
    return weights


SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def corpus_size(counted: DataFrame) -> tuple[int, int]:
    """Training tokens, and distinct ones."""
    sums = counted.agg(F.sum("n_trained"), F.sum("n_distinct")).first()
    return sums[0] or 0, sums[1] or 0


def score(docs: DataFrame, trained, order: int = ORDER, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Scores of each row of docs; trained: the column that marks the rows to learn from."""
    counted = count_grams(docs, trained, order, block_chars)
    total, distinct = corpus_size(counted)
    shared = docs.sparkSession.sparkContext.broadcast(learn_weights(counted, order, total, distinct))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            for ids, marks, sizes, packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                sizes = np.array(sizes)
                counts = unsqueeze(packed, np.int64).reshape(order, -1)
                estimates, bucket = _estimates(counts, sizes, total, distinct)
                first = np.cumsum(sizes) - sizes
                base = np.log10((counts[0] + 0.1) / (total + 0.1 * (distinct + 1)))
                mixed = np.log10((weights[bucket].T * estimates).sum(axis=0))
                columns = [pa.array(ids, pa.int64()), pa.array([not m for m in marks]), pa.array(sizes)]
                columns += [pa.array(np.add.reduceat((counts[0] > 0).astype(np.int64), first)), pa.array([total] * len(ids), pa.int64())]
                columns += [pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(mixed, first))]
                yield pa.RecordBatch.from_arrays(columns, names=_names(SCORED))

    return counted.select("doc_id", "trained", "sizes", "counts").mapInArrow(run, SCORED)
