"""Packing documents into as few sequences as possible: bin completion, branch and bound.

A document is its token ids and an end id; only a longer one than a sequence is cut. The
search sees how many pieces there are of each length, at most `capacity` rows whatever the
input. It takes the largest length left and enumerates fillings of the space around it: an
exact one first, otherwise maximal ones that no other dominates (a filling is dominated if
its lengths can be grouped so that each group fits within one length of the other). A
filling is used as often as the counts allow, then the search goes on below it. A branch is
cut where the space wasted exceeds what an improvement can spare. Best-fit decreasing gives
the first incumbent; a search result that needs no more sequences replaces it, and the
search ends at the lower bound or after `nodes` fillings, with the best solution so far.
Every piece is packed in any case.

The pieces stay where they are: a task numbers the pieces of each of its lengths as it cuts
them, sums over (task, length) give every piece its number within its length, and a table of
slots (a few rows a filling) gives the piece with that number its place. So a length that
most documents share is spread over all tasks.

Null and empty texts are one end id. Repeated rows, and rows with one id or none, are packed
each on its own. Texts of any length are encoded whole. Other columns are not read. An empty
table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from lexiflow.operators.joins import lookup_join
from lexiflow.session import spread, stage

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"  # default place; another can be given
CAPACITY = 2048
END = b"\0\0\0\0"
NODES = 8_000  # fillings the search may try
WIDTH = 4  # fillings tried at one node
COMPARED = 6  # fillings of more lengths are not compared for dominance
KNOWN_PARTS, LONG_PART = 1 << 20, 64
GROUP = 1 << 21  # characters encoded together, or one longer text
RUNS = re.compile(r"[^\W\d_]+|[\W\d_]+")  # letters (and other numbers), the rest
CLOSING = ".,;:!?)%"
MARKS = re.compile(r"[0-9]|[^0-9 ]+")

Filling = tuple[int, ...]  # lengths, falling


# --- the search over lengths ----------------------------------------------------------


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: by space, and by pieces too long to share with others.

    For each k, pieces longer than capacity - k share with none of at least k, pieces longer
    than half a sequence need one each, and the rest must fit what those leave.
    """
    lengths = np.arange(capacity + 1)
    space = counts * lengths
    best = -(-int(space.sum()) // capacity)
    half = capacity // 2
    many, filled = np.cumsum(counts[::-1])[::-1], np.cumsum(space[::-1])[::-1]  # of lengths >= i
    for k in np.flatnonzero(counts[: half + 1]):
        alone = int(many[capacity - k + 1]) if k else 0
        middle, used = int(many[half + 1]) - alone, int(filled[half + 1] - (filled[capacity - k + 1] if k else 0))
        small = int(filled[k] - filled[half + 1])
        spare = middle * capacity - used
        best = max(best, alone + middle + max(0, -(-(small - spare) // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing, many pieces of one length at a time."""
    bins: dict[int, list[tuple[Filling, int]]] = {}  # by space left
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])

        def put(space: int, filling: Filling, times: int, length=length) -> None:
            nonlocal left
            each = space // length
            full = min(times, left // each)
            left -= full * each
            rest = left if full < times and left else 0
            left -= rest
            for n, k in ((each, full), (rest, 1 if rest else 0), (0, times - full - (1 if rest else 0))):
                if k:
                    bins.setdefault(space - n * length, []).append((filling + (length,) * n, k))

        for space in sorted(s for s in bins if s >= length):
            if not left:
                break
            for filling, times in bins.pop(space):
                put(space, filling, times)
        if left:
            put(capacity, (), -(-left // (capacity // length)))
    return [entry for group in bins.values() for entry in group]


def dominates(one: Filling, other: Filling) -> bool:
    """Whether the lengths of other can be grouped to fit within the lengths of one."""

    def place(i: int, room: list[int]) -> bool:
        if i == len(other):
            return True
        for j, space in enumerate(room):
            if space >= other[i] and space not in room[:j]:
                if place(i + 1, room[:j] + [space - other[i]] + room[j + 1 :]):
                    return True
        return False

    return len(other) <= COMPARED and sum(one) >= sum(other) and place(0, list(one))


def fillings(counts: np.ndarray, space: int, width: int) -> list[Filling]:
    """Undominated ways to fill the space with lengths left, least waste first."""
    lengths = np.flatnonzero(counts[: space + 1])
    if not len(lengths):
        return [()]
    if lengths[-1] == space:
        return [(space,)]  # dominates all others
    found = _exact_pairs(counts, lengths, space, width)
    for first in lengths[::-1][: 4 * width].tolist():
        if len(found) >= 2 * width:
            break
        counts[first] -= 1
        rest = np.flatnonzero(counts[: space - first + 1])
        pairs = _exact_pairs(counts, rest, space - first, 2) if len(rest) else []
        found += [tuple(sorted((first, *p), reverse=True)) for p in pairs]
        if not pairs:  # the longest that fit, one after the other
            filling, room = [first], space - first
            while len(rest := rest[rest <= room]):
                each = min(int(counts[rest[-1]]), room // int(rest[-1]))
                filling += [int(rest[-1])] * each
                room -= each * int(rest[-1])
                rest = rest[:-1]
            found.append(tuple(filling))
        counts[first] += 1
    found = sorted(set(found), key=lambda f: (-sum(f), len(f), [-x for x in f]))
    kept: list[Filling] = []
    for filling in found:
        if len(kept) < width and not any(dominates(k, filling) for k in kept):
            kept.append(filling)
    return kept


def _exact_pairs(counts: np.ndarray, lengths: np.ndarray, space: int, most: int) -> list[Filling]:
    """Pairs of lengths left that fill the space, the longest first."""
    upper = lengths[(2 * lengths >= space) & (lengths < space)]
    upper = upper[counts[space - upper] > (2 * upper == space)][::-1]
    return [(int(x), space - int(x)) for x in upper[:most]]


def complete(counts: np.ndarray, capacity: int, nodes: int = NODES, width: int = WIDTH) -> list[tuple[Filling, int]]:
    """(filling, times) that pack counts[length] pieces of each length."""
    counts = np.array(counts, np.int64)
    best = best_fit(counts, capacity)
    most = sum(times for _, times in best)
    needed, total = lower_bound(counts, capacity), int((counts * np.arange(capacity + 1)).sum())
    spare = most * capacity - total  # waste that a result as good as best-fit may have
    path: list[tuple[Filling, int]] = []
    waste = 0

    def choices() -> Iterator[Filling]:
        largest = int(np.flatnonzero(counts)[-1])
        counts[largest] -= 1
        around = fillings(counts, capacity - largest, width)
        counts[largest] += 1
        return iter([(largest, *filling) for filling in around])

    def take(filling: Filling, times: int) -> None:
        nonlocal waste
        for length in filling:
            counts[length] -= times
        waste += times * (capacity - sum(filling))

    open_nodes = [choices()] if total else []
    while open_nodes and nodes:
        filling = next(open_nodes[-1], None)
        if filling is None:
            open_nodes.pop()
            if path:
                last, times = path.pop()
                take(last, -times)
            continue
        nodes -= 1
        times = min(int(counts[x]) // filling.count(x) for x in set(filling))
        if waste + times * (capacity - sum(filling)) > spare:
            if times == 1 or waste + capacity - sum(filling) > spare:
                continue
            times = max(1, (spare - waste) // max(1, capacity - sum(filling)))
        take(filling, times)
        path.append((filling, times))
        if counts.any():
            open_nodes.append(choices())
            continue
        best, used = list(path), sum(times for _, times in path)
        if used <= needed:
            break
        spare = (used - 1) * capacity - total
        path.pop()
        take(filling, -times)
    return best


# --- pieces and places ----------------------------------------------------------------


def word_count(part: str) -> int:
    """Words the tokenizer makes of a run; 0 if that is not plain to see."""
    if part.isalpha():
        return 1
    return len(MARKS.findall(part)) if part.isascii() and part.isprintable() else 0


class Encoder:
    """Ids of texts as little-endian bytes, part by part.

    Blank, tab and line ends separate tokens under any of the tokenizer's steps. So does, in a
    word without apostrophe or mark of a special token, the border between a run of letters and
    printable ASCII. The ids of a text are therefore those of its parts, one after the other.
    Unknown parts are encoded together, as many as a group of texts has; the tokens that end a
    word tell them apart. Ids of short parts are kept, up to a number of them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, parts: dict[str, int]) -> None:
        """Encode parts, given how many words each is to the tokenizer."""
        if not parts:
            return
        ids = self.ids(" ".join(parts))
        last = np.flatnonzero(self.ends[ids])
        words = np.cumsum(np.fromiter(parts.values(), np.int64, len(parts)))
        if words[-1] != len(last):
            self.known.update((part, self.ids(part).tobytes()) for part in parts)
            return
        data, start = ids.tobytes(), 0
        for part, end in zip(parts, (4 * (last[words - 1] + 1)).tolist()):
            self.known[part] = data[start:end]
            start = end

    def __call__(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > KNOWN_PARTS:
            known.clear()
            known[""] = b""
        # ASCII is lower-cased as the tokenizer does
        texts = [t.lower() if t.isascii() and "<|" not in t else t for t in texts]
        lists = [t.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") for t in texts]
        unknown = set().union(*lists).difference(known)
        cut: dict[str, list[str]] = {}
        parts: dict[str, int] = {}
        for word in unknown:
            if word.isalpha():
                parts[word] = 1
                continue
            head, tail = word[:-1], word[-1]
            if tail in CLOSING and head.isalpha():
                cut[word] = [head, tail]
                if head not in known:
                    parts[head] = 1
                if tail not in known:
                    parts[tail] = 1
                continue
            found = RUNS.findall(word) if "'" not in word and "<|" not in word else []
            counts = list(map(word_count, found))
            if all(counts) and found:
                if len(found) > 1:
                    cut[word] = found
                for part, n in zip(found, counts):
                    if part not in known:
                        parts[part] = n
            else:
                known[word] = self.ids(word).tobytes()
        self.learn(parts)
        for word, found in cut.items():
            known[word] = b"".join([known[p] for p in found])
        out = [b"".join(map(known.__getitem__, words)) for words in lists]
        for word in [w for w in unknown if len(w) > LONG_PART]:
            known.pop(word, None)
        return out


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One for all tasks of a worker process."""
    return Encoder(path)


def groups(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about GROUP characters, with the place of the first."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= GROUP or i == len(texts) - 1:
            yield first, held
            first, held, size = i + 1, [], 0


def pieces(docs: DataFrame, capacity: int, tokenizer: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, place: the place counts pieces of one length in one task."""
    columns = "piece int, start long, length long, ids_crc32 long, task int, place long"
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *_parse_datatype_string(columns).fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = encoder_of(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        step = 4 * capacity
        for batch in batches:
            for first, texts in groups(batch.column(1)):
                rows = []
                for i, ids in enumerate(encoder(texts), first):
                    ids += END
                    for n, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        length = len(part) // 4
                        rows.append((i, n, at // 4, length, zlib.crc32(part), task, int(seen[length])))
                        seen[length] += 1
                owner, *values = zip(*rows)
                arrays = [pa.array(v, t) for v, t in zip(values, (pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *arrays], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def slots(solution: list[tuple[Filling, int]]) -> np.ndarray:
    """Rows (length, first number, pieces a sequence, first sequence, offset), by length and number."""
    rows, sequence, used = [], 0, {}
    for filling, times in solution:
        offset = 0
        for length in sorted(set(filling), reverse=True):
            each = filling.count(length)
            rows.append((length, used.get(length, 0), each, sequence, offset))
            used[length] = used.get(length, 0) + each * times
            offset += each * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, nodes: int = NODES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of docs (doc_id, text)."""
    found = stage(pieces(spread(docs.select("doc_id", "text")), capacity, tokenizer), "pieces")
    counts = stage(found.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    totals = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row a length
        totals[row.length] = row.n
    table = docs.sparkSession.sparkContext.broadcast(slots(complete(totals, capacity, nodes)))
    key = F.struct("length", "task").alias("at")
    numbered = lookup_join(found.withColumn("at", key), begins.select(key, "begin"), "at")
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    numbered = numbered.select(*kept, (F.col("begin") + F.col("place")).alias("number"))
    schema = StructType([*numbered.schema.fields[:-1], *_parse_datatype_string("sequence_id long, offset long").fields])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, each, sequence, offset = table.value.T
        starts = (length << 44) + first
        for batch in batches:
            own, number = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(starts, (own << 44) + number, side="right") - 1
            nth = number - first[at]
            where = pa.array(sequence[at] + nth // each[at]), pa.array(offset[at] + nth % each[at] * own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *where], names=schema.names)

    return numbered.mapInArrow(place, schema)
