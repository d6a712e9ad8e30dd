"""Find benchmark passages in documents up to a few edits.

Texts are sequences of words (ASCII letters in lower case, ASCII punctuation as space). A
document holds an item when some window of as many words as the item (the whole document,
if it is shorter) is within `EDITS` times the item's length of it in edit distance.

Candidates come from locality-sensitive hashing. A window is embedded by a random walk
(CGK): at each step the current word is written out, and a coin that depends on step and
word says whether to move on. Close word sequences stay in step most of the time, so words
within a small edit distance are within a small Hamming distance after the walk. A few
positions of the embedding are sampled and hashed together; that is repeated with other
walks and positions until the target recall is met. Every candidate is verified by the exact
edit distance, so only recall depends on chance, and walks and positions are fixed.

Window lengths follow the items (`LADDER`): an item uses the longest length that leaves room
for all starts of a stride. Its windows are stored at every shift, and documents are probed
every `length // 4` words: a passage meets the index at several places, and edits in one
clump leave some of its windows nearly whole. A window with more words outside the benchmark
vocabulary than the allowed edits is skipped, and so is a candidate whose surroundings hold
too few words of the item; neither loses anything.

The benchmark is the small side: it is read in blocks of bounded size, each broadcast on
its own, and documents stay where they are. Null or empty texts and items match nothing;
null item ids are reported as null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.columns import unused
from lexiflow.llm.words import mix, pieces, seeds, words

EDITS = 0.2
WALKS, SAMPLES, SAMPLED = 6, 6, 4  # 36 repetitions of 4 sampled symbols
BLOCK_BYTES = 2 << 20  # of item texts broadcast at a time; their index is about 40 times as large
LIKELY_BITS = 16  # of a key in the table of those that occur
FILTER_WORDS = 1 << 20  # around candidates, looked at together
LADDER = [1, 2, 3, 4, 6, 8] + [int(8 * 1.5**k) for k in range(1, 24)]
# Fixed: capital letters go to small ones, punctuation and control characters to a space.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256)
)


def fold(text: bytes | None) -> bytes:
    return (text or b"").translate(FOLD)


def edit_distance(a: list[int], b: list[int]) -> int:
    """Levenshtein distance, one bit per word of a."""
    if not a:
        return len(b)
    at: dict[int, int] = {}
    for i, word in enumerate(a):
        at[word] = at.get(word, 0) | 1 << i
    full, top, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    plus, minus = full, 0
    for word in b:
        same = at.get(word, 0)
        zero = (((same & plus) + plus) ^ plus) | same | minus
        up, down = minus | ~(zero | plus) & full, plus & zero
        distance += bool(up & top) - bool(down & top)
        up, down = up << 1 | 1, down << 1
        plus, minus = (down | ~(zero | up)) & full, up & zero & full
    return distance


def best_window(item: list[int], doc: list[int], starts: list[int], most: int) -> tuple[int, int] | None:
    """(distance, start) of the closest window that begins within `most` words of one of the starts."""
    n, last, known = len(item), max(0, len(doc) - len(item)), {}

    def distance(start: int) -> int:
        if start not in known:
            known[start] = edit_distance(item, doc[start : start + n])
        return known[start]

    for start in {min(max(start, 0), last) for start in starts}:
        if distance(start) <= 3 * most:  # moving a window by one word changes the distance by two at most
            for near in range(max(0, start - most), min(last, start + most) + 1):
                distance(near)
    found = min((d, start) for start, d in known.items())
    return found if found[0] <= most else None


def window_length(n: int) -> tuple[int, int]:
    """Longest (length, stride) of the ladder for items of n words."""
    fit = [c for c in LADDER if c + max(1, c // 4) - 1 <= n]
    return fit[-1], max(1, fit[-1] // 4)


def _walk_keys(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """Keys of the windows hashes[start:end] of `length` words at most, once per repetition."""
    padded = np.concatenate([hashes, np.zeros(1, np.uint64)])
    draw = np.random.Generator(np.random.PCG64(length))
    for walk in range(WALKS):
        picks = [np.sort(draw.choice(2 * length, min(SAMPLED, 2 * length), replace=False)) for _ in range(SAMPLES)]
        needed = {int(j) for p in picks for j in p}
        at, seen = starts.copy(), {}
        for step in range(max(needed) + 1):
            if step % 64 == 0:
                coins = mix(padded ^ seeds(1, 1_000_000 * (walk + 1) + step)[0])
            inside = at < ends
            if step in needed:
                seen[step] = np.where(inside, padded[at], np.uint64(0))
            at = at + ((coins[at] >> np.uint64(step & 63)) & np.uint64(1)).astype(np.int64) * inside
        for number, pick in enumerate(picks):
            key = np.full(len(starts), length * 1000 + walk * SAMPLES + number, np.uint64)
            for step in pick:
                key = mix(key ^ seen[int(step)]) + np.uint64(1)
            yield key


class Index:
    """Keys of a block of items, and the items themselves."""

    def __init__(self, items: list[tuple[int | None, bytes]], edits: float = EDITS):
        self.items, self.classes, self.vocabulary = [], {}, np.zeros(0, np.uint64)
        for item_id, text in items:
            _, hashes = words([fold(text)])
            if len(hashes):
                self.items.append((item_id, hashes.tolist(), int(edits * len(hashes))))
        if not self.items:
            return
        self.vocabulary = np.unique(np.concatenate([np.array(h, np.uint64) for _, h, _ in self.items]))
        self.lengths = np.array([len(h) for _, h, _ in self.items])
        self.most = np.array([most for _, _, most in self.items])
        width = len(self.vocabulary) + 1
        slots = [np.unique(np.searchsorted(self.vocabulary, np.array(h, np.uint64))) for _, h, _ in self.items]
        self.member = np.concatenate([number * width + s for number, s in enumerate(slots)])  # (item, word) in order
        groups: dict[tuple[int, int], list[int]] = {}
        for number, n in enumerate(self.lengths.tolist()):
            groups.setdefault(window_length(n), []).append(number)
        for (length, stride), numbers in groups.items():
            shifts = [np.arange(self.lengths[k] - length + 1) for k in numbers]
            owner = np.repeat(np.array(numbers, np.int32), [len(s) for s in shifts])
            joined = np.concatenate([np.array(self.items[k][1], np.uint64) for k in numbers])
            firsts = np.cumsum(self.lengths[numbers]) - self.lengths[numbers]
            starts = np.concatenate([s + first for s, first in zip(shifts, firsts)])
            tables = []
            for keys in _walk_keys(joined, starts, starts + length, length):
                order = np.argsort(keys, kind="stable").astype(np.int32)
                likely = np.zeros(1 << LIKELY_BITS, bool)
                likely[keys >> np.uint64(64 - LIKELY_BITS)] = True
                tables.append((keys[order], order, likely))
            shift = np.concatenate(shifts).astype(np.int32)
            self.classes[length, stride] = (owner, shift, tables, int(self.most[numbers].max()))

    def search(self, texts: list[bytes | None]) -> Iterator[list[tuple[int | None, int, int, int]]]:
        """For each text, its (item_id, distance, first word, words) hits."""
        for _, piece in pieces(texts):
            owner, hashes = words([fold(t) for t in piece])
            bounds = np.searchsorted(owner, np.arange(len(piece) + 1))
            candidates = self._candidates(bounds, hashes) if len(hashes) and self.items else {}
            for i in range(len(piece)):
                best: dict[int, tuple[int, int]] = {}
                doc = hashes[bounds[i] : bounds[i + 1]].tolist() if i in candidates else []
                for number, starts in candidates.get(i, {}).items():
                    _, item, most = self.items[number]
                    if found := best_window(item, doc, starts, most):
                        best[number] = found
                yield [(self.items[k][0], d, s, len(self.items[k][1])) for k, (d, s) in sorted(best.items())]

    def _candidates(self, bounds: np.ndarray, hashes: np.ndarray) -> dict[int, dict[int, list[int]]]:
        """First words to verify for each text and item."""
        slot = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        slot = np.where(self.vocabulary[slot] == hashes, slot, len(self.vocabulary))
        known = np.concatenate([[0], np.cumsum(slot < len(self.vocabulary))])
        sizes, found = np.diff(bounds), [np.zeros((3, 0), np.int64)]
        for (length, stride), (owner, shift, tables, most) in self.classes.items():
            per_text = -(-sizes // stride)
            text = np.repeat(np.arange(len(sizes)), per_text)
            first = np.repeat(np.cumsum(per_text) - per_text, per_text)
            start = bounds[text] + (np.arange(len(text)) - first) * stride
            end = np.minimum(start + length, bounds[text + 1])
            fit = known[end] - known[start] >= length - most
            text, start, end = text[fit], start[fit], end[fit]
            if not len(start):
                continue
            for key, (keys, order, likely) in zip(_walk_keys(hashes, start, end, length), tables):
                met = np.flatnonzero(likely[key >> np.uint64(64 - LIKELY_BITS)])
                low = np.searchsorted(keys, key[met])
                same = keys[np.minimum(low, len(keys) - 1)] == key[met]
                met, low = met[same], low[same]
                many = np.searchsorted(keys, key[met], side="right") - low
                window = np.repeat(met, many)
                place = np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many)
                entry = order[np.repeat(low, many) + place]
                at = text[window]
                found.append(np.stack([at, owner[entry], start[window] - bounds[at] - shift[entry]]))
        text, item, begin = np.unique(np.concatenate(found, axis=1), axis=1)
        out: dict[int, dict[int, list[int]]] = {}
        for t, number, b in zip(*(x[self._possible(bounds, slot, text, item, begin)].tolist() for x in (text, item, begin))):
            out.setdefault(t, {}).setdefault(number, []).append(b)
        return out

    def _possible(self, bounds, slot, text, item, begin) -> np.ndarray:
        """Whether the window of a candidate, with room to move, holds enough words of the item."""
        n, most = self.lengths[item], self.most[item]
        a = np.maximum(bounds[text], bounds[text] + begin - most)
        b = np.maximum(a, np.minimum(bounds[text + 1], bounds[text] + begin + n + most))
        held, total = np.zeros(len(text), np.int64), np.cumsum(b - a)
        cuts = np.searchsorted(total, np.arange(FILTER_WORDS, total[-1] if len(total) else 0, FILTER_WORDS))
        for part in np.split(np.arange(len(text)), cuts):
            sizes = b[part] - a[part]
            which = np.repeat(np.arange(len(part)), sizes)
            place = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            pair = item[part][which] * (len(self.vocabulary) + 1) + slot[a[part][which] + place]
            low = np.minimum(np.searchsorted(self.member, pair), len(self.member) - 1)
            held[part] = np.bincount(which, self.member[low] == pair, minlength=len(part))
        return held >= np.minimum(n, bounds[text + 1] - bounds[text]) - most


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[Index]:
    """Indexes of the items, each of a bounded number of text bytes."""
    items = benchmark.select("item_id", F.col("text").cast("binary").alias("text")).filter("text is not null").distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        yield Index([(row.item_id, bytes(row.text)) for row in sorted(rows, key=lambda r: (str(r.item_id), r.text))])


def _over(docs: DataFrame, index: Index, columns: list, schema: str, emit: Callable) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield emit(batch, list(shared.value.search(batch.column(batch.num_columns - 1).to_pylist())))

    return docs.select(*columns).mapInArrow(run, schema)


HITS = "doc_id long, item_id long, edits long, first_word long, n_words long"


def _emit_hits(batch: pa.RecordBatch, hits: list) -> pa.RecordBatch:
    ids = batch.column(0).to_pylist()
    rows = [(ids[i], *hit) for i, found in enumerate(hits) for hit in found]
    columns = zip(*rows) if rows else ((),) * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "edits", "first_word", "n_words"]
    )


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item it holds: edits, and the window as first word and length.

    Of several windows the closest counts, then the first; repeated rows give one hit.
    """
    columns = [F.col("doc_id").cast("long"), F.col("text").cast("binary")]
    out = None
    for index in _blocks(benchmark, block_bytes):
        hits = _over(docs, index, columns, HITS, _emit_hits)
        out = hits if out is None else out.union(hits)
    if out is None:
        out = docs.sparkSession.createDataFrame([], HITS)
    least = F.min(F.struct("edits", "first_word", "n_words")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(least).select("doc_id", "item_id", "best.*")


def _emit_clean(batch: pa.RecordBatch, hits: list) -> pa.RecordBatch:
    return batch.filter(pa.array([not found for found in hits])).select(list(range(batch.num_columns - 1)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that hold an item, all columns kept. Rows are filtered in place, without a shuffle."""
    body = F.col("text").cast("binary").alias(unused("body", docs))
    for index in _blocks(benchmark, block_bytes):
        docs = _over(docs, index, [*docs.columns, body], docs.schema, _emit_clean)
    return docs
