"""Language identification by unigram piece models, summed over all segmentations.

The pieces are those of a fixed public vocabulary; every language has a probability for
each. Pieces do not cross word starts, so the probability of a text is the product over
its words of the sum over all segmentations of the word, which a forward pass computes.
Distinct words of a batch are scored once, for all languages and positions together.

A word is a run of letters in lower case; runs over LONGEST letters are cut there, so
texts of any length are scored whole. A letter outside the vocabulary has probability
UNKNOWN. Piece probabilities are learned by expectation-maximisation: forward and backward
passes give the expected uses of each piece in the words of a language.

Training reads at most about TRAIN_ROWS labelled documents, chosen by a hash of the id.
The languages are the labels found there. A text that is null or has no letter is `und`
with score 0; the score of others is the posterior of the predicted language. Ties go to
the first language in order. Without training rows every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.columns import unused
from lexiflow.llm.vocabulary import MARK, PIECES, letter_pieces
from lexiflow.llm.words import pieces, row_hashes, span_hashes
from lexiflow.session import stage

TRAIN_ROWS = 20_000
ROUNDS = 3
LONGEST = 32
UNKNOWN = 1e-7
PRIOR_COUNT = 0.01
ACCEPT = 0.5
UNDETERMINED = "und"

_letters: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """Lower-case code point of every letter, 0 for all other code points."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for code in range(0x110000):
            letter = chr(code)
            if letter.isalpha():
                low = letter.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _letters.append(table)
    return _letters[0]


@dataclass
class Words:
    """Distinct words of some texts, and where they occur."""

    spelled: np.ndarray  # letters of all texts, folded
    starts: np.ndarray
    lengths: np.ndarray
    text: np.ndarray  # text of each occurrence
    word: np.ndarray  # index of its distinct word


def split_words(texts: list[bytes]) -> Words:
    coded = [t.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass") for t in texts]
    codes = np.frombuffer(b" \0\0\0".join(coded) + b" \0\0\0", np.uint32)
    spelled = _fold_table()[np.minimum(codes, 0x10FFFF)]
    inside = spelled > 0
    before = np.concatenate([[False], inside[:-1]])
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(before & ~inside)
    cuts = -(-(ends - starts) // LONGEST)
    part = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    starts = np.repeat(starts, cuts) + part * LONGEST
    ends = np.minimum(starts + LONGEST, np.repeat(ends, cuts))
    lengths = np.array([len(c) // 4 + 1 for c in coded])
    text = np.searchsorted(np.cumsum(lengths), starts, side="right")
    _, first, word = np.unique(span_hashes(spelled, starts, ends), return_index=True, return_inverse=True)
    return Words(spelled, starts[first], (ends - starts)[first], text, word)


class Pieces:
    """Looks up substrings of words in the vocabulary."""

    def __init__(self, names: list[str]):
        coded = [np.frombuffer(n.encode("utf-32-le"), np.uint32) for n in names]
        ends = np.cumsum([len(c) for c in coded])
        keys = span_hashes(np.concatenate(coded), ends - [len(c) for c in coded], ends)
        order = np.argsort(keys)
        self.keys, self.names = keys[order], [names[i] for i in order]
        self.longest = max(len(c) for c in coded)

    def lattices(self, found: Words) -> Iterator[tuple[np.ndarray, dict[tuple[int, int], np.ndarray]]]:
        """For each word length: the words, and the piece at (start, end), -1 if none."""
        for length in np.unique(found.lengths):
            words = np.flatnonzero(found.lengths == length)
            n = int(length) + 1
            letters = np.full((len(words), n), ord(MARK), np.uint32)
            letters[:, 1:] = found.spelled[found.starts[words][:, None] + np.arange(length)]
            spans = {}
            for end in range(1, n + 1):
                for start in range(max(0, end - self.longest), end):
                    keys = row_hashes(letters[:, start:end])
                    slot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                    spans[start, end] = np.where(self.keys[slot] == keys, slot, -1)
            yield words, spans


def _forward(spans: dict, chances: np.ndarray, rows: int) -> list[np.ndarray]:
    """Sums over all segmentations of each prefix; chances has a last column of zeros."""
    n = max(end for _, end in spans)
    sums = [np.ones((len(chances), rows))]
    for end in range(1, n + 1):
        total = np.zeros((len(chances), rows))
        for start in range(end):
            if (start, end) in spans:
                piece = spans[start, end]
                chance = chances[:, piece]
                if end - start == 1:
                    chance = np.where(piece < 0, UNKNOWN, chance)
                total += sums[start] * chance
        sums.append(total)
    return sums


def log_chances(found: Words, table: Pieces, chances: np.ndarray) -> np.ndarray:
    """Log probability of each distinct word in each language."""
    out = np.zeros((len(chances), len(found.starts)))
    for words, spans in table.lattices(found):
        out[:, words] = np.log(_forward(spans, chances, len(words))[-1])
    return out


def expected_uses(found: Words, table: Pieces, chances: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (one language) in words that occur counts times."""
    uses = np.zeros(len(table.keys))
    for words, spans in table.lattices(found):
        forward = _forward(spans, chances, len(words))
        n = len(forward) - 1
        backward = [np.zeros((1, len(words))) for _ in range(n)] + [np.ones((1, len(words)))]
        scale = counts[words] / forward[-1][0]
        for start in range(n - 1, -1, -1):
            for end in range(start + 1, n + 1):
                if (start, end) not in spans:
                    continue
                piece = spans[start, end]
                chance = chances[:, piece]
                if end - start == 1:
                    chance = np.where(piece < 0, UNKNOWN, chance)
                backward[start] += chance * backward[end]
                used = piece >= 0
                share = (forward[start][0] * chance[0] * backward[end][0] * scale)[used]
                uses += np.bincount(piece[used], share, minlength=len(uses))
    return uses


@dataclass
class Model:
    languages: list[str]
    priors: np.ndarray
    chances: np.ndarray  # language x (piece, then a column of zeros)
    table: Pieces


def _with_zero(chances: np.ndarray) -> np.ndarray:
    return np.hstack([chances, np.zeros((len(chances), 1))])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column(0).to_pylist()
        for first, texts in pieces(batch.column(1).to_pylist()):
            found = split_words(texts)
            names = sorted(set(labels[first : first + len(texts)]))
            place = np.array([names.index(x) for x in labels[first : first + len(texts)]])
            counts = np.zeros((len(names), len(found.starts)), np.int64)
            np.add.at(counts, (place[found.text], found.word), 1)
            letters = [found.spelled[s : s + n].tobytes().decode("utf-32-le") for s, n in zip(found.starts, found.lengths)]
            at, word = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in at]), pa.array([letters[i] for i in word]), pa.array(counts[at, word])],
                names=["lang", "word", "n"],
            )


def train(labelled: DataFrame, vocabulary: str = PIECES, rows: int = TRAIN_ROWS, rounds: int = ROUNDS) -> Model | None:
    """Learn from (doc_id, text, lang); rows without text or label are left out."""
    spark = labelled.sparkSession
    labelled = labelled.filter("text is not null and lang is not null").select("doc_id", "lang", F.col("text").cast("binary"))
    share = rows / max(rows, labelled.count())
    slice_of = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))
    counted = labelled.filter(slice_of).select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long")
    words = stage(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    sizes = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not sizes:
        return None
    languages, table = sorted(sizes), Pieces(letter_pieces(vocabulary))
    priors = np.log(np.array([sizes[x] for x in languages]) / sum(sizes.values()))
    chances = np.full((len(languages), len(table.keys)), 1 / len(table.keys))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((languages, chances, table))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, current, pieces_of = shared.value
            uses = np.zeros_like(current)
            for batch in batches:
                names = np.array(batch.column(0).to_pylist(), object)
                spelled = np.array(batch.column(1).to_pylist(), object)
                counts = batch.column(2).to_numpy()
                for i, name in enumerate(known):
                    mine = np.flatnonzero(names == name)
                    for part in np.array_split(mine, len(mine) // 50_000 + 1):
                        if not len(part):
                            continue
                        codes = np.frombuffer("".join(spelled[part]).encode("utf-32-le"), np.uint32)
                        lengths = np.array([len(w) for w in spelled[part]])
                        starts = np.cumsum(lengths) - lengths
                        own = np.arange(len(part))
                        found = Words(codes, starts, lengths, own, own)
                        uses[i] += expected_uses(found, pieces_of, _with_zero(current[i : i + 1]), counts[part])
            i, piece = np.nonzero(uses)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(uses[i, piece])],
                names=["language", "piece", "uses"],
            )

        # languages x vocabulary rows at most: a fixed bound
        sums = words.mapInArrow(expect, "language int, piece int, uses double").groupBy("language", "piece")
        got = sums.agg(F.sum("uses").alias("uses")).toArrow()
        expected = np.full_like(chances, PRIOR_COUNT)
        expected[got["language"].to_numpy(), got["piece"].to_numpy()] += got["uses"].to_numpy()
        chances = expected / expected.sum(axis=1, keepdims=True)
        shared.unpersist()
    return Model(languages, priors, _with_zero(chances), table)


def predict(docs: DataFrame, model: Model | None, label: str = "lang_pred", chance: str = "score") -> DataFrame:
    """docs with the columns label and chance, which replace columns of these names; only the text is looked at."""
    if model is None:
        return docs.withColumns({label: F.lit(UNDETERMINED), chance: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c.lower() not in (label, chance)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            labels, scores = [], []
            for _, texts in pieces(batch.column(batch.num_columns - 1).to_pylist()):
                found = split_words(texts)
                logs = log_chances(found, known.table, known.chances)
                likely = np.array([np.bincount(found.text, log[found.word], minlength=len(texts)) for log in logs])
                letters = np.bincount(found.text, minlength=len(texts)) > 0
                likely += known.priors[:, None]
                share = np.exp(likely - likely.max(axis=0))
                best = likely.argmax(axis=0)
                labels += [known.languages[b] if full else UNDETERMINED for b, full in zip(best, letters)]
                scores += list(np.where(letters, 1 / share.sum(axis=0), 0.0))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                names=[*names, label, chance],
            )

    schema = docs.select(*names).schema.add(label, "string").add(chance, "double")
    return docs.select(*names, F.col("text").cast("binary").alias(unused("body", docs))).mapInArrow(run, schema)


def held_out(modulus: int):
    """Whether the crc32 of the id, as text, is divisible by modulus; null ids count as ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == 0


def keep_known_languages(docs: DataFrame, vocabulary: str = PIECES) -> DataFrame:
    """docs whose language is determined with a score of ACCEPT at least, all columns kept; learned from their own labels."""
    label, chance = unused("lang_pred", docs), unused("score", docs)
    predicted = predict(docs, train(docs.filter(~held_out(5)), vocabulary), label, chance)
    return predicted.filter((F.col(label) != UNDETERMINED) & (F.col(chance) >= ACCEPT)).select(*docs.columns)
