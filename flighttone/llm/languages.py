"""Language of texts by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word is the sum over all ways to cut it into pieces, found by
the forward algorithm; a text is the product of its words.  Words are whole runs of
letters, lower-cased, with the vocabulary's mark of a word's beginning in front.

Learning counts the pieces into which the vocabulary's own tokenizer cuts the
words of each language, over all labelled rows; learning and scoring
are maps over blocks of texts in which every distinct word is met once.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flighttone.llm.texts import Pieces, blocks, no_collector, slim, sums
from flighttone.scale import materialize

#: Added to the count of every piece of every language.
SMOOTHING = 0.5
#: Probability of a letter no piece has, against the language's rarest piece.
UNKNOWN = 1e-3
UNDETERMINED = "und"
#: A text is of no learned language where its log odds against equally probable pieces are under this
#: share of what the language's own counts let expect, by more than what ``UNLEARNED`` such texts in all allow.
LEAST, UNLEARNED = 0.1, 1e-3
#: Words of one length are scored together where there are as many, and so many letters at a time.
TOGETHER, LETTERS = 8, 1 << 18
MARK = "▁"
_MIX = np.uint64(0x9E3779B97F4A7C15)

_LETTERS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """Marked words of a text, as they are scored."""
    return [MARK + run.lower() for run in _LETTERS(text)]


class Vocabulary:
    """Pieces of a sentencepiece model that letters can make, and their place in a table of hashes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = [p for p in every if p.removeprefix(MARK).isalpha() and p == p.lower()]
        self.index = {p: i for i, p in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces))
        hashes = np.array([_hash(p) for p in self.pieces], np.uint64)
        self._order = np.argsort(hashes)
        self._sorted = hashes[self._order]
        if (self._sorted[1:] == self._sorted[:-1]).any():
            raise ValueError("pieces share a hash")

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash; one more than the last where there is none."""
        at = np.minimum(np.searchsorted(self._sorted, hashes), len(self._sorted) - 1)
        return np.where(self._sorted[at] == hashes, self._order[at], len(self.pieces))

    def counts(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """How often each piece comes up when the tokenizer cuts ``words``, each met ``times``."""
        out = np.zeros(len(self.pieces))
        bare = [w.removeprefix(MARK) for w in words]
        for at in range(0, len(bare), 50_000):
            cut = self.model.encode(bare[at : at + 50_000], out_type=str, num_threads=1)
            sizes = [len(c) for c in cut]
            found = np.fromiter((self.index.get(p, -1) for c in cut for p in c), np.int64, sum(sizes))
            weight = np.repeat(times[at : at + 50_000], sizes)
            np.add.at(out, found[found >= 0], weight[found >= 0])
        return out


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = ((h ^ ord(c)) * int(_MIX) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


@dataclass(frozen=True)
class LanguageModel:
    """Piece probabilities, one row for each of ``languages``, and the languages' shares."""

    path: str
    languages: tuple[str, ...]
    pieces: np.ndarray
    prior: np.ndarray

    def with_none(self) -> LanguageModel:
        """The same with a last row for texts of no learned language: all pieces equally probable."""
        flat = np.full((1, self.pieces.shape[1]), 1 / self.pieces.shape[1])
        return replace(self, languages=(*self.languages, UNDETERMINED), pieces=np.concatenate([self.pieces, flat]))

    def told(self) -> np.ndarray:
        """Log odds of each language's own texts against pieces of equal probability, a letter."""
        letters = np.array([len(p.removeprefix(MARK)) for p in vocabulary(self.path).pieces])
        return (self.pieces * np.log(self.pieces * len(letters))).sum(axis=1) / (self.pieces @ letters)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language, over all its segmentations."""
        out = np.zeros((len(words), len(self.languages)))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(sizes):
            of = np.flatnonzero(sizes == size)
            step = LETTERS // size
            if min(len(of), step) < TOGETHER:
                for i in of:
                    out[i] = self._one(words[i])
                continue
            for at in range(0, len(of), step):
                part = of[at : at + step]
                joined = "".join([words[i] for i in part])
                codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(-1, size)
                out[part] = self._forward(codes)
        return out

    def _logs(self) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the pieces' probabilities and those of unknown letters, as products of many rare pieces underflow."""
        return np.log(self.pieces.T), np.log(self.pieces.min(axis=1)) + np.log(UNKNOWN)

    def _one(self, word: str) -> np.ndarray:
        """The same for a single word of any length, of which the last few places are held."""
        known = vocabulary(self.path)
        table, unknown = self._logs()
        last = deque([np.zeros(len(self.languages))], known.longest)
        for end in range(1, len(word) + 1):
            ways = []
            for k in range(1, len(last) + 1):
                piece = known.index.get(word[end - k : end])
                if piece is not None:
                    ways.append(last[-k] + table[piece])
                elif k == 1:
                    ways.append(last[-1] + unknown)
            held = np.array(ways)
            top = held.max(axis=0)
            last.append(top + np.log(np.exp(held - top).sum(axis=0)))
        return last[-1]

    def _forward(self, codes: np.ndarray) -> np.ndarray:
        known = vocabulary(self.path)
        n, size = codes.shape
        letters = codes.astype(np.uint64)
        table, unknown = self._logs()
        hashes = np.zeros((n, size), np.uint64)
        found = []
        for k in range(1, min(known.longest, size) + 1):
            hashes = (hashes[:, : size - k + 1] ^ letters[:, k - 1 :]) * _MIX + np.uint64(1)
            found.append(known.find(hashes))
        alpha = np.full((size + 1, n, len(self.languages)), -np.inf)
        alpha[0] = 0
        for end in range(1, size + 1):
            for k in range(1, min(len(found), end) + 1):
                piece = found[k - 1][:, end - k]
                hit = np.flatnonzero(piece < len(known.pieces))
                if len(hit):
                    alpha[end][hit] = np.logaddexp(alpha[end][hit], alpha[end - k][hit] + table[piece[hit]])
            none = np.flatnonzero(found[0][:, end - 1] == len(known.pieces))
            alpha[end][none] = np.logaddexp(alpha[end][none], alpha[end - 1][none] + unknown)
        return alpha[size]


def _labelled(docs: DataFrame, label: str) -> DataFrame:
    narrow = docs.select(F.col("text").cast("string").alias("text"), F.col(label).cast("string").alias("_label"))
    return slim(narrow.filter("_label is not null and text is not null"), "_label")


def learn(docs: DataFrame, path: str, label: str = "lang") -> LanguageModel:
    """Model of all rows with a text and a label.

    Each block sends its counts per language and piece, so what is shuffled and
    what the driver keeps is bounded by languages times vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for block in blocks(batches):
            labels = block["_label"].combine_chunks().dictionary_encode()
            with no_collector():
                pieces = Pieces(block["text"])
                words = [words_of(p) for p in pieces.distinct]
            of = np.repeat(labels.indices.to_numpy(zero_copy_only=False), np.diff(pieces.first))
            for i, language in enumerate(labels.dictionary.to_pylist()):
                times = np.bincount(pieces.which[of == i], minlength=len(words))
                met = np.flatnonzero(times)
                flat = [w for j in met for w in words[j]]
                weight = np.repeat(times[met], [len(words[j]) for j in met])
                counts = known.counts(flat, weight)
                some = np.flatnonzero(counts)
                # The row without a piece counts the documents.
                total = pa.array(np.append(counts[some], float((labels.indices.to_numpy(zero_copy_only=False) == i).sum())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(total)), pa.array(np.append(some, -1)), total],
                    names=["language", "piece", "n"],
                )

    counted = _labelled(docs, label).mapInArrow(run, "language string, piece long, n double")
    rows = counted.groupBy("language", "piece").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["language"].unique())
    known = vocabulary(path)
    place = rows["language"].map({name: i for i, name in enumerate(languages)}).to_numpy(int)
    piece = rows["piece"].to_numpy(int)
    counts = np.full((len(languages), len(known.pieces) + 1), 0.0)
    counts[place, piece] = rows["n"].to_numpy()
    pieces = counts[:, :-1] + SMOOTHING
    prior = counts[:, -1] + 1
    return LanguageModel(
        path, tuple(languages), pieces / pieces.sum(axis=1, keepdims=True), prior / prior.sum()
    )


def classify(docs: DataFrame, model: LanguageModel, keep: list[str], learned: bool = False) -> DataFrame:
    """``keep``, ``lang_pred`` and ``score`` of every document, and its ``learned`` if asked for.

    ``score`` is the probability of the predicted language among those learned.
    Texts that are null or have no letter are ``und`` with score 0, and so are
    all where nothing was learned; equal scores go to the first language by name.
    ``learned`` tells whether the text is of a learned language at all, by its log odds
    against pieces of equal probability, which do not depend on how the learned
    languages compare; a text of few letters is taken for one, ``und`` is not.
    Repeated rows and null ids are kept; an empty table gives no rows; other
    columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages times vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        scorer = model.with_none() if learned else model
        told = model.told()
        for block in blocks(batches):
            with no_collector():
                pieces = Pieces(block["text"])
                words = [words_of(p) for p in pieces.distinct]
            counts = np.array([len(w) for w in words], np.int64)
            distinct = list(dict.fromkeys(w for ws in words for w in ws))
            place = dict(zip(distinct, range(len(distinct))))
            scores = scorer.word_scores(distinct)
            flat = np.fromiter((place[w] for ws in words for w in ws), np.int64, int(counts.sum()))
            upto = np.concatenate([[0], np.cumsum(counts)])
            logs = pieces.per_text(sums(scores[flat], upto))
            letters = pieces.per_text(counts) > 0
            names, sure, enough = [UNDETERMINED] * len(logs), np.zeros(len(logs)), np.zeros(len(logs), bool)
            if model.languages and len(logs):
                if learned:
                    odds, logs = logs[:, :-1] - logs[:, -1:], logs[:, :-1]
                logs = logs + np.log(model.prior)
                best = logs.argmax(axis=1)
                top = logs[np.arange(len(logs)), best]
                share = 1 / np.exp(logs - top[:, None]).sum(axis=1)
                names = [model.languages[b] if some else UNDETERMINED for b, some in zip(best, letters)]
                sure = np.where(letters, share, 0.0)
                if learned:
                    sizes = np.array([sum(len(w.removeprefix(MARK)) for w in ws) for ws in words], np.int64)
                    wanted = LEAST * told[best] * pieces.per_text(sizes) + np.log(UNLEARNED)
                    enough = letters & (odds[np.arange(len(logs)), best] > wanted)
            yield pa.RecordBatch.from_arrays(
                [*(block[c].combine_chunks() for c in keep), pa.array(names, pa.string()), pa.array(sure),
                 *[pa.array(enough)] * learned],
                names=[*keep, "lang_pred", "score", *["learned"] * learned],
            )

    narrow = slim(docs, *keep)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema if f.name in keep)
    return narrow.mapInArrow(run, f"{kinds}lang_pred string, score double" + ", learned boolean" * learned)


def held_out(key: str = "doc_id") -> Column:
    """Rows that learning leaves out: crc32 of the id as text has remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def languages(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, learned from the rows that are not held out.

    ``lang`` is used to learn only, ``doc_id`` only to hold rows out (null ids
    are not held out).
    """
    model = learn(docs.filter(~held_out()), path)
    found = classify(docs, model, ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accuracy(docs: DataFrame, predicted: DataFrame) -> float:
    """Share of held-out labelled documents whose language is predicted."""
    both = materialize(predicted.filter("held_out")).join(docs.filter("lang is not null").select("doc_id", "lang"), "doc_id")
    return both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
