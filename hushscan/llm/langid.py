"""Language identification: words first, then shorter and shorter character n-grams.

A word seen in training is scored by its log frequency in each language.  An
unseen word falls back to its character n-grams of the greatest length of
which one was seen, and scores their mean.  A language where the item was not
seen gets a fixed penalty.  A text scores the mean over its words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from hushscan.llm.common import Scratch
from hushscan.llm.trie import APART, Trie, characters
from hushscan.operators.ordered import numbered

UNKNOWN = "und"
LETTERS = r"\p{L}+"
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; number signs, which the pattern takes too, part them."""
    found = _WORDS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [part for w in found for part in "".join(c if c.isalpha() else " " for c in w).split()]


@dataclass(frozen=True)
class Training:
    """Bounds of the model; none of them depends on the number of documents."""

    #: labelled documents to learn from, of each language, in a fixed pseudo-random order
    docs_per_language: int = 4000
    #: most frequent words, and n-grams of each length, that the model keeps
    words: int = 60_000
    ngrams: int = 20_000
    longest: int = 5
    #: score of an item a language never showed, as a negative log10 frequency
    penalty: float = 7.0
    #: words after which more text does not make a prediction more certain
    certain: int = 20
    #: tokens of which a task remembers the costs before it begins anew
    remembered: int = 200_000


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    ngrams: list[dict[str, int]]
    costs: np.ndarray
    options: Training

    def __post_init__(self):
        self.tries = [Trie(grams) for grams in self.ngrams]
        self.reset()

    def reset(self) -> None:
        """Forget the tokens seen so far."""
        self.known, self.table, self.used = {}, np.zeros((4096, len(self.languages) + 1), np.float32), 0

    def learn(self, tokens: Iterable[str]) -> None:
        """Know the rows of ``table`` that hold the costs of each token's words, and their number."""
        new = [t for t in tokens if t not in self.known]
        lower = [t.lower() for t in new]
        split = [[t] if t.isalpha() else words_of(t) for t in lower]
        words = list(set().union(*split))
        place = dict(zip(words, range(len(words))))
        owner = np.repeat(np.arange(len(new)), list(map(len, split)))
        item = np.fromiter((place[w] for s in split for w in s), np.int64, len(owner))
        rows = np.zeros((len(new), len(self.languages) + 1), np.float32)
        np.add.at(rows, owner, np.column_stack([self.word_costs(words), np.ones(len(words), np.float32)])[item])
        while self.used + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used : self.used + len(new)] = rows
        self.known.update(zip(new, range(self.used, self.used + len(new))))
        self.used += len(new)

    def word_costs(self, words: list[str]) -> np.ndarray:
        """A row of costs for each word: its own, or the mean of its longest n-grams of which one is known."""
        out = np.full((len(words), len(self.languages)), self.options.penalty, np.float32)
        whole = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        out[whole >= 0] = self.costs[whole[whole >= 0]]
        open_ = np.flatnonzero(whole < 0)
        for n in range(self.options.longest, 0, -1):
            if not len(open_):
                break
            chars = characters("".join([f" {words[i]} {APART}" for i in open_.tolist()]))
            owner = np.cumsum(chars == ord(APART)) - (chars == ord(APART))
            trie = self.tries[n - 1]
            for length, (at, item) in enumerate(trie.matches(trie.numbers(chars), n), 1):
                if length < n:
                    continue
                counts = np.bincount(owner[at], minlength=len(open_))
                have = counts > 0
                for language in range(len(self.languages)):
                    sums = np.bincount(owner[at], self.costs[item, language], len(open_))
                    out[open_[have], language] = sums[have] / counts[have]
                open_ = open_[~have]
        return out

    def cost(self, word: str) -> np.ndarray:
        return self.word_costs([word])[0]

    def predict_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of the languages (-1: unknown) and scores of an array of texts."""
        texts = texts.cast(pa.large_string()).fill_null("")
        tokens = pc.utf8_split_whitespace(texts)  # no word holds white space
        sizes, found = np.diff(tokens.offsets.to_numpy()), tokens.flatten().dictionary_encode()
        named = found.dictionary.to_pylist()
        self.learn(named)
        rows = np.fromiter(map(self.known.__getitem__, named), np.int64, len(named))[found.indices.to_numpy()]
        owner = np.repeat(np.arange(len(texts)), sizes)
        total = np.column_stack([np.bincount(owner, column[rows], len(texts)) for column in self.table[: self.used].T])
        cost, words = total[:, :-1], total[:, -1]
        sure = (words > 0) & bool(self.languages)
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        if sure.any():
            scaled = cost[sure] * (np.minimum(words[sure], self.options.certain) / words[sure] * math.log(10))[:, None]
            best[sure] = scaled.argmin(axis=1)
            score[sure] = 1 / np.exp(scaled.min(axis=1)[:, None] - scaled).sum(axis=1)
        return best, score

    def predict(self, text: str | None) -> tuple[str, float]:
        best, score = self.predict_all(pa.array([text], pa.large_string()))
        return (self.languages[best[0]] if best[0] >= 0 else UNKNOWN), float(score[0])


def held_out(doc_id: str) -> Column:
    """A quarter of the documents, chosen by id, that training never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, options: Training = Training(), *, text: str = "text", lang: str = "lang", order: Column | None = None) -> Model:
    """Learn from rows with a language; null or empty texts teach nothing.

    ``order`` is the pseudo-random order that picks the sample, by default a
    hash of the text.  Of copies of a text in the sample one is taken.  Words
    and n-grams are counted by Spark; what comes to the driver is the model,
    whose size the options bound.
    """
    rows = docs.select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), (order if order is not None else F.xxhash64(text)).alias("h")
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").count().select(F.col("lang"), F.col("count").alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(options.docs_per_language)) / F.col("n"))
    chosen = rows.join(F.broadcast(sizes), "lang").where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))
    chosen = chosen.select("lang", "text").distinct()
    # a plain explode would have the optimizer search the words of all documents, in a filter below the sampling
    words = chosen.select("lang", F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0))).alias("item"))
    counts = words.where("item IS NOT NULL").groupBy("lang", "item").agg(F.count(F.lit(1)).alias("n")).withColumn("length", F.lit(0))
    padded = F.concat(F.lit(" "), F.col("item"), F.lit(" "))
    grams = counts.select("lang", "n", padded.alias("w"), F.explode(F.sequence(F.lit(1), F.lit(options.longest))).alias("length"))
    grams = grams.where("length <= char_length(w)").select(
        "lang", "n", "length", F.expr("explode(transform(sequence(1, char_length(w) - length + 1), i -> substring(w, i, length)))").alias("item")
    )
    grams = grams.groupBy("lang", "item", "length").agg(F.sum("n").alias("n"))
    scratch = Scratch(docs.sparkSession)
    every = scratch.write(counts.select("lang", "item", "length", "n").unionByName(grams.select("lang", "item", "length", "n")))
    totals = every.groupBy("lang", "length").agg(F.sum("n").alias("total"))  # a row a language and length
    share = F.col("n") / F.col("total")
    items = every.join(F.broadcast(totals), ["lang", "length"]).withColumn("cost", -F.log10(share)).groupBy("length", "item").agg(
        F.sum(F.pow(F.lit(10.0), -F.col("cost"))).alias("weight"), F.collect_list(F.struct("lang", "cost")).alias("costs")
    )
    # six lengths would be six tasks: ranked over ranges of (length, weight) instead
    limit = F.when(F.col("length") == 0, options.words).otherwise(options.ngrams)
    kept = numbered(items.withColumn("lightness", -F.col("weight")), ["length"], ["lightness", "item"]).where(F.col("nth") <= limit)
    learnt = kept.select("length", "item", "costs").toArrow()
    scratch.drop(every)
    return assemble(learnt, sorted(r[0] for r in sizes.collect()), options)


def assemble(found: pa.Table, languages: list[str], options: Training) -> Model:
    place = {language: i for i, language in enumerate(languages)}
    costs = np.full((found.num_rows, len(languages)), options.penalty, np.float32)
    lists = found.column("costs").combine_chunks()
    owner = np.repeat(np.arange(found.num_rows), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    costs[owner, [place[x] for x in flat.field("lang").to_pylist()]] = flat.field("cost").to_numpy()
    words, ngrams = {}, [{} for _ in range(options.longest)]
    for i, (length, item) in enumerate(zip(found.column("length").to_pylist(), found.column("item").to_pylist())):
        (ngrams[length - 1] if length else words)[item] = i
    return Model(languages, words, ngrams, np.minimum(costs, options.penalty), options)


def portions(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(first row, rows) of stretches of at most so many bytes, or of one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(sizes):
        upto = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, upto - start
        start = upto


def predictions(model: Model, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, places, scores) portion by portion; what Arrow freed goes back to the system in the end."""
    for start, rows in portions(texts):
        if model.used > model.options.remembered:
            model.reset()
        yield start, rows, *model.predict_all(texts.slice(start, rows))
    pa.default_memory_pool().release_unused()


def identify(docs: DataFrame, model: Model, *, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and a score from 0 to 1 behind all its columns.

    Null texts and texts without a letter are ``und`` with score 0.  Only the
    text is an input.  A column that already has one of the two names is
    replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    kept = [i for i, c in enumerate(docs.columns) if c not in (lang_pred, score)]
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = shared.value
        names = pa.array([UNKNOWN, *learnt.languages], pa.string())
        for batch in batches:
            for start, rows, best, score in predictions(learnt, batch.column(f"c{at}")):
                part = batch.slice(start, rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(f"c{i}") for i in kept] + [names.take(pa.array(best + 1)), pa.array(score)],
                    names=[f"c{i}" for i in kept] + ["p", "s"],
                )

    schema = ", ".join(f"c{i} {plain.schema[i].dataType.simpleString()}" for i in kept)
    tagged = plain.mapInArrow(run, schema + ", p string, s double")
    return tagged.toDF(*[docs.columns[i] for i in kept], lang_pred, score)
