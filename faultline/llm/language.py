"""Language of a text: word frequencies first, backing off to ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, materialize, most_frequent, query, slices, table, tidied

UNKNOWN = "und"
#: The model: so many of the most frequent words, and n-grams of each length, of all languages together.
#: It is this large at most, whatever the corpus; the counts cover every training text.
MODEL_WORDS, MODEL_GRAMS = 100_000, 20_000
NGRAMS = (5, 4, 3, 2, 1)
#: Words counted before a task hands on its counts; words of unseen scores that a task keeps.
HELD_WORDS, HELD_SCORES = 100_000, 100_000
#: Evidence of a text counts like that of so many words at most, so that the score is not always 1.
EVIDENCE = 8.0
LETTERS = re.compile(r"[^\W\d_]+")
ASCII_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower case."""
    if not text:
        return []
    if text.isascii():
        return text.encode("ascii").translate(ASCII_LETTERS).decode("ascii").split()
    words = LETTERS.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    return "".join(c if c.isalpha() else " " for c in " ".join(words)).split()


def grams_of(word: str, n: int) -> list[str]:
    """n-grams of a word with its ends marked; single letters are bare."""
    marked = word if n == 1 else f"^{word}$"
    return [marked[at:at + n] for at in range(len(marked) - n + 1)]


def _pairs(counts: dict[tuple[str, str], int]) -> pa.RecordBatch:
    langs, units = zip(*counts, strict=True) if counts else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(units, pa.string()), pa.array(counts.values(), pa.int64())],
                                      ["lang", "unit", "n"])


def count_words(batches: Iterator) -> Iterator:
    """(lang, word, count) of a task's texts, summed before they leave it."""
    held: dict[str, Counter] = {}
    size = 0
    for batch in slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held.setdefault(lang, Counter()).update(words_of(text))
        size = sum(map(len, held.values()))
        if size > HELD_WORDS:
            yield _pairs({(lang, w): n for lang, c in held.items() for w, n in c.items()})
            held = {}
    yield _pairs({(lang, w): n for lang, c in held.items() for w, n in c.items()})


def count_grams(batches: Iterator) -> Iterator:
    """(lang, n-gram, count) from counted words; an n-gram's length is its n."""
    held: dict[str, dict[str, int]] = {}
    for batch in slices(batches, 20_000):
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "unit", "n")), strict=True):
            counts = held.setdefault(lang, {})
            for size in NGRAMS:
                for gram in grams_of(word, size):
                    counts[gram] = counts.get(gram, 0) + n
        if sum(map(len, held.values())) > HELD_WORDS:
            yield _pairs({(lang, g): n for lang, c in held.items() for g, n in c.items()})
            held = {}
    yield _pairs({(lang, g): n for lang, c in held.items() for g, n in c.items()})


class Model:
    """Per-language log frequencies of words and n-grams, smoothed over the languages."""

    def __init__(self, langs: list[str], totals: dict[str, dict[str, int]], units: dict[str, tuple[list[str], np.ndarray]]):
        self.langs, self.index, self.rows = langs, {}, {}
        for kind, (found, counts) in units.items():
            whole = np.array([totals[kind].get(x, 0) for x in langs], float)
            rates = np.log((counts + 0.05) / (whole + 0.05 * (len(found) + 1)))
            self.index[kind] = {u: i for i, u in enumerate(found)}
            self.rows[kind] = rates - (rates.mean(axis=1, keepdims=True) if len(langs) else 0)

    def unseen(self, words: list[str]) -> np.ndarray:
        """For each word the mean over its known n-grams of the greatest length that has any."""
        out, left = np.zeros((len(words), len(self.langs))), range(len(words))
        for n in NGRAMS:
            index = self.index.get(str(n), {})
            flat, sizes, met, missed = [], [], [], []
            for i in left:
                known = [index[g] for g in grams_of(words[i], n) if g in index]
                if known:
                    flat += known
                    sizes.append(len(known))
                    met.append(i)
                else:
                    missed.append(i)
            if met:
                starts = np.cumsum(sizes) - sizes
                out[met] = np.add.reduceat(self.rows[str(n)][flat], starts, axis=0) / np.array(sizes)[:, None]
            left = missed
        return out


class Scorer:
    """Predictions by a model, with a table of the scores of words already met."""

    def __init__(self, model: Model):
        self.model, self.base = model, len(model.index["word"])
        self.rows = np.zeros((self.base + HELD_SCORES, len(model.langs)))
        self.rows[:self.base] = model.rows["word"]
        self.clear()

    def clear(self) -> None:
        self.index, self.used = dict(self.model.index["word"]), self.base

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.index]
        if self.used + len(new) > len(self.rows):
            self.clear()
            new = [w for w in words if w not in self.index]
        self.rows[self.used:self.used + len(new)] = self.model.unseen(new)
        self.index.update(zip(new, range(self.used, self.used + len(new)), strict=True))
        self.used += len(new)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split, out = list(map(words_of, texts)), []
        every = set().union(*split)
        together = len(every) <= HELD_SCORES // 2
        if together:
            self.learn(every)
        for words in split:
            if not words or not self.model.langs:
                out.append((UNKNOWN, 0.0))
                continue
            total = np.zeros(len(self.model.langs))
            for at in range(0, len(words), HELD_SCORES // 2):
                part = words[at:at + HELD_SCORES // 2]
                if not together:
                    self.learn(set(part))
                total += self.rows[np.fromiter(map(self.index.__getitem__, part), np.int64, len(part))].sum(axis=0)
            logit = total / len(words) * min(len(words), EVIDENCE)
            chance = np.exp(logit - logit.max())
            chance /= chance.sum()
            best = int(np.argmax(np.round(chance, 12)))
            out.append((self.model.langs[best], float(round(chance[best], 6))))
        return out


def train(labelled: DataFrame) -> Model:
    """A model from all rows of (lang, text) with both; rows without either teach nothing."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    spread = rows.mapInArrow(tidied(count_words), "lang string, unit string, n bigint")
    counted = materialize(spread.groupBy("lang", "unit").agg(F.sum("n").alias("n")), "lang-words")
    grams = counted.mapInArrow(tidied(count_grams), "lang string, unit string, n bigint").groupBy("lang", "unit").agg(F.sum("n").alias("n"))
    grams = materialize(grams, "lang-grams")
    kinds = {"word": counted, **{str(n): grams.filter(F.length("unit") == n) for n in NGRAMS}}
    totals = {k: {r.lang: r.n for r in found.groupBy("lang").agg(F.sum("n").alias("n")).collect()} for k, found in kinds.items()}
    langs = sorted(set().union(*totals.values()))
    units: dict[str, tuple[list[str], np.ndarray]] = {}
    for kind, found in kinds.items():
        by_lang = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(langs)]
        every = found.groupBy("unit").agg(F.sum("n").alias("all"), *by_lang)
        rows = most_frequent(every, "all", MODEL_WORDS if kind == "word" else MODEL_GRAMS).drop("all").toArrow().sort_by("unit")
        counts = [rows[f"n{i}"].to_numpy() for i in range(len(langs))]
        units[kind] = rows["unit"].to_pylist(), np.array(counts, float).T.reshape(len(rows), len(langs))
    return Model(langs, totals, units)


def held_out(key: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score. No text or no letter in it: `und`, score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def predict(batches):
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            found = scorer.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                             [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(tidied(predict), schema + ", lang_pred string, score double")


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of `docs` (doc_id, text, lang).

    Learnt from rows with a language that are not held out; a null doc_id is not held out. No row to
    learn from, or no letter in a text: `und`, score 0. Score is the posterior of the language, for the
    evidence of a few words. Ties go to the first language by name; repeated rows are rows like
    others; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select("doc_id", "text", "lang")
    model = train(rows.filter(~held_out()))
    scored = identify(rows.select("doc_id", held_out().alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.3, text: str = "text") -> DataFrame:
    """Rows of `docs` whose language is found with a score of `least` or more; the same columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs.filter(~held_out()).select("lang", text)))
    at = docs.columns.index(text)

    def keep(batches):
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            found = scorer.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return mapped(docs, keep)


@query
def op4_word_backoff_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))
