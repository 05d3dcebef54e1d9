"""Quality of documents: co-training of a text classifier and a metadata classifier."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, query, slices, smallest_hashes, table
from .language import words_of

#: Labelled and unlabelled documents that the classifiers are fitted on, at most: those of smallest hash.
LABELLED, POOL = 8_000, 8_000
#: Telling words of the text classifier; a word counts from so many labelled documents on.
LEXICON, LEAST_DOCS = 400, 5
#: Co-training rounds; pseudo-labels a classifier hands over per round and class, at most, and how sure it must be.
ROUNDS, HANDED, SURE = 4, 400, 0.95
#: Metadata names fall into so many features by their CRC-32, whatever number of names there is.
SLOTS = 256
KEEP = 0.5
SYMBOLS = b"#$%&*@^~|<>{}[]\\/_=+"
NUMBERS = 10


def text_numbers(text: str) -> list[float]:
    """Form of a text: length, word lengths, repetition, symbols, digits, capitals, sentences, lines."""
    raw, words = text.encode("utf-8", "replace"), text.split()
    n, size = max(1, len(words)), max(1, len(raw))
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    return [math.log1p(len(words)), math.log(size / n), len(set(words)) / n**0.85, sum(map(eq, words, words[1:])) / n, math.sqrt(share(SYMBOLS)),
            share(b"0123456789"), share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b".!?") * 10, math.log1p(text.count("\n")), math.sqrt(text.count("|") / n)]


def metadata_numbers(source, lang, n_chars) -> tuple[list[str], float]:
    """Names and size that are known without reading a document."""
    return [f"source={source}", f"lang={lang}", f"both={source}/{lang}"], math.log1p(max(0, n_chars or 0))


class Logistic:
    """Ridge logistic regression on standardised columns, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 7):
        total = max(weight.sum(), 1e-9)
        self.mean = (weight @ x) / total
        self.scale = np.sqrt(weight @ (x - self.mean) ** 2 / total) + 1e-9
        self.w = np.zeros(x.shape[1] + 1)
        rows = self._rows(x)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(rows @ self.w, -30, 30)))
            slope = rows.T @ (weight * (p - y)) + ridge * self.w
            curve = (rows * (weight * p * (1 - p))[:, None]).T @ rows + ridge * np.eye(len(self.w))
            self.w -= np.linalg.solve(curve, slope)

    def _rows(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._rows(x) @ self.w, -30, 30)


def chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-logit))


class Views:
    """Feature rows of the two views, the same for fitting and for scoring."""

    def __init__(self, lexicon: list[str]):
        self.lexicon, self.words = {w: i for i, w in enumerate(lexicon)}, frozenset(lexicon)

    def text(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), 2 * NUMBERS + len(self.lexicon)))
        for i, t in enumerate(texts):
            numbers = text_numbers(t or "")
            out[i, :NUMBERS] = numbers
            hits = self.words.intersection(words_of(t))
            out[i, [2 * NUMBERS + self.lexicon[w] for w in hits]] = 1
        out[:, NUMBERS:2 * NUMBERS] = out[:, :NUMBERS] ** 2
        return out

    def metadata(self, rows: list[tuple]) -> np.ndarray:
        out = np.zeros((len(rows), 2 + SLOTS))
        for i, (source, lang, n_chars) in enumerate(rows):
            known, size = metadata_numbers(source, lang, n_chars)
            out[i, :2] = size, size * size
            out[i, [2 + zlib.crc32(n.encode("utf-8", "replace")) % SLOTS for n in known]] = 1
        return out


class CoTrained:
    """Two classifiers that taught each other, calibrated and combined; see fit()."""

    def __init__(self, views: Views, prior: float, parts=None):
        self.views, self.prior, self.parts = views, prior, parts

    def score(self, texts: list, metadata: list[tuple]) -> np.ndarray:
        """Columns: text score, metadata score, combined score."""
        if self.parts is None:
            return np.full((len(texts), 3), self.prior)
        text, meta, calibrations, both = self.parts
        logits = np.stack([m.logit(x) for m, x in ((text, self.views.text(texts)), (meta, self.views.metadata(metadata)))], axis=1)
        logits = np.stack([c.logit(logits[:, [i]]) for i, c in enumerate(calibrations)], axis=1)
        return chance(np.column_stack([logits, both.logit(logits)]))


def fit(views: Views, x: tuple[np.ndarray, np.ndarray], y: np.ndarray, held: np.ndarray, rounds: int = ROUNDS) -> CoTrained:
    """Co-training on rows of both views; y: 1 good, 0 bad, NaN unlabelled; `held` rows only calibrate.

    In each round each classifier is fitted on the true labels and on what the other has handed over;
    the unlabelled rows of which it is surest, by its calibrated chance, then go to the other with
    half the weight. Calibration and combination are fitted on the held-out labelled rows.
    """
    known = ~np.isnan(y)
    learn, check = known & ~held, known & held
    if min(len(set(y[learn])), len(set(y[check]))) < 2:
        return CoTrained(views, float(y[known].mean()) if known.any() else KEEP)
    share = y[learn].mean()
    given: list[dict[int, float]] = [{}, {}]
    models: list[Logistic] = []
    calibrations: list[Logistic] = []
    for turn in range(rounds + 1):
        models, calibrations = [], []
        for view in (0, 1):
            rows = np.concatenate([np.flatnonzero(learn), np.array(list(given[view]), int)])
            target = np.concatenate([y[learn], np.array(list(given[view].values()))])
            weight = np.concatenate([np.ones(learn.sum()), np.full(len(given[view]), 0.5)])
            models.append(Logistic(x[view][rows], target, weight))
            calibrations.append(Logistic(models[view].logit(x[view][check])[:, None], y[check], np.ones(check.sum())))
        if turn == rounds:
            break
        for view in (0, 1):
            other, free = 1 - view, np.array([i for i in np.flatnonzero(~known) if i not in given[1 - view]], int)
            if not len(free):
                continue
            sure = chance(calibrations[view].logit(models[view].logit(x[view][free])[:, None]))
            for label, certain in ((1.0, sure), (0.0, 1 - sure)):
                most = max(1, round(HANDED * (share if label else 1 - share)))
                best = np.argsort(-certain, kind="stable")[:most]
                given[other].update({int(free[i]): label for i in best if certain[i] >= SURE})
    logits = np.stack([c.logit(m.logit(v[check])[:, None]) for c, m, v in zip(calibrations, models, x, strict=True)], axis=1)
    both = Logistic(logits, y[check], np.ones(check.sum()))
    return CoTrained(views, float(y[known].mean()), (models[0], models[1], calibrations, both))


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, good (null: unlabelled), text, source, lang, n_chars of the documents to fit on.

    A document labelled more than once is good only if all its labels are; labels without quality don't
    count. Both parts are those of the smallest hashes of doc_id, and sent to where the texts are.
    """
    good = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("double")).alias("good"))
    marked = smallest_hashes(good, "doc_id", LABELLED)
    free = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().join(good, "doc_id", "left_anti")
    free = smallest_hashes(free, "doc_id", POOL).withColumn("good", F.lit(None).cast("double"))
    picked = materialize(marked.union(free), "quality-picked")  # LABELLED + POOL rows at most
    return materialize(docs.join(F.broadcast(picked), "doc_id").select("doc_id", "good", "text", "source", "lang", "n_chars"), "quality-sample")


def distinct_words(batches: Iterator) -> Iterator:
    for batch in slices(batches):
        words, good = [], []
        for text, g in zip(batch.column("text").to_pylist(), batch.column("good").to_pylist(), strict=True):
            found = set(words_of(text))
            words += found
            good += [g] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(good, pa.float64())], ["word", "good"])


def telling_words(sample: DataFrame) -> list[str]:
    """The words of labelled documents whose share of good ones differs most from the rest (chi-squared)."""
    marked = sample.filter("good IS NOT NULL")
    counts = marked.agg(F.count("*"), F.sum("good")).first()
    if not counts[0] or not 0 < counts[1] < counts[0]:
        return []
    share = counts[1] / counts[0]
    words = marked.mapInArrow(distinct_words, "word string, good double").groupBy("word").agg(F.count("*").alias("n"), F.sum("good").alias("g"))
    apart = (F.col("g") - F.col("n") * share) ** 2 / (F.col("n") * share * (1 - share))
    rows = words.filter(F.col("n") >= LEAST_DOCS).orderBy(F.desc(apart), "word").limit(LEXICON).select("word").collect()
    return sorted(r.word for r in rows)


def train(docs: DataFrame, labels: DataFrame) -> CoTrained:
    sample = training_sample(docs, labels)
    views = Views(telling_words(sample))
    width = 2 * NUMBERS + len(views.lexicon)

    def features(batches):
        for batch in slices(batches):
            got = batch.to_pydict()
            text = views.text(got["text"]).astype(np.float32)
            meta = views.metadata(list(zip(got["source"], got["lang"], got["n_chars"], strict=True))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("good"), pa.array([r.tobytes() for r in text], pa.binary()),
                                              pa.array([r.tobytes() for r in meta], pa.binary())], ["doc_id", "good", "text", "meta"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(features, f"doc_id {kind}, good double, text binary, meta binary").withColumn(
        "held", F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)) == 0).orderBy("doc_id", "text").toArrow()
    as_matrix = lambda name, n: np.frombuffer(b"".join(rows[name].to_pylist()), np.float32).reshape(-1, n).astype(float)
    y = rows["good"].to_numpy(zero_copy_only=False).astype(float) if len(rows) else np.zeros(0)
    return fit(views, (as_matrix("text", width), as_matrix("meta", 2 + SLOTS)), y, np.array(rows["held"].to_pylist(), bool))


def score_quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, text_score, metadata_score, score, keep of every row of `docs`.

    `docs` has doc_id, text, source, lang, n_chars; `labels` doc_id, quality, toxic. Good is quality 1
    and not toxic. score is the chance that a document is good; keep is score >= `keep`. The
    classifiers are fitted on LABELLED labelled and POOL other documents at most, and score all. Null
    texts are empty ones; null metadata is a value of its own; without labels of both kinds all scores
    are the share of good labels (without any: `keep`). Repeated rows and null ids are rows like
    others; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"),
                       F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("double").alias("n_chars"))
    shared = docs.sparkSession.sparkContext.broadcast(train(rows, labels))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def score(batches):
        for batch in slices(batches):
            got = batch.select(["text", "source", "lang", "n_chars"]).to_pydict()
            out = np.round(shared.value.score(got["text"], list(zip(got["source"], got["lang"], got["n_chars"], strict=True))), 6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in out.T), pa.array(out[:, 2] >= keep)],
                                             ["doc_id", "text_score", "metadata_score", "score", "keep"])

    return rows.mapInArrow(score, f"doc_id {kind}, text_score double, metadata_score double, score double, keep boolean")


@query
def op6_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
