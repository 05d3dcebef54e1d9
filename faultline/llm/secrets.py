"""Secrets in texts: fixed patterns, and tokens that a battery of randomness tests can't tell from noise."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, materialize, query, slices, table, tidied
from .spans import ARROW_SPANS, SPANS, Covered, counted, joined, masked, span

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
WORDY = re.compile(r"[A-Za-z+/_=-]*|[0-9+/_=-]*")
#: Encodings: pattern, alphabet in order. A token takes the first that fits.
ENCODINGS = [
    (re.compile(r"[0-9a-f]*"), "0123456789abcdef"), (re.compile(r"[0-9A-F]*"), "0123456789ABCDEF"),
    (re.compile(r"[A-Z2-7]*"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), (re.compile(r"[a-z0-9]*"), "abcdefghijklmnopqrstuvwxyz0123456789"),
    (re.compile(r"[A-Z0-9]*"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    (re.compile(r"[A-Za-z0-9+/]*"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    (re.compile(r""), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]
LETTERS = "abcdefghijklmnopqrstuvwxyz"  # ordinary words, case folded
MIN_RANDOM = 16
#: Lower ends of the length strata. Bins of the combined deviance, and their width.
STRATA = (12, 16, 20, 24, 32, 40, 64)
BINS, BIN = 1_000, 0.1
FDR = 0.01
#: Ordinary words on which a stratum's p-values rest, where there are as many.
NULL_WORDS = 2_000
#: Tokens tested at a time.
TOKENS = 20_000


def base_spans(text: str) -> list[dict]:
    found = [span(KINDS, "assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [span(KINDS, "access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return found + [span(KINDS, "hex", *m.span()) for m in HEX.finditer(text)]


def _symbols(alphabet: str, fold: bool = False) -> np.ndarray:
    out = np.zeros(256, np.int64)
    for i, c in enumerate(alphabet):
        out[ord(c)] = i
        if fold:
            out[ord(c.upper())] = i
    for c, i in (("-", 62), ("_", 63)) if len(alphabet) == 64 else ():
        out[ord(c)] = i
    return out


#: Lower case, upper case, digit, other: the classes of the runs test; z-score of a token of one class.
CLASSES = np.array([0 if chr(b).islower() else 1 if chr(b).isupper() else 2 if chr(b).isdigit() else 3 for b in range(128)] + [3] * 128)
ONE_CLASS = 5.0
TABLES = np.array([_symbols(a) for _, a in ENCODINGS] + [_symbols(LETTERS, True)])
SIZES = np.array([len(a) for _, a in ENCODINGS] + [len(LETTERS)])


def deviance(tokens: list[str], encodings: list[int]) -> np.ndarray:
    """Combined deviance from uniform noise of each token over its alphabet: sum of squared z-scores.

    Chi-squared excess over a uniform alphabet (only too uneven counts), runs of character classes (a
    capital at the start counts as lower case), and serial correlation of neighbours. Noise has a mean
    near 2.5 at any length; ordinary words have more.
    """
    if len(tokens) > TOKENS:  # the count table stays small whatever the length of a text
        return np.concatenate([deviance(tokens[at:at + TOKENS], encodings[at:at + TOKENS]) for at in range(0, len(tokens), TOKENS)])
    if not tokens:
        return np.zeros(0)
    n = np.array([len(t) for t in tokens])
    code, owner = np.array(encodings), np.repeat(np.arange(len(tokens)), n)
    symbols = TABLES[code[owner], np.frombuffer("".join(tokens).encode("ascii"), np.uint8)]
    k = SIZES[code].astype(float)
    counts = np.bincount(owner * 64 + symbols, minlength=64 * len(tokens)).reshape(-1, 64)
    chi = (counts.astype(float) ** 2).sum(axis=1) * k / n - n
    z_chi = (chi - (k - 1)) / np.sqrt(2 * (k - 1) * (n - 1) / n)
    inner = owner[1:] == owner[:-1]
    letters = np.frombuffer("".join(t[:1].lower() + t[1:] for t in tokens).encode("ascii"), np.uint8)
    kind = CLASSES[letters]
    changes = np.bincount(owner[1:], inner & (kind[1:] != kind[:-1]), len(tokens))
    sizes = np.bincount(owner * 4 + kind, minlength=4 * len(tokens)).reshape(-1, 4).astype(float)
    differ = 1 - (sizes * (sizes - 1)).sum(axis=1) / (n * (n - 1.0))
    spread = np.sqrt((n - 1) * differ * (1 - differ))
    z_runs = np.where(spread > 0, (changes - (n - 1) * differ) / np.where(spread > 0, spread, 1), ONE_CLASS)
    x = symbols / (k[owner] - 1) - 0.5
    power = np.bincount(owner, x * x, len(tokens))
    serial = np.bincount(owner[1:], np.where(inner, x[1:] * x[:-1], 0.0), len(tokens))
    z_serial = serial / np.maximum(power, 1e-9) * np.sqrt(n)
    return np.maximum(z_chi, 0) ** 2 + z_runs**2 + z_serial**2


def inferred(token: str) -> int:
    return next(i for i, (p, _) in enumerate(ENCODINGS) if p.fullmatch(token) or i == len(ENCODINGS) - 1)


def scan(texts: list[str | None]) -> Iterator[tuple[list[dict], list[tuple[int, int, int, int]], list[int]]]:
    """Per text: base spans; candidates (start, end, stratum, bin); stratum * BINS + bin of its ordinary words."""
    bases, owners, spots, tokens, encodings = [], [], [], [], []
    for i, text in enumerate(texts):
        bases.append(base_spans(text) if text else [])
        covered = Covered([(s["start"], s["end"]) for s in bases[-1]])
        for m in TOKEN.finditer(text or ""):
            token = m[0].rstrip("=")
            wordy = WORDY.fullmatch(token)
            if wordy:
                token = re.sub(r"[^A-Za-z]", "", token)
            if len(token) < (STRATA[0] if wordy else MIN_RANDOM) or covered.meets(*m.span()):
                continue
            owners.append(i)
            spots.append(None if wordy else m.span())
            tokens.append(token)
            encodings.append(len(ENCODINGS) if wordy else inferred(token))
    bins = np.minimum(deviance(tokens, encodings) / BIN, BINS - 1).astype(int)
    strata = np.searchsorted(STRATA, [len(t) for t in tokens], side="right") - 1
    out = [(b, [], []) for b in bases]
    for i, spot, stratum, b in zip(owners, spots, strata, bins, strict=True):
        if spot:
            out[i][1].append((*spot, int(stratum), int(b)))
        else:
            out[i][2].append(int(stratum) * BINS + int(b))
    yield from out


CANDIDATES = "array<struct<start:bigint,end:bigint,stratum:int,bin:int>>"
ARROW_CANDIDATES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.int32()), ("bin", pa.int32())]))


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base, candidates, ordinary: what scan() finds in each row's text."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def each(batches):
        for batch in slices(batches):
            found = list(scan(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), pa.array([f[0] for f in found], ARROW_SPANS),
                pa.array([[dict(zip(("start", "end", "stratum", "bin"), c, strict=True)) for c in f[1]] for f in found], ARROW_CANDIDATES),
                pa.array([f[2] for f in found], pa.list_(pa.int32()))], ["key", "base", "candidates", "ordinary"])

    return rows.mapInArrow(tidied(each), f"key {kind}, base {SPANS}, candidates {CANDIDATES}, ordinary array<int>").withColumnRenamed("key", key)


def thresholds(found: DataFrame, fdr: float = FDR) -> list[int]:
    """Highest deviance bin accepted in each length stratum (-1: none).

    Null hypothesis: the token is an ordinary string. Its p-value is the share of the corpus's ordinary
    words of its stratum that look as random as it does. Where these are few, the words of the nearest
    shorter strata join them: longer words only look less random, so that errs on the safe side.
    Benjamini-Hochberg then bounds the false discoveries within each stratum.
    """
    null = np.zeros((len(STRATA), BINS), np.int64)
    seen = np.zeros_like(null)
    for r in found.select(F.explode("ordinary").alias("cell")).groupBy("cell").count().collect():
        null[r.cell // BINS, r.cell % BINS] = r["count"]
    for r in found.select(F.explode("candidates").alias("c")).groupBy("c.stratum", "c.bin").count().collect():
        seen[r.stratum, r.bin] = r["count"]
    for s in range(len(STRATA) - 1, 0, -1):
        for shorter in range(s - 1, -1, -1):
            if null[s].sum() >= NULL_WORDS:
                break
            null[s] += null[shorter]
    p = (1 + null.cumsum(axis=1)) / (1 + null.sum(axis=1, keepdims=True))
    good = (p <= fdr * seen.cumsum(axis=1) / np.maximum(1, seen.sum(axis=1, keepdims=True))) & (seen > 0)
    return [int(np.flatnonzero(g).max(initial=-1)) for g in good]


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", fdr: float = FDR) -> DataFrame:
    """key, base, spans of every row: spans holds the base spans and the accepted random tokens.

    Null texts are empty ones and have no spans; repeated rows and null keys are rows like others; an
    empty table gives no rows; other columns are ignored.
    """
    found = materialize(scanned(docs, key, text), "secret-scan")
    limits = F.array(*[F.lit(x) for x in thresholds(found, fdr)])
    kept = F.filter("candidates", lambda c: c["bin"] <= F.get(limits, c["stratum"]))
    added = F.transform(kept, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("rank"), c["end"].alias("end"),
                                                 F.lit("random").alias("kind")))
    return found.select(key, "base", F.concat(F.col("base"), added.cast(SPANS)).alias("spans"))


def redact_secrets(docs: DataFrame, text: str = "text", length: str = "n_chars", fdr: float = FDR) -> DataFrame:
    """`docs` with every secret in `text` replaced by its kind in brackets, and `length` set anew there."""
    found = materialize(scanned(docs.select(F.lit(0).alias("key"), text), "key", text).drop("base"), "secret-scan")
    limits = thresholds(found, fdr)
    at, sized = docs.columns.index(text), docs.columns.index(length) if length in docs.columns else -1

    def mask(batches):
        for batch in slices(batches):
            texts, cols = batch.column(at).to_pylist(), list(batch.columns)
            sizes = cols[sized].to_pylist()
            for i, (t, (base, candidates, _)) in enumerate(zip(texts, scan(texts), strict=True)):
                spans = [(s["start"], s["end"], s["kind"]) for s in base] + [(a, b, "random") for a, b, s, d in candidates if d <= limits[s]]
                if spans:
                    texts[i] = masked(t, spans)
                    sizes[i] = len(texts[i])
            if sized >= 0:
                cols[sized] = pa.array(sizes, cols[sized].type)
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    return mapped(docs, mask)


@query
def op10_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    counts = [counted(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
