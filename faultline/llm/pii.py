"""Personal data in texts: fixed patterns, and looser candidates judged by weak supervision."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, query, slices, table
from .spans import ARROW_SPANS, SPANS, Covered, counted, joined, span

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
#: A match never starts inside a run of digits, so the look-behind only saves attempts.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser forms; they become spans only where the classifier says so.
LOOSE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|@| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\.| dot ) ?[A-Za-z0-9-]{2,63})+")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]{4}){2}[ .-]?[0-9]{1,7}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[ .-])?\(?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")),
)
#: Gazetteers.
TLDS = frozenset("com org net edu gov int io info biz de fr es it uk nl ch at eu us ca mx br pt be pl ru jp cn in au".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
ISSUERS = ("34", "36", "37", "38", "4", "51", "52", "53", "54", "55", "60", "62", "64", "65")
#: Words that speak for a kind, and words that speak against any.
CUES = {
    "email": ("mail", "contact", "write to", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "addr", "login from"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "teléfono", "llama", "téléphone", "appel", "anruf"),
}
AGAINST = ("version", "isbn", "issn", "order", "invoice", "ticket", "build", "release", "item", "page", "$", "€", "£")
NEAR = 40
LABELERS = ("pattern", "check", "gazetteer", "cue", "against", "edges")
ACCEPT = 0.8
#: Candidates of a kind count as so many beside the smoothing of the EM, whatever their number.
EVIDENCE = 30.0


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: what precedes is the longest run of local characters."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(done, at + 1))


def octets(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in match.split("."))


def base_spans(text: str) -> list[dict]:
    found = [span(KINDS, "email", *s) for s in emails(text)]
    if not DIGIT.search(text):
        return found
    found += [span(KINDS, "ip", *m.span()) for m in IP.finditer(text) if octets(m[0])] if "." in text else []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(span(KINDS, "card", *m.span()))
    found += [span(KINDS, "phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []
    return found


def votes(text: str, kind: str, start: int, end: int, fixed: bool) -> tuple[int, ...]:
    """What each labeler says of a candidate: 1 personal data, -1 not, 0 nothing."""
    match = text[start:end]
    digits = "".join(c for c in match if c in "0123456789")
    before = text[max(0, start - NEAR):start].lower()
    if kind == "email":
        pattern = 1 if fixed or "(" in match or "[" in match else -1
        check = 1 if len(match) <= 254 and ".." not in match else -1
        gazetteer = 1 if re.split(r"[^a-z0-9]+", match.lower())[-1] in TLDS else -1
    elif kind == "ip":
        pattern, check = 1, 1 if not fixed or not match.startswith("0") else -1
        gazetteer = -1 if match.startswith(("0.", "127.", "255.")) else 0
    elif kind == "card":
        pattern = 1 if re.fullmatch(r"[0-9]{12,19}|[0-9]{4}([ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", match) else -1
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if digits.startswith(ISSUERS) else -1
    else:
        pattern = 1 if fixed or match.startswith(("00", "(")) else 0
        check = 1 if 9 <= len(digits) <= 15 else -1
        gazetteer = (1 if digits.lstrip("0").startswith(CALLING) else -1) if fixed or match.startswith("00") else 0
    cue = 1 if any(w in before for w in CUES[kind]) else 0
    against = -1 if any(w in before[-16:] for w in AGAINST) else 0
    joined_up = (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    return pattern, check, gazetteer, cue, against, -1 if joined_up else 1


def shape(match: str) -> str:
    """Coarse form of a candidate: length, share of digits, separators."""
    digits = sum(c in "0123456789" for c in match)
    return f"{min(len(match) // 6, 7)}{4 * digits // len(match)}{min(sum(not c.isalnum() for c in match), 6)}"


def scan(text: str | None) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """(base spans, candidates (start, end, feature)); feature: kind|fixed|votes|shape."""
    if not text:
        return [], []
    base = base_spans(text)
    spots = [(s["kind"], s["start"], s["end"], True) for s in base]
    taken = [(s["start"], s["end"]) for s in base]
    digit = bool(DIGIT.search(text))
    for kind, pattern in LOOSE:
        if (kind == "email" and not ("dot" in text or "@" in text)) or (kind == "ip" and text.count(":") < 7) or (kind in ("card", "phone") and not digit):
            continue
        covered = Covered(taken)  # matches of one pattern don't overlap each other
        free = [m.span() for m in pattern.finditer(text) if not covered.meets(*m.span())]
        spots += [(kind, *at, False) for at in free]
        taken += free
    out = []
    for kind, start, end, fixed in spots:
        said = ",".join(map(str, votes(text, kind, start, end, fixed)))
        out.append((start, end, f"{kind}|{int(fixed)}|{said}|{shape(text[start:end])}"))
    return base, out


CANDIDATES = "array<struct<start:bigint,end:bigint,feature:string>>"
ARROW_CANDIDATES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("feature", pa.string())]))


def scanned(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def each(batches):
        for batch in slices(batches):
            found = [scan(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), pa.array([f[0] for f in found], ARROW_SPANS),
                pa.array([[dict(zip(("start", "end", "feature"), c, strict=True)) for c in f[1]] for f in found], ARROW_CANDIDATES)],
                ["key", "base", "candidates"])

    return rows.mapInArrow(each, f"key {kind}, base {SPANS}, candidates {CANDIDATES}").withColumnRenamed("key", key)


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each vote pattern, table[class, labeler, vote + 1]) by expectation-maximisation.

    Labelers err independently given the truth. It starts from the majority vote; counts are smoothed
    towards labelers that are right more often than wrong, which keeps the classes from swapping.
    """
    posterior = 1 / (1 + np.exp(-patterns.sum(axis=1).astype(float)))
    prior = np.array([[2.0, 1.0, 0.5], [0.5, 1.0, 2.0]])
    says = patterns[:, :, None] == np.array([-1, 0, 1])
    for _ in range(rounds):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        tables = np.einsum("cp,plv->clv", weight, says) + prior[:, None, :]
        tables /= tables.sum(axis=2, keepdims=True)
        share = (weight.sum(axis=1) + 1) / (weight.sum() + 2)
        like = np.log(share) + np.einsum("plv,clv->pc", says, np.log(tables))
        posterior = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -50, 50)))
    return posterior, tables


def fit_classifier(features: list[str], counts: np.ndarray) -> dict[str, float]:
    """Probability of each feature: logistic regression on votes, kind and shape, with soft labels from the EM.

    A feature weighs by its share, in the EM of its kind's candidates and then of all, never by its count.
    """
    parts = [f.split("|") for f in features]
    said = np.array([[int(v) for v in p[2].split(",")] for p in parts])
    soft = np.zeros(len(parts))
    for kind in KINDS:
        rows = np.array([i for i, p in enumerate(parts) if p[0] == kind], int)
        if len(rows):
            soft[rows] = reliabilities(said[rows], counts[rows] / counts[rows].sum() * EVIDENCE)[0]
    names = [[p[0], *(f"{p[0]}:{name}={v}" for name, v in zip(LABELERS, p[2].split(","), strict=True)),
              *(f"{p[0]}:{i}{c}" for i, c in enumerate(p[3]))] for p in parts]
    index = {n: i for i, n in enumerate(sorted({n for row in names for n in row}))}
    x = np.zeros((len(parts), len(index)))
    for i, row in enumerate(names):
        x[i, [index[n] for n in row]] = 1
    weight, w = counts / max(1.0, counts.sum()) * len(parts), np.zeros(len(index))
    for _ in range(25):  # Newton steps, ridge 0.1
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - soft)) + 0.1 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(index))
        w -= np.linalg.solve(curve, slope)
    return dict(zip(features, 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), strict=True))


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """key, base, spans of every row: the base spans, and those with the accepted looser candidates.

    Labelers vote on all candidates of the table; vote patterns are counted over all of them, their
    reliabilities estimated from the counts, and a classifier of votes and shape trained on the result.
    The driver holds counts of feature values, of which there are some thousands at most. Null texts are
    empty ones and have no spans; repeated rows and null keys are rows like others; an empty table gives
    no rows; other columns are ignored.
    """
    found = materialize(scanned(docs, key, text), "pii-scan")
    rows = found.select(F.explode("candidates.feature").alias("feature")).groupBy("feature").count().orderBy("feature").collect()
    chances = fit_classifier([r.feature for r in rows], np.array([r["count"] for r in rows], float)) if rows else {}
    good = sorted(f for f, p in chances.items() if p >= accept and f.split("|")[1] == "0")
    kept = F.filter("candidates", lambda c: c["feature"].isin(good)) if good else F.array().cast(CANDIDATES)

    def as_span(c):
        kind = F.substring_index(c["feature"], "|", 1)
        rank = F.array_position(F.array(*map(F.lit, KINDS)), kind) - 1
        return F.struct(c["start"].alias("start"), rank.cast("int").alias("rank"), c["end"].alias("end"), kind.alias("kind"))

    return found.select(key, "base", F.concat(F.col("base"), F.transform(kept, as_span).cast(SPANS)).alias("spans"))


@query
def op5_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [counted(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
