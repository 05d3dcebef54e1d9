"""Personal data: fixed patterns against the plain regular expressions, looser ones by weak supervision."""

import random
import re

from pyspark.sql import functions as F

from faultline.llm import pii
from faultline.llm.spans import Covered, joined

DDL = "doc_id bigint, text string, base string, spans string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, match):
    digits = [int(c) for c in match if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if good(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_fixed_patterns_on_random_strings():
    rng = random.Random(11)
    for alphabet in ("a@.-", "12.. 5", "0123456789 -", "+12345 ().-", "a1@.+- (é٣", "4111 -+"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
            got = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in sorted(pii.base_spans(text), key=lambda s: (s["start"], s["rank"])))
            assert got == brute(text), repr(text)


def texts():
    rng = random.Random(12)
    words = ["the", "and", "ention", "of", "über"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [prose(80) for _ in range(60)]
    out += [prose(20) + f" mail me: bob.{i}@mail.example.com or call +1 (555) 010-99{i:02d} " + prose(20) for i in range(30)]
    out += [prose(10) + f" write to ann.{i} (at) example (dot) org please" for i in range(15)]
    out += [f"phone 0044 207 555 {1000 + i} " + prose(9) + f" version 1.2.{i}.900 order 1234 5678 {1000 + i}" for i in range(15)]
    out += ["4111 1111 1111 1111 and 4111-1111-1111-1112", "1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.1", "a@b a@b.c @x.y a@@b.c a@b.c@d.e"]
    return out


def test_table(spark):
    rows = [*enumerate(texts()), (900, None), (901, ""), (902, "x" * 3_000 + "@" + "1" * 3_000), (903, "a@b.c"), (903, "a@b.c"), (None, "a@b.c")]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DDL)
    got = pii.find_personal_data(frame).select("doc_id", joined(F.col("base")).alias("b"), joined(F.col("spans")).alias("s")).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.b) for r in got) == sorted(((i is None, i or 0), brute(t)) for i, t in rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].s == "" for i in range(60))
    assert all(set(r.b.split(",")) - {""} <= set(r.s.split(",")) for r in got)
    assert sum("email" in by_id[i].s for i in range(90, 105)) >= 12
    assert not any("card" in x for i in range(105, 120) for x in set(by_id[i].s.split(",")) - set(by_id[i].b.split(",")))


def test_empty(spark):
    assert pii.find_personal_data(spark.createDataFrame([], DDL)).collect() == []


def test_em_finds_the_unreliable_labeler():
    import numpy as np

    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.4
    sign = np.where(truth, 1, -1)[:, None]
    right = rng.random((4000, 4)) < np.array([0.95, 0.9, 0.85, 0.5])
    posterior, tables = pii.reliabilities(np.where(right, sign, -sign), np.ones(4000))
    assert ((posterior > 0.5) == truth).mean() > 0.95
    assert tables[1, 0, 2] > 0.9 and abs(tables[1, 3, 2] - 0.5) < 0.08


def test_accepted_features_do_not_depend_on_the_number_of_rows():
    import numpy as np

    counts = {}
    for text in texts():
        for *_, feature in pii.scan(text)[1]:
            counts[feature] = counts.get(feature, 0) + 1
    names, times = sorted(counts), np.array([counts[f] for f in sorted(counts)], float)
    one, many = (pii.fit_classifier(names, times * k) for k in (1, 1_000_000))
    accepted = [{f for f, p in chances.items() if p >= pii.ACCEPT} for chances in (one, many)]
    assert accepted[0] == accepted[1] and any(f.startswith("email|0") for f in accepted[0])


def test_long_texts_take_linear_time():
    long = "x" * 300_000 + "@" + "1" * 300_000 + ".x@y.z" + "+" * 100_000 + "1.1" * 100_000
    assert pii.scan(long)[0][0]["kind"] == "email"


def test_covered_places_and_many_spans():
    rng = random.Random(9)
    spans = [(a, a + rng.randint(1, 9)) for a in (rng.randint(0, 300) for _ in range(40))]
    covered = Covered(spans)
    for _ in range(500):
        start = rng.randint(0, 320)
        end = start + rng.randint(1, 12)
        assert covered.meets(start, end) == any(a < end and b > start for a, b in spans)
    many = " ".join(f"ann{i} (at) example{i} (dot) org" for i in range(100_000))
    assert len(pii.scan(many)[1]) == 100_000  # hours if each were compared with all before it
