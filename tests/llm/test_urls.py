"""URL filter against a plain Python model."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from faultline.llm import urls

DDL = "page_id bigint, url string, host string, score string"


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = []
    for verdict, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return host, path, max(fits)[1:] if fits else None


def addresses():
    rng = random.Random(21)
    good, bad = ["news", "garden", "library", "music"], ["casino", "pills", "xxx", "warez"]
    rows = []
    for _ in range(400):
        kind = rng.random() < 0.5
        word, tld, path = (rng.choice(good), "com", "de") if kind else (rng.choice(bad), "net", "es")
        if rng.random() < 0.3:
            tld, path = "org", "en"
        rows.append(f"http://{rng.choice(['www.', ''])}{word}{rng.choice(good if kind else bad)}.{tld}/{path}/{rng.randrange(999)}")
    rows += [None, "", "no scheme", "HTTP://EXAMPLE.COM/en/x", "http://www.example.com/en/", "http://a.www.example.com/en/?q", "https://example.com/en?x=/",
             "http://com/", "http://xcom/", "http://net/fr/", "http://É.NET/es/1", "a://b://c.com/", "://com/#", "http://host.com", "http://h.net/es\n/", "x://" + "y" * 5_000]
    return rows + rows[:30]


def test_rules_and_model(spark):
    rows = list(enumerate(addresses())) + [(None, "http://a.com/")]
    frame = spark.createDataFrame([(i, u, "h", "s") for i, u in rows], DDL)
    got = urls.judge_urls(frame).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    right = total = 0
    for i, url in rows:
        host, path, rule = brute_rule(url)
        r = by_id[i]
        assert (r.host, r.path, r.rule) == (host, path, rule[0] if rule else None), url
        if rule:
            assert r.verdict == rule[1]
        elif url and ".org/" in url:
            total += 1
            right += r.verdict == ("allow" if any(w in url for w in ("news", "garden", "library", "music")) else "block")
    assert right > 0.95 * total > 50
    assert by_id[400].verdict == by_id[401].verdict == "block" and by_id[400].score is None


def test_ratios_equal_plain_witten_bell(spark):
    rng = random.Random(22)
    strings = [("".join(rng.choice("abc/0") for _ in range(rng.randrange(1, 12))), rng.randrange(3), rng.randrange(3)) for _ in range(60)]
    frame = spark.createDataFrame(strings, "read string, accepted bigint, rejected bigint")
    grams = urls.positions(frame, 2, "accepted", "rejected").groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    got = {r.gram: r.llr for r in urls.log_ratios(grams, 2).collect()}
    models = []
    for which in (1, 2):
        follow = defaultdict(Counter)
        for row in strings:
            text = "\u0002\u0002" + row[0] + "\u0003"
            for i in range(2, len(text)):
                for k in range(3):
                    if row[which]:
                        follow[text[i - k:i]][text[i]] += row[which]
        models.append(follow)

    def chance(follow, context, char):
        below = chance(follow, context[1:], char) if context else 1 / 256
        seen = follow.get(context)
        if not seen:
            return below
        return (seen[char] + len(seen) * below) / (sum(seen.values()) + len(seen))

    assert got
    for gram, llr in got.items():
        want = math.log(chance(models[0], gram[:-1], gram[-1]) / chance(models[1], gram[:-1], gram[-1]))
        assert abs(llr - want * 1e6) <= 1


def test_empty_and_one_sided(spark):
    assert urls.judge_urls(spark.createDataFrame([], DDL)).collect() == []
    one = urls.judge_urls(spark.createDataFrame([(1, "http://a.org/", "", "")], DDL)).collect()
    assert one[0].verdict in ("allow", "block") and one[0].rule is None
