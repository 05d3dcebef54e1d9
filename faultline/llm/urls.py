"""URL filter: rules first, then the ratio of two character language models. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, query, table

#: (verdict, rule): host, then path prefix.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Characters of context at most, and characters that an unseen context gives equal chances.
ORDER, ALPHABET = 4, 256
START, END = "\u0002", "\u0003"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: One in so many labelled strings is kept from training and calibrates the threshold.
FOLDS = 5
MICRO, BIN = 1_000_000, 0.01


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, text of the models): host lower case; null, or no ://, gives empty host and path.

    The models read what follows ://, or the whole where there is none, in lower case and with each
    digit as 0; nothing where that is empty.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    read = F.translate(F.when(at > 0, rest).otherwise(url), UPPER + DIGITS, LOWER + "0" * 10)
    return F.translate(host, UPPER, LOWER), path, F.when(F.length(read) > 0, read)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does.

    `rules` is a configuration of some hundred rules at most, tested as one expression.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit("/" + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def positions(strings: DataFrame, order: int, *keep: str) -> DataFrame:
    """A row (gram, *keep) for each character of `read`, with the `order` characters before it."""
    padded = F.concat(F.lit(START * order), F.col("read"), F.lit(END))
    at = F.explode(F.sequence(F.lit(1), F.length("read") + 1)).alias("at")
    return strings.select(*keep, padded.alias("padded"), at).select(*keep, F.substr("padded", F.col("at"), F.lit(order + 1)).alias("gram"))


def log_ratios(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, llr: millionths of the log ratio of the last character's chance under two models.

    `grams` has gram, accepted, rejected: counts of each gram of the longest order (zeros where a gram
    is only to be scored). Each model interpolates all orders: a context counts against the next
    shorter one by how often it was met and how many different characters followed it (Witten-Bell).
    """
    chances = None
    for k in range(order + 1):
        cut = F.substr("gram", F.lit(order - k + 1))
        level = grams.groupBy(cut.alias("g")).agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
        context = Window.partitionBy(F.substr("g", F.lit(1), F.lit(k)))
        cols = [F.col("g"), F.substr("g", F.lit(2)).alias("shorter")]
        for c in ("accepted", "rejected"):
            cols += [F.col(c), F.sum(c).over(context).alias(f"{c}_all"), F.sum((F.col(c) > 0).cast("bigint")).over(context).alias(f"{c}_kinds")]
        level = level.select(*cols)
        if chances is None:
            level = level.withColumn("accepted_p", F.lit(1.0 / ALPHABET)).withColumn("rejected_p", F.lit(1.0 / ALPHABET))
        else:
            level = level.join(chances, "shorter")
        out = [F.col("g").alias("shorter" if k < order else "gram")]
        for c in ("accepted", "rejected"):
            met, kinds, below = F.col(f"{c}_all"), F.col(f"{c}_kinds"), F.col(f"{c}_p")
            out.append(F.when(met > 0, (F.col(c) + kinds * below) / (met + kinds)).otherwise(below).alias(f"{c}_p"))
        chances = level.select(*out)
    return chances.select("gram", F.round(F.log(F.col("accepted_p") / F.col("rejected_p")) * MICRO).cast("bigint").alias("llr"))


def threshold(scored: DataFrame) -> float:
    """The score from which on a URL is accepted: least mean of the two error rates on the strings kept
    from training; of equal ones the middle of a gap in the scores, nearest to 0; 0 if either kind is
    lacking. Scores are counted in bins."""
    cell = F.floor(F.col("score") / BIN).cast("int").alias("cell")
    rows = scored.filter("held AND accepted + rejected > 0").groupBy(cell).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).collect()
    rows = sorted((r.cell, r.a, r.r) for r in rows)
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return 0.0
    lost, caught, options = 0, 0, []
    for i, (cell, a, r) in enumerate(rows):
        before = rows[i - 1][0] + 1 if i else cell
        middle = (before + cell) / 2 * BIN
        options.append((round(lost / good - caught / bad, 9), abs(middle), middle))
        lost, caught = lost + a, caught + r
    return min(options)[2]


def judge_urls(pages: DataFrame, rules=RULES, order: int = ORDER, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, score of every row.

    A URL that a rule fits has the verdict of the longest one. The URLs allowed by rules train one
    model, the blocked ones another, all of them counted; score is the mean log ratio per character,
    and the others are allowed from a score on that separates held-out labelled URLs best. Equal texts
    are counted and scored once. Without any allowed or any blocked URL the ratio still ranks, against
    threshold 0. A null or empty URL without a fitting rule is blocked and has no score. Repeated rows
    and null keys are rows like others; an empty table gives no rows; other columns are ignored.
    """
    host, path, read = split_url(F.col(url).cast("string"))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"), read.alias("read"))
    rows = rows.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    strings = rows.filter("read IS NOT NULL").groupBy("read").agg(
        F.count_if(F.col("fit.verdict") == "allow").alias("accepted"), F.count_if(F.col("fit.verdict") == "block").alias("rejected"))
    strings = materialize(strings.withColumn("held", F.pmod(F.xxhash64("read"), F.lit(FOLDS)) == 0), "url-strings")
    counted = strings.withColumns({c: F.when(F.col("held"), 0).otherwise(F.col(c)) for c in ("accepted", "rejected")})
    grams = materialize(positions(counted, order, "accepted", "rejected").groupBy("gram").agg(
        F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "url-grams")
    sums = positions(strings, order, "read").join(log_ratios(grams, order), "gram").groupBy("read").agg(F.sum("llr").alias("llr"), F.count("*").alias("n"))
    score = F.round(F.col("llr") / F.col("n") / MICRO, 6).alias("score")
    scored = materialize(strings.join(sums.select("read", score), "read"), "url-scores")
    limit = threshold(scored)
    judged = rows.join(scored.select("read", "score"), "read", "left")
    method = F.when(F.col("score") >= limit, "allow").otherwise("block")
    return judged.select(F.col("key").alias(key), "host", "path", F.col("fit.rule").alias("rule"),
                         F.coalesce(F.col("fit.verdict"), method).alias("verdict"), "score")


@query
def op1_markov_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
