"""Benchmark passages in documents, found by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ORACLE, materialize, named_key, query, quoted, slices, table, tidied

WINDOW = 10
#: Windows in one pattern table. More windows are searched in several passes, a table each.
TABLE_WINDOWS = 200_000
#: Upper case ASCII to lower case; digits, letters and bytes beyond ASCII stay; the rest separates words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
                   for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


class PatternTable:
    """Wu-Manber tables, one per pattern length: shifts by block of words, and buckets by suffix block."""

    def __init__(self, patterns: list[tuple[bytes, list]]):
        self.by_length: dict[int, tuple[int, dict, dict]] = {}
        for joined, items in patterns:
            pattern = tuple(joined.split(b" "))
            length = len(pattern)
            block = min(2, length)
            _, shifts, buckets = self.by_length.setdefault(length, (block, {}, {}))
            for end in range(block, length + 1):
                part = pattern[end - block:end]
                shifts[part] = min(shifts.get(part, length), length - end)
            buckets.setdefault(pattern[-block:], {})[pattern] = items

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, int, list]]:
        """(start, end, items) of every occurrence."""
        for length, (block, shifts, buckets) in self.by_length.items():
            end, last, skip = length, len(words), length - block + 1
            while end <= last:
                part = tuple(words[end - block:end])
                shift = shifts.get(part, skip)
                if shift:
                    end += shift
                    continue
                items = buckets[part].get(tuple(words[end - length:end]))
                if items is not None:
                    yield end - length, end, items
                end += 1


def merge_spans(spans: list[tuple[int, int]]) -> list[int]:
    """Union of spans as a flat list start, end, start, end, ..."""
    flat: list[int] = []
    for start, end in sorted(spans):
        if flat and start <= flat[-1]:
            flat[-1] = max(flat[-1], end)
        else:
            flat += [start, end]
    return flat


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """window (words joined by spaces), items: each distinct window with the ids of its items.

    An item of fewer than `size` words is one window. Items without words or without id give none.
    """
    def cut(batches):
        for batch in slices(batches):
            ids, out_ids, out = batch.column(0).to_pylist(), [], []
            for i, t in zip(ids, batch.column(1).to_pylist(), strict=True):
                words = words_of(t)
                for at in range(max(1, len(words) - size + 1) if words else 0):
                    out.append(b" ".join(words[at:at + size]))
                    out_ids.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(out_ids, pa.string())], ["window", "item"])

    rows = benchmark.filter(F.col(item).isNotNull()).select(F.col(item).cast("string"), F.col(text).cast("string"))
    return rows.mapInArrow(tidied(cut), "window binary, item string").groupBy("window").agg(F.collect_set("item").alias("items"))


def find_passages(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                  size: int = WINDOW, table_windows: int = TABLE_WINDOWS) -> DataFrame:
    """key, n_words, hits (merged word spans: start, end, ...), items (ids with an occurring window).

    One row per row of `docs`, in place: no shuffle. Pattern tables hold `table_windows` windows on
    average and are broadcast; a larger benchmark is searched table after table, with what has been
    found written in between. Null or empty texts have no words and no hits; an empty benchmark hits
    nothing; repeated rows and null keys are kept as they are; other columns are ignored.
    """
    spark = docs.sparkSession
    windows = materialize(benchmark_windows(benchmark, "item_id", "text", size), "bench-windows")
    passes = max(1, -(-windows.count() // table_windows))
    state = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.lit(0).cast("bigint").alias("n_words"),
                        F.array().cast("array<bigint>").alias("hits"), F.array().cast("array<string>").alias("items"))
    kind = state.schema["key"].dataType
    for k in range(passes):
        part = windows.filter(F.pmod(F.xxhash64("window"), F.lit(passes)) == k)
        shared = spark.sparkContext.broadcast(PatternTable([(bytes(r.window), list(r["items"])) for r in part.collect()]))
        last = k == passes - 1

        def search(batches, shared=shared, last=last):
            patterns = shared.value
            for batch in slices(batches):
                n_words, hits, items = [], [], []
                for t, old, known in zip(*(batch.column(c).to_pylist() for c in ("text", "hits", "items")), strict=True):
                    words = words_of(t)
                    spans, found = list(zip(old[::2], old[1::2], strict=True)), set(known)
                    for start, end, ids in patterns.occurrences(words):
                        spans.append((start, end))
                        found.update(ids)
                    n_words.append(len(words))
                    hits.append(merge_spans(spans))
                    items.append(sorted(found))
                cols = [batch.column("key")] + ([] if last else [batch.column("text")])
                cols += [pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, ["key"] + ([] if last else ["text"]) + ["n_words", "hits", "items"])

        state = state.mapInArrow(tidied(search), named_key(kind, f"{'' if last else 'text string, '}n_words bigint, hits array<bigint>, items array<string>"))
        if not last:
            state = materialize(state, "bench-hits")
    return state.withColumnRenamed("key", key)


def passage_report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of find_passages' rows."""
    spans = F.sequence(F.lit(0), F.size("hits") - 2, F.lit(2))
    length = F.when(F.size("hits") > 0, F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, i: a + F.get("hits", i + 1) - F.get("hits", i)))
    hit = F.coalesce(length, F.lit(0).cast("bigint"))
    return found.select(key, "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
                        (hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", table_windows: int = TABLE_WINDOWS) -> DataFrame:
    """Rows of `docs` without any benchmark window in `text`, each row judged by itself and in place."""
    whole = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), text)
    clean = find_passages(whole, benchmark, "row", text, table_windows=table_windows).filter(F.size("hits") == 0)
    return clean.select("row.*")


@query
def op2_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_report(find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def _oracle() -> str:
    """Every window of 1 to 10 document words beside the benchmark's windows, by word position."""
    words = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    grams = " UNION ALL ".join(
        f"SELECT doc_id, i, {n} AS n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS g "
        f"FROM doc_words WHERE {n} IN (SELECT n FROM bench)" for n in range(1, WINDOW + 1))
    return f"""
WITH docs AS (SELECT doc_id, coalesce({words}, []) AS w FROM documents),
items AS (SELECT item_id, {words} AS w FROM benchmark),
starts AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i
           FROM items WHERE len(w) > 0),
bench AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM starts),
doc_words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
grams AS ({grams}),
found AS (SELECT g.doc_id, g.i, g.n, b.item_id FROM grams g JOIN bench b ON b.n = g.n AND b.g = g.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)"""


ORACLE["op2_wu_manber_decontamination"] = _oracle()
