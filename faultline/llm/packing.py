"""Documents packed into token sequences: first-fit decreasing on a tournament tree, in random groups."""

from __future__ import annotations

import gc
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, kept, materialize, query, slices, table

SEQUENCE, END_ID = 2048, 1
#: Mean number of documents in a group, and words whose ids a worker keeps.
GROUP_DOCS, CACHE_WORDS = 4_096, 1_000_000
#: New words learnt at a time: what that takes besides their ids is no more for a slice of long texts.
LEARN_WORDS = 4_000
#: A word of Latin letters, perhaps with marks behind: two units of the tokenizer, whatever stands around.
UNITS = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?#$%&*]*)")
#: White space for Python's split() that the tokenizer takes for ordinary characters.
ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


class WordIds:
    """Token ids of texts as little-endian unsigned 32-bit bytes; ids of words are kept.

    The tokenizer never joins across white space, so a text's ids are those of its words in a row. A
    word of letters with marks behind is two of its units, and case is folded, so the ids of the two
    are kept once for all words that share them.
    """

    def __init__(self, path: str, keep: int = CACHE_WORDS):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        assert array("I").itemsize == 4 and sys.byteorder == "little"
        self.tokenizer, self.keep, self.known, self.units = Tokenizer.from_file(path), keep, {}, {"": b""}
        # Units are lower case and parted by blanks already: the same model without the work before it.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = frozenset(i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>"))

    def _encode(self, texts: list[str], tokenizer=None) -> Iterator[list[int]]:
        for at in range(0, len(texts), 10_000):
            for e in (tokenizer or self.tokenizer).encode_batch_fast(texts[at:at + 10_000], add_special_tokens=False):
                yield e.ids

    def _learn_units(self, units: list[str]) -> None:
        """Many units in one text, told apart by the tokens that end one; singly where that fails."""
        parts = [units[at:at + 200] for at in range(0, len(units), 200)]
        for part, ids in zip(parts, self._encode([" ".join(p) for p in parts], self.plain), strict=True):
            cuts = [4 * i for i, t in enumerate(ids, 1) if t in self.ends]
            if len(cuts) == len(part):
                flat = array("I", ids).tobytes()
                self.units.update(zip(part, [flat[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))
            else:
                self.units.update(zip(part, [array("I", e).tobytes() for e in self._encode(part)], strict=True))

    def _learn(self, words: list[str]) -> None:
        fits = [(w, UNITS.fullmatch(w)) for w in words]
        split = [w for w, m in fits if m]
        letters, marks = [m[1].lower() for _, m in fits if m], [m[2] for _, m in fits if m]
        self._learn_units([u for u in {*letters, *marks} if u not in self.units])
        ids = self.units.__getitem__
        self.known.update(zip(split, map(add, map(ids, letters), map(ids, marks)), strict=True))
        others = [w for w, m in fits if not m]
        self.known.update(zip(others, [array("I", e).tobytes() for e in self._encode(others)], strict=True))

    def of(self, texts: list[str]) -> Iterator[bytes]:
        split = [t.split() if not any(c in t for c in ODD_SPACE) else [t] for t in texts]
        every = set().union(*split)
        if len(self.known) + len(every) > self.keep:
            self.known, self.units = {}, {"": b""}
        new = [w for w in every if w not in self.known]
        for at in range(0, len(new), LEARN_WORDS):
            self._learn(new[at:at + LEARN_WORDS])
        for words in split:
            yield b"".join(map(self.known.__getitem__, words))


def kept_word_ids(path: str, keep: int = CACHE_WORDS) -> WordIds:
    """What this worker process has learnt of the tokenizer: it serves many tasks one after the other."""
    return kept(f"{keep} words of {path}", lambda: WordIds(path, keep))


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each item: the largest first, each into the first bin with room.

    A tournament tree holds the room of the bins; each inner node the largest room below it, so the
    first bin with enough room is found by one walk from the root.
    """
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < sizes[item]:
                node += 1
        bins[item], offsets[item] = node - leaves, capacity - room[node]
        room[node] -= sizes[item]
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


def tokenize(docs: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID,
             key: str = "doc_id", text: str = "text", keep_words: int = CACHE_WORDS) -> DataFrame:
    """key, doc_tokens, crcs (of each piece of up to `sequence` ids), salt: one row per row of `docs`."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    last = end_id.to_bytes(4, "little")

    def encode(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.disable()  # a great many small objects, none in cycles
        try:
            ids_of, place = kept_word_ids(path, keep_words), 0
            for batch in slices(batches):
                tokens, crcs, salts = [], [], []
                for ids in ids_of.of(batch.column("text").to_pylist()):
                    view = memoryview(ids + last)
                    tokens.append(len(view) // 4)
                    crcs.append([zlib.crc32(view[at:at + 4 * sequence]) for at in range(0, len(view), 4 * sequence)])
                    salts.append(place)
                    place += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(salts, pa.int64())],
                    ["key", "doc_tokens", "crcs", "salt"])
        finally:
            gc.enable()
            give_back()

    return rows.mapInArrow(encode, f"key {kind}, doc_tokens bigint, crcs array<bigint>, salt bigint").withColumnRenamed("key", key)


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID,
         group_docs: int = GROUP_DOCS, key: str = "doc_id", text: str = "text", keep_words: int = CACHE_WORDS) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    Each row of `docs` is tokenized whole and ends with `end_id`; a null or empty text has that id
    only. It is cut at multiples of `sequence`; full pieces are sequences by themselves, the rests are
    packed by first-fit decreasing within random groups of about `group_docs` rows. Repeated rows and
    null keys are documents like others; an empty table gives no rows; other columns are ignored.
    `path` is the tokenizer file, which must be readable on every executor. A worker keeps the ids of
    `keep_words` words: fewer take less memory and more time.
    """
    rows = materialize(tokenize(docs, path, sequence, end_id, key, text, keep_words), "pack-tokens")
    groups = max(1, -(-rows.count() // group_docs))
    pieces = rows.withColumn("pack_group", F.pmod(F.xxhash64(key, "doc_tokens", F.col("crcs")[0], "salt"), F.lit(groups))).select(
        F.col(key).alias("key"), "doc_tokens", "pack_group", F.posexplode("crcs").alias("at", "ids_crc32")).select(
        "key", "doc_tokens", "pack_group", (F.col("at") * sequence).cast("bigint").alias("start"), "ids_crc32",
        F.least(F.lit(sequence).cast("bigint"), F.col("doc_tokens") - F.col("at") * sequence).alias("length"))
    kind = rows.schema[key].dataType.simpleString()

    def place(group: pa.Table) -> pa.Table:
        bins, offsets = first_fit_decreasing(group["length"].to_pylist(), sequence)
        first = group["pack_group"][0].as_py() * 2**32
        cols = [group[c] for c in ("key", "doc_tokens", "start", "ids_crc32", "length")]
        cols += [pa.array([first + b for b in bins], pa.int64()), pa.array(offsets, pa.int64())]
        return pa.table(cols, ["key", "doc_tokens", "start", "ids_crc32", "length", "sequence_id", "offset"])

    placed = pieces.groupBy("pack_group").applyInArrow(
        place, f"key {kind}, doc_tokens bigint, start bigint, ids_crc32 bigint, length bigint, sequence_id bigint, offset bigint")
    return placed.select(F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op8_tree_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
