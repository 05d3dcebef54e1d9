"""Packing: every id once, tokens as the tokenizer gives them, gapless sequences."""

import random
import struct
import zlib

import pytest
from faultline.llm import packing

PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
DDL = "doc_id bigint, text string, start string, length string"


def test_word_ids_equal_whole_text_ids():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    alphabet = ["the", "Don't", "x1y22", "Ünï", "ΣΑΣ", "é", "<|endoftext|>", "!!", "日本", "Gefäß,", "ÇA!?", "A", "don't.", "it'S", "end.\u0301", "ÿ", "Ω;", "%%%", "İ", "$$$,", " ", "  ", "\n", "\t", "\r", "\x0b", "\x0c",
                "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", " ", " ", " ", " ", " ", " ", "　",
                "​", "﻿", "\x00", "́"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(600)]
    for text, got in zip(texts, packing.WordIds(PATH, keep=50).of(texts), strict=True):
        ids = whole.encode(text, add_special_tokens=False).ids
        assert got == struct.pack(f"<{len(ids)}I", *ids), repr(text)


def test_words_are_learnt_in_small_lots_and_few_are_kept():
    """A slice of many new words is not learnt at once, and a worker can be told to keep fewer words."""
    ids, lots = packing.WordIds(PATH, keep=300), []
    learn = ids._learn
    ids._learn = lambda words: (lots.append(len(words)), learn(words))
    texts = [f"{i}x y{i}." for i in range(packing.LEARN_WORDS)] + ["the end."] * 3
    once = packing.WordIds(PATH)
    assert list(ids.of(texts)) == [b for t in texts for b in once.of([t])]
    assert sum(lots) > packing.LEARN_WORDS >= max(lots)
    assert len(packing.kept_word_ids(PATH, 300).known) == 0 and packing.kept_word_ids(PATH, 300).keep == 300
    assert packing.kept_word_ids(PATH).keep == packing.CACHE_WORDS


def test_tree_equals_plain_first_fit():
    rng = random.Random(2)
    for n in (0, 1, 2, 5, 64, 200):
        sizes = [rng.randrange(1, 101) for _ in range(n)]
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        fill, want = [], {}
        for i in sorted(range(n), key=lambda i: (-sizes[i], i)):
            b = next((b for b, f in enumerate(fill) if f + sizes[i] <= 100), len(fill))
            if b == len(fill):
                fill.append(0)
            want[i] = (b, fill[b])
            fill[b] += sizes[i]
        assert {i: (bins[i], offsets[i]) for i in range(n)} == want


def check(rows, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    want = sorted(((i is None, i or 0), tuple(whole.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in texts)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows if r.start == 0) == [w[0] for w in want]
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for (_, doc), ids in want:
        for at in range(0, len(ids), 2048):
            part = ids[at:at + 2048]
            key = next(k for k in pieces if (k[0] or 0) == doc and k[1] == len(ids))
            assert (at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))) in pieces[key]
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    return sequences


def test_documents(spark):
    rng = random.Random(4)
    big = 2**60 + 1
    texts = [(i, " ".join(rng.choice(["the", "of", "quick", "brown,"]) for _ in range(rng.randrange(900)))) for i in range(300)]
    texts += [(None, "no id"), (big, "large id"), (500, ""), (501, None), (502, "word " * 30_000), (503, "same"), (503, "same")]
    rows = packing.pack(spark.createDataFrame([(i, t, "s", "l") for i, t in texts], DDL), PATH, group_docs=64).collect()
    sequences = check(rows, texts)
    assert big in {r.doc_id for r in rows}
    filled = sum(n for parts in sequences.values() for _, n in parts)
    assert len(sequences) * 2048 < 1.06 * filled


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], DDL), PATH).collect() == []
