"""Set similarity join of word shingles with index-level and answer-level skipping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ORACLE, batch_rows, give_back, materialize, most_frequent, query, quoted, table, tidied, written
from .components import EDGES, Forest, components
from .shingles import WORDS, shingle_sets, signature

PERCENT = 85
#: Shingles counted together by a task; a shingle met in so many sets in all is frequent; so many of the
#: most frequent ones are known to every task. This only orders the shingles and decides no answer.
COUNTED, FREQUENT, KNOWN = 1_000_000, 16, 500_000
#: Index entries a task hands on at a time, and entries of a bucket of lists, on average.
HANDED, BUCKET = 250_000, 250_000
#: Lists up to this length are paired without blocks.
SHORT = 24
#: Pairs of a longer list that are compared at a time, and bytes of parity bits that its sets bring along at most.
PAIRS, BROUGHT = 50_000, 512
#: While all pairs of not yet connected sets in the lists are more than so many times the entries, lists
#: are compared with so many leaders each, and at most so often; then all pairs are compared.
DENSE, LEADERS, LIMITED_ROUNDS = 1, 4, 3
#: Sets compared with one leader at a time, and texts in one verification task, on average.
GROUP, TASK_TEXTS = 256, 800
#: Rows sent to Python at a time: some megabytes of texts.
BATCH_ROWS = 1_500
#: Slots of the filter that tells which texts are wanted: 16 to 32 for each, but 2 to the power of 27 (16 MB) at most.
LEAST_SLOTS, MOST_SLOTS = 16, 27
ENTRY = np.dtype([("token", "<i8"), ("id", "<i8"), ("n", "<i4"), ("pos", "<i4")])


def least_overlap(n, m, percent: int):
    """Smallest intersection with which sets of n and m members link."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def parity_bits(shingles: np.ndarray) -> bytes:
    """Parity of the members in each of 2n to 4n hash slots; two sets differ by as many members at least."""
    slots = 1 << max(6, int(2 * len(shingles) - 1).bit_length())
    return np.packbits(np.bincount(shingles & (slots - 1), minlength=slots).astype(np.uint8) & 1, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Lower bound of the number of members in one of two sets only, by their parity bits."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def parity_rows(bits: list[bytes | None]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Bytes of each set's parity bits, 0 where there are none; and for each such size the bits of all sets of as many or more."""
    size = np.array([len(b or b"") for b in bits], np.int64)
    rows = {}
    for least in np.unique(size[size > 0]).tolist():
        rows[least] = np.zeros((len(bits), least // 8), np.uint64)
        for width in np.unique(size[size >= least]).tolist():
            some = np.flatnonzero(size == width)
            parts = np.frombuffer(b"".join(bits[i] for i in some), np.uint64).reshape(len(some), -1, least // 8)
            rows[least][some] = np.bitwise_xor.reduce(parts, axis=1)
    return size, rows


def least_differences(size: np.ndarray, rows: dict[int, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """least_difference() of many pairs of sets, by their numbers in parity_rows(); 0 where bits are missing."""
    low, out = np.minimum(size[x], size[y]), np.zeros(len(x), np.int64)
    for least, every in rows.items():
        some = np.flatnonzero(low == least)
        out[some] = np.bitwise_count(every[x[some]] ^ every[y[some]]).sum(axis=1, dtype=np.int64)
    return out


def text_sets(batches: Iterator, words: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, shingle sets) of some rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield part.column(0).to_pylist(), list(shingle_sets(part.column(1), words))


PROFILE = "doc_id bigint, n bigint, s1 bigint, s2 bigint, bits binary, token bigint, times bigint"


def profile(batches: Iterator, words: int) -> Iterator:
    """A row per text: size, signature and parity bits of its set; and shingles that a task met repeatedly.

    Equal sets count once within a task, so exact copies make no shingle frequent.
    """
    held, size, seen = [], 0, set()

    def repeated() -> pa.RecordBatch:
        every = np.sort(np.concatenate(held)) if held else np.zeros(0, np.int64)
        starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        times = np.diff(np.append(starts, len(every)))
        some = times > 1
        return rows(token=pa.array(every[starts][some], pa.int64()), times=pa.array(times[some], pa.int64()))

    def rows(**cols) -> pa.RecordBatch:
        n = len(next(iter(cols.values())))
        kinds = {"bits": pa.binary()}
        names = ["doc_id", "n", "s1", "s2", "bits", "token", "times"]
        return pa.RecordBatch.from_arrays([cols.get(c, pa.nulls(n, kinds.get(c, pa.int64()))) for c in names], names)

    for ids, sets in text_sets(batches, words):
        signs = [signature(s) for s in sets]
        yield rows(doc_id=pa.array(ids, pa.int64()), n=pa.array([len(s) for s in sets], pa.int64()),
                   s1=pa.array([s[0] for s in signs], pa.int64()), s2=pa.array([s[1] for s in signs], pa.int64()),
                   bits=pa.array([parity_bits(s) for s in sets], pa.binary()))
        for sign, members in zip(signs, sets, strict=True):
            if sign not in seen:
                seen.add(sign)
                held.append(members)
                size += len(members)
        if size > COUNTED:
            yield repeated()
            held, size, seen = [], 0, set()
    yield repeated()


def ordered_prefix(shingles: np.ndarray, tokens: np.ndarray, times: np.ndarray, percent: int) -> np.ndarray:
    """The members that are indexed: rare shingles first, in hash order, then frequent ones by frequency."""
    length = prefix_length(len(shingles), percent)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, shingles), len(tokens) - 1)
        known = tokens[at] == shingles
        if known.any():
            frequent = shingles[known][np.argsort(times[at[known]], kind="stable")]
            return np.concatenate([shingles[~known], frequent])[:length]
    return shingles[:length]


def index_entries(batches: Iterator, tokens: np.ndarray, times: np.ndarray, percent: int, buckets: int, words: int) -> Iterator:
    """(bucket, entries) with each indexed shingle of each set, its set's id and size, and its position."""
    held, size, seen = [], 0, set()

    def handed() -> pa.RecordBatch:
        every = np.concatenate(held) if held else np.zeros(0, ENTRY)
        bucket = (every["token"] & 0x7FFFFFFF) % buckets
        order = np.argsort(bucket, kind="stable")
        every, bucket = every[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        full = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([every[cuts[b]:cuts[b + 1]].tobytes() for b in full], pa.binary())],
                                          ["bucket", "entries"])

    for ids, sets in text_sets(batches, words):
        for i, members in zip(ids, sets, strict=True):
            sign = signature(members)
            if i is None or not len(members) or sign in seen:
                continue
            seen.add(sign)
            first = ordered_prefix(members, tokens, times, percent)
            rows = np.zeros(len(first), ENTRY)
            rows["token"], rows["id"], rows["n"], rows["pos"] = first, i, len(members), np.arange(len(first))
            held.append(rows)
            size += len(rows)
        if size > HANDED:
            yield handed()
            held, size, seen = [], 0, set()
    yield handed()


def shared_lists(group: pa.Table) -> pa.Table:
    """Entries of a bucket whose shingle is indexed for more than one document."""
    every = np.frombuffer(b"".join(group["entries"].to_pylist()), ENTRY)
    every = every[np.argsort(every["token"], kind="stable")]
    same = every["token"][1:] == every["token"][:-1]
    kept = every[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(every) else every
    return pa.table([pa.array(kept["token"]), pa.array(kept["id"]), pa.array(kept["n"].astype(np.int64)), pa.array(kept["pos"].astype(np.int64))],
                    ["token", "doc_id", "n", "pos"])


def possible(n, p, m, q, percent: int):
    """Whether sets of n and m members can link if their first common shingle is at positions p and q."""
    return (np.minimum(n, m) * 100 >= percent * np.maximum(n, m)) & (np.minimum(n - p, m - q) >= least_overlap(n, m, percent))


def block_pairs(n: np.ndarray, pos: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one list that may link.

    The list lies in blocks of one position, ordered by size. For a set, the sizes of possible
    partners in a block are one range, known from the two positions: a block without such sizes is
    skipped unread, and of the others only the range is read.
    """
    order = np.lexsort((n, pos))
    cuts = np.flatnonzero(np.concatenate([[True], pos[order][1:] != pos[order][:-1], [True]]))
    blocks = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    share = percent / (100 + percent)
    for i, left in enumerate(blocks):
        p, sizes = pos[left[0]], n[left]
        for j in range(i, len(blocks)):
            right = blocks[j]
            q, others = pos[right[0]], n[right]
            low = np.maximum(sizes * percent / 100, (q + share * sizes) / (1 - share)) - 1e-6
            high = np.minimum(sizes * 100 / percent, (sizes - p) / share - sizes) + 1e-6
            if (low > others[-1]).all() or (high < others[0]).all():
                continue
            start, end = np.searchsorted(others, low), np.searchsorted(others, high, side="right")
            if i == j:
                start = np.maximum(start, np.arange(len(left)) + 1)
            every = np.maximum(end - start, 0)
            steps = [*np.searchsorted(every.cumsum(), np.arange(0, every.sum(), PAIRS)), len(left)]
            for at, to in zip(steps[:-1], steps[1:], strict=True):
                count = every[at:to]
                x = np.repeat(np.arange(at, to), count)
                y = np.arange(count.sum()) - np.repeat(count.cumsum() - count, count) + start[x]
                yield left[x], right[y]


def list_pairs(group: pa.Table, percent: int) -> pa.Table:
    """Distinct pairs (a < b) of sets that share a list, may link, and are not connected yet.

    In long lists the parity bits, where sets bring them along, rule out pairs before these become rows.
    """
    cols = {c: group[c].to_numpy() for c in ("token", "id", "n", "pos", "comp")}
    order = np.argsort(cols["token"], kind="stable")
    token, ids, n, pos, comp = (cols[c][order] for c in ("token", "id", "n", "pos", "comp"))
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, int)
    length = np.diff(np.append(starts, len(token)))
    mine = np.repeat(length, length)
    found = []

    def keep(x: np.ndarray, y: np.ndarray, at: int = 0, bits: tuple = ()) -> None:
        ok = (comp[x] != comp[y]) & (ids[x] != ids[y]) & possible(n[x], pos[x], n[y], pos[y], percent)
        x, y = x[ok], y[ok]
        if bits:
            near = n[x] + n[y] - 2 * least_overlap(n[x], n[y], percent) >= least_differences(*bits, x - at, y - at)
            x, y = x[near], y[near]
        found.append(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])], axis=1))

    for gap in range(1, SHORT):
        x = np.flatnonzero((token[gap:] == token[:-gap]) & (mine[gap:] <= SHORT))
        if len(x):
            keep(x, x + gap)
    for at, size in zip(starts[length > SHORT], length[length > SHORT], strict=True):
        bits = parity_rows(group["bits"].take(pa.array(order[at:at + size])).to_pylist())
        for x, y in block_pairs(n[at:at + size], pos[at:at + size], percent):
            keep(x + at, y + at, at, bits)
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def leader_pairs(entries: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a: leader, b) of every list: its sets against a few of them, the same in lists of the same sets.

    Every second leader is one of the smallest position: few shingles of its own come before the list's,
    so it is the likeliest to link with others. The rest are drawn.
    """
    drawn = [F.xxhash64("id", F.lit(LEADERS * turn + k)) for k in range(LEADERS)]
    order = [F.struct(F.floor(F.col("pos") / (1 + turn)) if k % 2 == 0 else F.lit(0), h) for k, h in enumerate(drawn)]
    picks = [F.min(F.struct(o.alias("o"), "id", "n", "pos", "comp")).alias(f"l{k}") for k, o in enumerate(order)]
    leaders = entries.groupBy("token").agg(*picks).select("token", F.explode(F.array(*[f"l{k}" for k in range(LEADERS)])).alias("l"))
    n, p, m, q = (F.col(c) for c in ("n", "pos", "l.n", "l.pos"))
    fits = ((F.least(n, m) * 100 >= percent * F.greatest(n, m))
            & (F.least(n - p, m - q) * (100 + percent) >= percent * (n + m)))
    pairs = entries.join(leaders, "token").filter((F.col("comp") != F.col("l.comp")) & fits)
    return pairs.select(F.col("l.id").alias("a"), F.col("id").alias("b")).distinct()


def with_bits(here: DataFrame, per: DataFrame, sketches: DataFrame) -> DataFrame:
    """Entries of lists whose sets aren't all connected; those of long lists with the parity bits of their set, if short."""
    opened = here.join(per.filter("m * m > s").select("token", "m"), "token")
    brief = sketches.filter(F.length("bits") <= BROUGHT).select(F.col("rep").alias("id"), "bits")
    columns = ["token", "id", "n", "pos", "comp", "bits"]
    short = opened.filter(F.col("m") <= SHORT).withColumn("bits", F.lit(None).cast("binary"))
    return short.select(columns).union(opened.filter(F.col("m") > SHORT).join(brief, "id", "left").select(columns))


def may_link(batches: Iterator, percent: int) -> Iterator:
    """Pairs that the parity bits don't rule out."""
    for batch in batches:
        a, b, n, m = (batch.column(c).to_pylist() for c in ("bits_a", "bits_b", "n_a", "n_b"))
        ok = [x + y - 2 * int(least_overlap(x, y, percent)) >= least_difference(s, t) for x, y, s, t in zip(n, m, a, b, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Members of `a` that are not in `b`; both ascending."""
    at = np.minimum(np.searchsorted(b, a), max(0, len(b) - 1))
    return a[b[at] != a] if len(b) else a


def group_links(lead: int, leader: np.ndarray, ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among a leader and sets close to it.

    A set is compared with the leader only. Its overlap with another one follows from the two
    differences to the leader: what the leader has and neither lacks, and what both have beyond it.
    """
    gone, new = [difference(leader, s) for s in sets], [difference(s, leader) for s in sets]
    n = np.array([len(s) for s in sets])
    forest, links = Forest(), []

    def link(a: int, b: int) -> None:
        if forest.join(a, b):
            links.append((a, b))

    direct = [len(leader) - len(g) >= least_overlap(len(leader), len(s), percent) for g, s in zip(gone, sets, strict=True)]
    for i, ok in zip(ids, direct, strict=True):
        if ok:
            link(lead, i)
    if all(direct) or len(sets) < 2:
        return links
    bounds_gone, bounds_new = (np.concatenate([[0], np.cumsum([len(x) for x in part])]) for part in (gone, new))
    all_gone, all_new = np.concatenate(gone), np.concatenate(new)

    def common(member: np.ndarray, every: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if not len(member) or not len(every):
            return np.zeros(len(sets), np.int64)
        at = np.minimum(np.searchsorted(member, every), len(member) - 1)
        return np.diff(np.concatenate([[0], np.cumsum(member[at] == every)])[bounds])

    lost = np.array([len(g) for g in gone])
    for u in (i for i, ok in enumerate(direct) if not ok):
        overlap = len(leader) - lost - lost[u] + common(gone[u], all_gone, bounds_gone) + common(new[u], all_new, bounds_new)
        for v in np.flatnonzero(overlap >= least_overlap(n, n[u], percent)):
            if v != u:
                link(ids[u], ids[v])
    return links


def verify(group: pa.Table, percent: int, words: int) -> pa.Table:
    """Links found in the leader groups of a task."""
    order = np.lexsort((group["part"].to_numpy(), group["a"].to_numpy()))
    group = group.take(pa.array(order)).combine_chunks()
    lead, part = group["a"].to_numpy(), group["part"].to_numpy()
    cuts = np.flatnonzero(np.concatenate([[True], (lead[1:] != lead[:-1]) | (part[1:] != part[:-1]), [True]])) if len(lead) else np.zeros(1, int)
    links = []
    for at, end in zip(cuts[:-1], cuts[1:], strict=True):
        rows = group.slice(at, end - at)
        ids = rows["id"].to_pylist()
        sets = list(shingle_sets(rows["text"].combine_chunks() if rows["text"].num_chunks != 1 else rows["text"].chunk(0), words))
        a = int(lead[at])
        for leader in [s for i, s in zip(ids, sets, strict=True) if i == a]:
            others = [(i, s) for i, s in zip(ids, sets, strict=True) if i != a]
            links += group_links(a, leader, [i for i, _ in others], [s for _, s in others], percent)
    give_back()
    return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])


def probably(texts: DataFrame, wanted: DataFrame, count: int) -> DataFrame:
    """Rows (doc_id, text) whose doc_id is in `wanted` (id), and a few others, picked where they are read.

    A one-hash filter of bounded size goes to all tasks, so that few of the other texts are shuffled.
    """
    slots = 1 << min(MOST_SLOTS, max(LEAST_SLOTS, (16 * count).bit_length()))
    slot = lambda c: F.xxhash64(c).bitwiseAND(F.lit(slots - 1))
    bit = F.expr("shiftleft(1L, cast(slot & 63 AS int))")
    words = wanted.select(slot("id").alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table_ = np.zeros(slots // 64, np.int64)
    table_[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(table_.tobytes())

    def pick(batches):
        bits = np.frombuffer(shared.value, np.uint64)
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            known = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            yield batch.select([0, 1]).filter(pa.array(known.astype(bool)))

    return texts.filter("doc_id IS NOT NULL").select("doc_id", "text", slot("doc_id").alias("slot")).mapInArrow(pick, "doc_id bigint, text string")


def confirmed(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """Links (a, b) that connect what `pairs` connects: exact, by the texts."""
    one = sketches.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    two = sketches.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    near = pairs.join(one, "a").join(two, "b").mapInArrow(tidied(lambda batches: may_link(batches, percent)), EDGES)
    near = materialize(near.distinct(), "join-pairs")
    parts = near.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    members = near.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("id"))
    wanted = materialize(members.union(members.select("a", "part", F.col("a").alias("id")).distinct()), "join-wanted")
    count = wanted.count()
    tasks, texts = max(1, -(-count // TASK_TEXTS)), probably(texts, wanted, count)
    rows = wanted.join(texts.hint("merge"), wanted["id"] == texts["doc_id"]).select("a", "part", "id", "text", F.pmod(F.xxhash64("a", "part"), F.lit(tasks)).alias("task"))
    return materialize(rows.groupBy("task").applyInArrow(lambda g: verify(g, percent, words), EDGES), "join-links")


def similarity_components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The components of similarity_join(), run with few texts at a time between Spark and Python."""
    with batch_rows(docs.sparkSession, BATCH_ROWS):
        return similarity_join(docs, percent, words)


def similarity_join(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs` (doc_id: integer, text).

    Two documents link when their sets of `words`-word shingles overlap in `percent` of their union or
    more; component_id is the smallest doc_id reachable by links. Rows without words, also null
    texts, link with nothing. Rows of one doc_id are one document, with the links of all of them. A
    row without doc_id stands alone and has no component. An empty table gives no rows; other columns
    are ignored. Shingles are told apart by 64-bit hashes within a pair of sets, equal sets by 128 bits.

    Equal sets are folded. A set is listed under its first shingles (rare ones first); only sets that
    share a list can link. Pairs of a list are limited by size and position, then by parity bits, and
    decided by the texts. Where lists are long, they are first compared with a few leaders: members
    close to a leader get their answers from the leader's, and connected ones need no more comparing.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialize(rows.mapInArrow(tidied(lambda batches: profile(batches, words)), PROFILE), "join-profile")
    texts = found.filter("token IS NULL")
    many = found.filter("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times")).filter(F.col("times") >= FREQUENT)
    many = most_frequent(many, "times", KNOWN).toArrow().sort_by("token")
    tokens, times = many["token"].to_numpy(), many["times"].to_numpy()
    known = docs.sparkSession.sparkContext.broadcast((tokens, times))

    usable = texts.filter("doc_id IS NOT NULL AND n > 0")
    folded = usable.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits"))
    folded = materialize(folded, "join-folded")
    sketches = folded.select("rep", "n", "bits")
    members = materialize(usable.select("doc_id", "s1", "s2", "n").join(folded.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"]).select(
        "doc_id", "n", "rep"), "join-members")

    total = usable.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).first()[0] or 0
    buckets = max(1, -(-int(total) // BUCKET))
    indexed = rows.mapInArrow(tidied(lambda batches: index_entries(batches, *known.value, percent, buckets, words)), "bucket bigint, entries binary")
    lists = indexed.groupBy("bucket").applyInArrow(shared_lists, "token bigint, doc_id bigint, n bigint, pos bigint")
    entries = lists.join(members.select("doc_id", "rep").distinct(), "doc_id").select("token", F.col("rep").alias("id"), "n", "pos").distinct()
    entries = materialize(entries, "join-entries")

    # A doc_id with several texts ties their sets together.
    same = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.collect_set("rep").alias("all")).filter("a <> b")
    links = materialize(same.select("a", F.explode("all").alias("b")).filter("a <> b"), "join-links")
    roots = None
    for turn in range(LIMITED_ROUNDS + 1):
        if roots is None:
            here = entries.withColumn("comp", F.col("id"))
        else:
            here = materialize(entries.join(roots, entries["id"] == roots["node"], "left").select(
                "token", "id", "n", "pos", F.coalesce("root", "id").alias("comp")), "join-round")
        per = here.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(
            F.sum("c").alias("m"), F.sum(F.col("c").cast("double") * F.col("c")).alias("s"))
        stats = per.filter("m * m > s").agg(F.sum("m").alias("entries"), F.sum((F.col("m").cast("double") * F.col("m") - F.col("s")) / 2).alias("pairs")).first()
        if not stats["pairs"]:
            break
        whole = stats["pairs"] <= DENSE * stats["entries"] or turn == LIMITED_ROUNDS
        if whole:
            tasks = max(1, -(-int(stats["entries"]) // BUCKET) * 4)
            pairs = with_bits(here, per, sketches).withColumn("task", F.pmod(F.xxhash64("token"), F.lit(tasks))).groupBy("task").applyInArrow(
                lambda g: list_pairs(g, percent), EDGES).distinct()
        else:
            pairs = leader_pairs(here, turn, percent)
        links = links.union(confirmed(pairs, sketches, rows, percent, words))
        roots = components(links)
        if whole:
            break
    if roots is None:
        roots = components(links)
    named = members.join(roots, members["rep"] == roots["node"], "left").select(
        "doc_id", F.coalesce("root", "rep").alias("component_id")).distinct()
    sizes = texts.select("doc_id", F.col("n").alias("n_shingles"))
    return sizes.join(named, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """`docs` with one row of each component: that of the smallest doc_id, one without doc_id at last.

    Each row is a document of its own here, also where doc_id is null or repeated.
    """
    own = written(docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct(*map(quoted, docs.columns)).alias("row")), "join-rows")
    found = similarity_components(own.select(F.col("row_id").alias("doc_id"), F.col("row.text").alias("text")), percent, words)
    found = materialize(found.select(F.col("doc_id").alias("row_id"), "component_id"), "join-found")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")
    first = found.join(own.select("row_id", "row.doc_id"), "row_id").groupBy("component_id").agg(F.min_by("row_id", order).alias("row_id"))
    gone = materialize(found.join(first.select("row_id"), "row_id", "left_anti").select("row_id"), "join-gone")
    return own.join(gone, "row_id", "left_anti").select("row.*")


@query
def op7_skipping_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents"))


ORACLE["op7_skipping_jaccard"] = """
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
grams AS (SELECT doc_id, i, count(*) OVER f AS k, string_agg(word, ' ') OVER f AS g FROM words
          WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
sets AS (SELECT DISTINCT doc_id, hash(g) AS g FROM grams WHERE k = 4 OR i = 1),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= 85 * (s.n + t.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM docs d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) r USING (doc_id)"""
