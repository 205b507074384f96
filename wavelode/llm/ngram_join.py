"""N-gram Jaccard join: T-occurrence search with DivideSkip over inverted lists of word shingles.

``similar_components`` links two texts when ``den * |A & B| >= num * |A | B|`` for their sets of
distinct ``k``-word shingles, and gives every row the smallest id it reaches by links.

1. One scan gives every row a 128-bit digest of its word sequence and its set size, and a sketch of
   how many rows hold each shingle (2**20 counters of all shingles of all rows, summed over tasks).
   Rows of one digest are copies: they share a node.
2. A second scan orders each set from rare to common by the sketch and emits its prefix
   (``n - ceil(t n) + 1`` shingles): similar sets share a shingle there, whatever the order.
3. Rows are met by shingle.  A shingle that the sketch takes for frequent is dealt over several tasks, about
   ``RUN`` rows each, by the digests; the places in its run go on from task to task, and its few pivots are sent to
   all of them.  In a run, sorted by how many shingles a row shares, the first few rows - the
   ones with the fewest shingles of their own - are pivots; a pivot is paired with the rows after it
   that pass the size and position bounds and are not yet in its component.  Later rounds take
   eight times as many pivots from the runs that still span components, until none is left.  Thus a
   group of near copies costs a star, not all its pairs, and no pair between components is skipped.
4. A pair whose 1024-bit parity signatures differ in more bits than the sets may differ in elements
   is out: the sets of such pairs, which share a shingle by chance, are never fetched.
5. A pivot and a block of at most about ``BLOCK`` partners and ``BLOCK_SHINGLES`` shingles are searched with DivideSkip: the long
   inverted lists are set aside, the short ones heap-merged with skips, and what the heap yields is
   probed in the long ones by binary search.  A count that reaches the required overlap is the exact
   size of the intersection.

Null and empty texts have the empty set: ``n_shingles`` 0, linked with nothing, their own component.
A text of fewer than ``k`` words has its whole sequence as one shingle.  Rows with a null id keep
their counts, link with nothing and have a null component.  Repeated ids with unlike texts are rows of
their own.  Other columns of the input are ignored here.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from xxhash import xxh3_64_intdigest

from . import common

SKETCH_BITS = 20
SIGNATURE_BITS = 1024
CHUNKS = 64
BLOCK = 256
FIRST_PIVOTS = 1
GROWTH = 8
#: Pivots of a run that a task holds at once.
MOST_PIVOTS = 4096
#: Rows of a shingle, by the sketch, that one task takes; those of a more frequent one are dealt over tasks.
RUN = 256
#: Shingles of all sets that a block of partners holds at most, unless it is a single set.
BLOCK_SHINGLES = 500_000
NUMBERED = "token long, part int, pos int, n int, node long, place int"
#: Rows up to which a list of node ids (8 bytes each) is broadcast to filter a scan; above, a join filters it.
BROADCAST_IDS = 100_000
#: DivideSkip's weight of a probe against a merge step.
MU = 0.0085

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


#: Bytes of text whose words are told apart at once.
BLOCK_BYTES = 3_000_000


def word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """The 64-bit hashes of each text's words: A-Z in lower case, split at ASCII white space."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES, side="right")))
        block = common.whole_strings(texts.slice(at, upto - at))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(block))
        coded = lists.flatten().dictionary_encode()
        unlike = coded.dictionary.cast(pa.large_binary()).to_pylist()
        hashes = np.fromiter(map(xxh3_64_intdigest, unlike), np.uint64, len(unlike))
        codes = coded.indices.to_numpy(zero_copy_only=False)
        cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        real = np.fromiter(map(len, unlike), np.int64, len(unlike)).astype(bool)[codes]  # white space at an end leaves empty words
        if not real.all():
            cuts, codes = np.r_[0, np.cumsum(real)][cuts], codes[real]
        words = hashes[codes]
        for i in range(upto - at):
            yield words[cuts[i] : cuts[i + 1]]
        at = upto


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of hashed words."""
    if not len(words):
        return np.empty(0, np.uint64)
    width = min(k, len(words))
    n = len(words) - width + 1
    s = np.full(n, np.uint64(width), np.uint64)
    for i in range(width):
        s = _mix(s * _M1 + words[i : n + i])
    return np.unique(s)


def signature(grams: np.ndarray) -> bytes:
    """Bit i: whether an odd number of shingles falls to i.  Two signatures differ in no more bits than their sets differ in elements."""
    return np.packbits(np.bincount((grams & np.uint64(SIGNATURE_BITS - 1)).astype(np.int64), minlength=SIGNATURE_BITS) & 1).tobytes()


def sequence_digest(words: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(words.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _columns(batch: pa.RecordBatch, *names: str) -> list:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def _arrays(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def _digest_scan(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << SKETCH_BITS, np.int64), set()
        shift, pending = np.uint64(64 - SKETCH_BITS), []
        schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("n", pa.int32()), ("sig", pa.binary()), ("chunk", pa.int32()), ("counts", pa.binary())])

        def flush() -> None:
            if pending:
                np.add(counts, np.bincount(np.concatenate(pending) >> shift, minlength=1 << SKETCH_BITS), out=counts)
                pending.clear()

        held = 0
        for batch in common.slices(batches, 1024):
            (ids,) = _columns(batch, "id")
            d1, d2, n, sig = [], [], [], []
            for words in word_hashes(batch.column(1)):
                if not len(words):
                    d1.append(None), d2.append(None), n.append(0), sig.append(None)
                    continue
                d = sequence_digest(words)
                s = shingle_set(words, k)
                d1.append(d[0]), d2.append(d[1]), n.append(len(s)), sig.append(signature(s))
                if d not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(d)
                    pending.append(s)
                    held += len(s)
                    if held > 1_000_000:
                        flush()
                        held = 0
            none = pa.nulls(len(ids), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column(2), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(n, pa.int32()), pa.array(sig, pa.binary()), none, pa.nulls(len(ids), pa.binary())], schema=schema)
        flush()
        size = len(counts) // CHUNKS
        rows = [(c, zlib.compress(part.astype("<u4").tobytes(), 1)) for c in range(CHUNKS) if (part := counts[c * size : (c + 1) * size]).any()]
        empty = pa.nulls(len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([empty, empty, empty, empty, pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=schema)

    return run


def _add_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums what meets in this partition and keeps half-octaves of the counts, a byte each."""
    sums: dict[int, np.ndarray] = {}
    for batch in common.slices(batches, 64):
        for chunk, data in zip(*_columns(batch, "chunk", "counts"), strict=True):
            part = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)
            if chunk in sums:
                sums[chunk] += part
            else:
                sums[chunk] = part
    levels = [(c, np.where(v > 0, 1 + np.floor(2 * np.log2(np.maximum(v, 1))), 0).astype(np.uint8).tobytes()) for c, v in sums.items()]
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in levels], pa.int32()), pa.array([x[1] for x in levels], pa.binary())], names=["chunk", "levels"])


def _prefix_scan(k: int, num: int, den: int, levels_of, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, levels = set(), np.frombuffer(levels_of.value, np.uint8)
        shift = np.uint64(64 - SKETCH_BITS)
        for batch in common.slices(batches, 1024):
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for words in word_hashes(batch.column(0)):
                if not len(words) or (d := sequence_digest(words)) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(d)
                s = shingle_set(words, k)
                n = len(s)
                p = n - -(-num * n // den) + 1
                level = levels[s >> shift]
                order = np.argsort(level, kind="stable")[:p]  # s is sorted: ties go by hash
                keep = np.flatnonzero(level[order] > 1)  # a count of 1 is this row's own
                out[0].append(s[order[keep]].view(np.int64))
                # part 0: a rare shingle, all of it; else one of the parts that its count asks for, from 1
                parts = np.maximum(np.ceil(2.0 ** ((level[order[keep]].astype(float) - 1) / 2) / most), 1).astype(np.int64)
                out[5].append(np.where(parts > 1, (d[0] >> 1) % parts + 1, 0).astype(np.int32))
                out[1].append(keep.astype(np.int32))
                for i, v, t in ((2, n, np.int32), (3, d[0], np.int64), (4, d[1], np.int64)):
                    out[i].append(np.full(len(keep), v, t))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["token", "pos", "n", "d1", "d2", "part"])

    return run


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token, part and digest, those whose token has another digest, or has parts; copies once."""
    names = ["token", "pos", "n", "d1", "d2", "part"]
    last: list[np.ndarray] | None = None  # the last distinct row, and whether its token came before
    met = False

    def emit(cols: list[np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = _arrays(batch, *names)
        if last is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(last, cols, strict=True)]
        token, d1, d2, part = cols[0], cols[3], cols[4], cols[5]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (part[1:] != part[:-1]) | (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
        cols = [c[fresh] for c in cols]
        token = cols[0]
        same = token[1:] == token[:-1]
        keep = cols[5] > 0
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= met and last is not None
        last = [c[-1:] for c in cols]
        met = bool(keep[-1])
        keep[-1] = False
        yield emit(cols, keep)
    if last is not None and met:
        yield emit(last, np.ones(1, bool))


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a row's keys are unlike the row's before."""
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(fresh)


def _number_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's place in its part of its run."""
    last, at = None, 0
    for batch in batches:
        token, part = _arrays(batch, "token", "part")
        if not len(token):
            continue
        starts = _starts(token, part)
        place = np.arange(len(token)) - np.repeat(starts, np.diff(np.r_[starts, len(token)]))
        if (token[0], part[0]) == last:
            place[: starts[1] if len(starts) > 1 else None] += at
        last, at = (token[-1], part[-1]), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place.astype(np.int32))], names=[*batch.schema.names, "place"])


def _run_on(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places that go on over the parts of a run, and ``(token, part, before)`` of the parts: the rows in the parts before."""
    sizes = numbered.where("part > 0").groupBy("token", "part").agg(F.count(F.lit(1)).cast("int").alias("size"))
    order = Window.partitionBy("token").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    parts = common.stage(sizes.select("token", "part", F.coalesce(F.sum("size").over(order), F.lit(0)).cast("int").alias("before")), "ngram-parts")
    whole = numbered.where("part = 0")
    dealt = numbered.where("part > 0").join(parts, ["token", "part"]).withColumn("place", (F.col("place") + F.col("before")).cast("int")).select(numbered.columns)
    return whole.union(dealt), parts


def _emit_pairs(low: int, high: int, num: int, den: int):
    """Pairs (pivot, later row of the run) for the pivots at places low to high - 1, which come first in each part of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 7), np.int64)  # the pivots of the run that the last batch left open
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.astype(np.int64) for c in _arrays(batch, "token", "place", "n", "pos", "node", "comp", "part")], axis=1)
            if len(held) and (held[0, 0], held[0, 6]) != (rows[0, 0], rows[0, 6]):
                held = held[:0]
            ghosts = len(held)
            rows = np.concatenate([held, rows])
            token, place, n, pos, node, comp, part = rows.T
            starts = _starts(token, part)
            counts = np.diff(np.r_[starts, len(rows)])
            start, end = np.repeat(starts, counts), np.repeat(starts + counts, counts)
            a, b = [], []
            for j in range(low, min(high, int(place.max()))):
                pivot = start + (j - place[start])
                at = np.flatnonzero((place > j) & (pivot >= start) & (pivot < end))
                at = at[at >= ghosts]
                p = pivot[at]
                need = -(-num * (n[at] + n[p]) // (num + den))
                ok = (place[p] == j) & (comp[at] != comp[p]) & (den * np.minimum(n[at], n[p]) >= num * np.maximum(n[at], n[p])) & (np.minimum(n[at] - pos[at], n[p] - pos[p]) >= need)
                a.append(node[p[ok]]), b.append(node[at[ok]])
            last = rows[starts[-1] :]
            held = last[(last[:, 1] >= low) & (last[:, 1] < high)]
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0) if a else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["p", "x"])

    return run


def _near_signatures(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, x, np_, nx = (c.astype(np.int64) for c in _arrays(batch, "p", "x", "np", "nx"))
            a, b = (np.frombuffer(b"".join(c), np.uint8).reshape(len(p), -1) for c in _columns(batch, "sp", "sx"))
            apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
            keep = apart <= np_ + nx - 2 * -(-num * (np_ + nx) // (num + den))
            yield pa.RecordBatch.from_arrays([pa.array(p[keep]), pa.array(x[keep]), pa.array(nx[keep])], names=["p", "x", "nx"])

    return run


def divide_skip(lists: list[list[int]], need: int) -> dict[int, int]:
    """Ids that at least ``need`` of the sorted ``lists`` hold, with their counts."""
    lists = sorted((x for x in lists if x), key=len)
    if len(lists) < need:
        return {}
    longest = len(lists[-1])
    aside = max(0, min(need - 1, int(need / (MU * np.log2(longest + 1) + 1))))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    least, found = need - aside, {}
    heap = [(x[0], i, 0) for i, x in enumerate(short)]
    heapq.heapify(heap)
    while len(heap) >= least:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            count = len(popped)
            for i, x in enumerate(long):
                if count + len(long) - i < need:
                    break
                j = bisect_left(x, top)
                count += j < len(x) and x[j] == top
            if count >= need:
                found[top] = count
            beyond = top + 1
        else:
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            beyond = heap[0][0]
        for _, i, j in popped:
            j = bisect_left(short[i], beyond, j)
            if j < len(short[i]):
                heapq.heappush(heap, (short[i][j], i, j))
    return found


def search_block(query: np.ndarray, members: list[np.ndarray], num: int, den: int) -> list[int]:
    """Places of the members whose Jaccard similarity with ``query`` reaches num / den."""
    sizes = [len(m) for m in members]
    owner = np.repeat(np.arange(len(members)), sizes)
    every = np.concatenate(members)
    at = np.searchsorted(query, every)
    at[at == len(query)] = 0
    hit = query[at] == every
    at, owner = at[hit], owner[hit]
    order = np.argsort(at, kind="stable")  # owners ascend within a token
    at, owner = at[order], owner[order]
    cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
    owners = owner.tolist()
    lists = [owners[s:e] for s, e in zip(cuts, [*cuts[1:], len(owners)], strict=True)]
    need = [-(-num * (len(query) + n) // (num + den)) for n in sizes]
    return sorted(x for x, count in divide_skip(lists, max(1, min(need))).items() if count >= need[x])


def _search(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, query, ids, sets = None, None, [], []

        def done() -> list[tuple[int, int]]:
            return [(key[0], ids[i]) for i in search_block(query, sets, num, den)] if ids else []

        for batch in common.slices(batches):
            links = []
            for p, block, x, grams in zip(*_columns(batch, "p", "block", "x", "grams"), strict=True):
                if (p, block) != key:
                    links += done()
                    key, query, ids, sets = (p, block), None, [], []
                values = np.frombuffer(grams, np.uint64)
                if x is None:
                    query = values
                elif not ids or ids[-1] != x:  # repeated rows come one after the other
                    ids.append(x), sets.append(values)
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in links], pa.int64()), pa.array([v[1] for v in links], pa.int64())], names=["a", "b"])
        links = done()
        yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in links], pa.int64()), pa.array([v[1] for v in links], pa.int64())], names=["a", "b"])

    return run


def _set_scan(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1024):
            node, d1, d2 = _columns(batch, "node", "d1", "d2")
            out = [(i, shingle_set(words, k).tobytes()) for i, words, a, b in zip(node, word_hashes(batch.column(1)), d1, d2, strict=True) if len(words) and sequence_digest(words) == (a, b)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["node", "grams"])

    return run


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """Every row's ``(id, th, d1, d2, n, sig)``, the digests' ``(d1, d2, id, node)`` with their smallest ids, links ``(a, b)`` between nodes that suffice for the components, and the nodes' ``(id, comp)``."""
    spark = docs.sparkSession
    parts = common.shuffle_partitions(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    hashed = source.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    both = common.stage(hashed.mapInArrow(common.tidy(_digest_scan(k)), "id long, th long, d1 long, d2 long, n int, sig binary, chunk int, counts binary"), "ngram-rows")
    rows = both.where("n is not null").select("id", "th", "d1", "d2", "n", "sig")
    sketch = both.where("chunk is not null").select("chunk", "counts").repartition(min(CHUNKS, parts), "chunk").mapInArrow(common.tidy(_add_sketches), "chunk int, levels binary").collect()  # 2**20 bytes
    size = (1 << SKETCH_BITS) // CHUNKS
    levels = bytearray(1 << SKETCH_BITS)
    for r in sketch:
        levels[r["chunk"] * size : (r["chunk"] + 1) * size] = r["levels"]
    shared = spark.sparkContext.broadcast(bytes(levels))
    reps = common.stage(rows.where("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("id")).withColumn("node", F.monotonically_increasing_id()), "ngram-reps")

    row = "token long, pos int, n int, d1 long, d2 long, part int"
    prefixes = source.where("id is not null").select("text").mapInArrow(common.tidy(_prefix_scan(k, num, den, shared, RUN)), row)
    runs = prefixes.repartition(parts, "token", "part").sortWithinPartitions("token", "part", "d1", "d2").mapInArrow(common.tidy(_shared_only), row)
    runs = common.stage(runs, "ngram-shared")
    named = common.stage(runs.join(reps.drop("id"), ["d1", "d2"]).drop("d1", "d2"), "ngram-named")
    common.unstage(runs)
    shared_by = named.groupBy("node").agg(F.count(F.lit(1)).alias("shared"))
    central = named.join(shared_by, "node")
    central = central.repartition(parts, "token", "part").sortWithinPartitions("token", "part", F.desc("shared"), "node").select("token", "part", "pos", "n", "node")
    placed = common.stage(central.mapInArrow(common.tidy(_number_runs), NUMBERED), "ngram-runs")
    common.unstage(named)
    numbered, run_parts = _run_on(placed)
    longest = numbered.agg(F.max("place")).first()[0]
    nodes = reps.select("node", "id", "d1", "d2")

    links, comps, low, high = None, None, 0, FIRST_PIVOTS
    while longest is not None and low < longest:
        now = numbered.join(comps.withColumnRenamed("id", "node"), "node", "left").withColumn("comp", F.coalesce("comp", "node")) if comps is not None else numbered.withColumn("comp", F.col("node"))
        if low:
            open_runs = now.groupBy("token").agg(F.max("place").alias("last"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where((F.col("last") > low) & (F.col("lo") < F.col("hi"))).select("token")
            # by part, so that a frequent shingle is met in the tasks that it is dealt over
            open_parts = open_runs.join(run_parts.select("token", "part"), "token", "left").withColumn("part", F.coalesce("part", F.lit(0)))
            # a run that lies in one component, or whose rows were all pivots, stays so: later rounds read the others alone
            now = common.stage(now.join(open_parts, ["token", "part"], "left_semi"), "ngram-open")
            common.unstage(placed)
            placed, numbered = now, now.drop("comp")
            longest = now.agg(F.max("place")).first()[0]
            if longest is None:
                break
        now = now.select("token", "part", "place", "n", "pos", "node", "comp")
        pivots = now.where((F.col("part") > 0) & (F.col("place") >= low) & (F.col("place") < high))
        # the pivots of a dealt run go to the parts behind them
        sent = pivots.join(run_parts.select("token", F.col("part").alias("to")), "token").where("to > part").withColumn("part", F.col("to")).select(now.columns)
        pairs = now.union(sent).repartition(parts, "token", "part").sortWithinPartitions("token", "part", "place").mapInArrow(common.tidy(_emit_pairs(low, high, num, den)), "p long, x long")
        pairs = common.stage(pairs.distinct(), "ngram-pairs")
        ends = pairs.select(F.col("p").alias("node")).union(pairs.select(F.col("x").alias("node"))).distinct().join(nodes, "node")
        signed = rows.join(ends, ["id", "d1", "d2"]).dropDuplicates(["node"]).select("node", "n", "sig")
        signed = common.stage(signed, "ngram-signatures")
        both_ends = pairs.join(signed.toDF("p", "np", "sp"), "p").join(signed.toDF("x", "nx", "sx"), "x")
        near = common.stage(both_ends.mapInArrow(common.tidy(_near_signatures(num, den)), "p long, x long, nx long"), "ngram-near")
        common.unstage(pairs)
        common.unstage(signed)
        pairs = near
        per_pivot = pairs.groupBy("p").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("nx") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        needed = pairs.select(F.col("p").alias("node")).union(pairs.select(F.col("x").alias("node"))).distinct().join(nodes, "node")
        needed = common.stage(needed, "ngram-needed")
        if n_needed := needed.count():
            right = needed.withColumnRenamed("id", "held_by")
            right = F.broadcast(right) if n_needed <= BROADCAST_IDS else right
            sets = source.join(right, source["id"] == right["held_by"]).select("node", "text", "d1", "d2").mapInArrow(common.tidy(_set_scan(k)), "node long, grams binary")
            sets = common.stage(sets, "ngram-sets")
            blocks = pairs.join(per_pivot.select("p", "blocks"), "p").select("p", "x", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int").alias("block"))
            members = blocks.join(sets.withColumnRenamed("node", "x"), "x").select("p", "block", "x", "grams")
            heads = per_pivot.select("p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(sets.withColumnRenamed("node", "p"), "p").select("p", "block", F.lit(None).cast("long").alias("x"), "grams")
            found = heads.union(members).repartition(parts, "p", "block").sortWithinPartitions("p", "block", F.col("x").asc_nulls_first()).mapInArrow(common.tidy(_search(num, den)), "a long, b long")
            found = common.stage(found, "ngram-links")
            common.unstage(sets)
            if found.head(1):
                links = found if links is None else links.union(found)
                comps = common.components(links)
        common.unstage(pairs)
        common.unstage(needed)
        low, high = high, min(high * GROWTH, high + MOST_PIVOTS)
    common.unstage(placed)
    common.unstage(run_parts)
    return rows, reps, links, comps


def _with_components(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """``id, th, n, component_id`` for every row; ``th`` is a hash of the text."""
    rows, reps, links, comps = similar_links(docs, id_col, text_col, k, num, den)
    classes = reps.select("d1", "d2", F.col("id").alias("node"))
    if comps is not None:
        linked = reps.join(comps.withColumnRenamed("id", "node"), "node")
        least = linked.groupBy("comp").agg(F.min("id").alias("least"))
        named = comps.join(least, "comp").select(F.col("id").alias("node"), "least")
        classes = reps.join(named, "node", "left").select("d1", "d2", F.coalesce("least", "id").alias("node"))
    linked = rows.where("d1 is not null and id is not null").join(classes, ["d1", "d2"]).select("id", "th", "n", F.col("node").alias("component_id"))
    return linked.union(rows.where("d1 is null or id is null").select("id", "th", "n", F.col("id").alias("component_id")))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``(id, n_shingles long, component_id)`` for every row."""
    out = _with_components(docs, id_col, text_col, k, num, den)
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The row of each component whose id is the smallest; all columns stay.

    Rows of the empty set or of a null id are all kept: they resemble nothing.  Of rows that repeat
    both id and text one stays; the rows are only met for that where some id repeats.
    """
    comp = common.stage(_with_components(docs, id_col, text_col, k, num, den), "ngram-components")
    names = {c.lower() for c in docs.columns}
    key, text_key = next(f"row_id{i}" for i in range(len(names) + 1) if f"row_id{i}" not in names), next(f"row_text{i}" for i in range(len(names) + 1) if f"row_text{i}" not in names)
    rows = docs.withColumns({key: F.col(id_col).cast("long"), text_key: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    loser = comp.where("component_id < id").select(F.col("id").alias(key), F.col("th").alias(text_key)).distinct()
    kept = rows.join(loser, [key, text_key], "left_anti")
    if comp.where("n > 0 and id is not null").groupBy("id").count().where("count > 1").head(1):
        again = comp.where("n > 0 and id is not null").groupBy("id", "th").count().where("count > 1").select(F.col("id").alias(key), F.col("th").alias(text_key))
        kept = kept.join(again, [key, text_key], "left_anti").unionByName(kept.join(again, [key, text_key], "left_semi").dropDuplicates([key, text_key]))
    return kept.select(docs.columns)


def components_sql(k: int, num: int, den: int, table: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    """The same as DuckDB SQL over all pairs of unlike sets that share a shingle, for unlike ids; small tables only."""
    return f"""WITH RECURSIVE w AS (SELECT {id_col} AS id, list_filter(string_split_regex(translate(coalesce({text_col}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM {table}),
s AS (SELECT id, CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(words) < {k} THEN [array_to_string(words, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(words) - {k - 2}), lambda i: array_to_string(words[i:i + {k - 1}], ' ')))) END AS grams FROM w),
c AS (SELECT min(id) AS node, grams FROM s WHERE len(grams) > 0 AND id IS NOT NULL GROUP BY grams),
g AS (SELECT node, len(grams) AS n, unnest(grams) AS gram FROM c),
p AS (SELECT a.node AS a, b.node AS b FROM g a JOIN g b ON a.gram = b.gram AND a.node < b.node GROUP BY a.node, b.node, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT node AS id, node AS met FROM c UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.met),
m AS (SELECT id, min(met) AS comp FROM r GROUP BY id)
SELECT s.id AS {id_col}, CAST(len(s.grams) AS BIGINT) AS n_shingles, coalesce(m.comp, s.id) AS component_id FROM s LEFT JOIN c ON c.grams = s.grams AND s.id IS NOT NULL LEFT JOIN m ON m.id = c.node"""
