"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has one or more 64-bit lanes; a lane's bit is the majority of that bit over the
XXH64 of all word shingles, repeats included. A lane's bits get vectors of r + 1 bits, each
vector about as often as any other; a table's mask keeps the bits whose vector has an odd product with the table's own
vector. Any r differing bits leave some table's mask untouched by all of them, so every pair
within radius r of a lane meets in a table of it: none is missed.

Equal fingerprints are one node from the start. Nodes move as packed arrays, dealt by the
hash of their masked bits. In a bucket, all links are found by comparing to every member only
those members that are not yet in the bucket's largest component, and a spanning forest of
at most (members - 1) links leaves it. Large buckets are parted by a second set of masks,
which keeps the guarantee.

Defined results: a null or empty text has fingerprint zero and is linked like any other;
repeated rows share a component; a component's id is its least doc_id (null only if all are).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, dropped, held, pick, reducers, salted_join, stored, text_slices, trim, utf8
from .components import components

SEED = 42
#: Buckets above this size are parted by further masks before they are searched.
LARGE = 4096
#: About so many nodes stand in one packed array of a table.
PACKED = 200_000
#: Members of several buckets that are compared as one group.
TOGETHER = 8192
#: Parts of tables for each reducer, so that each gets about as many.
EACH = 4
#: distinct() links sets of shingles from this Jaccard similarity on.
LEAST_ALIKE = 0.8
#: Its prints have so many words of 64 bits; each lane draws 64 of their bits and masks the first COVERED of them.
WORDS, LANES, COVERED = 16, 72, 36
#: Alike sets differ in at most so many bits of a lane that they meet in (6 on average), and of all of the print (155; 208 are 4.6 deviations off).
FAR, LIMIT = 12, 208
#: The lanes of the first pass; the others are searched for links between the components that it gives.
FIRST = 24


def masks(radius: int, seed: int = 1, width: int = 64) -> np.ndarray:
    """The covering masks of the low `width` bits: 2 ** (radius + 1) - 1 of them."""
    top = 1 << (radius + 1)
    rng = np.random.default_rng(seed * 1000 + radius)
    deck = np.concatenate([rng.permutation(np.arange(1, top)) for _ in range(-(-width // (top - 1)))])[:width]
    odd = np.bitwise_count(np.arange(1, top)[:, None] & deck[None, :]) & 1
    return (odd.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def shingle_hashes(text: bytes, words_each: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased text; none if it has no words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - words_each + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    shingles = [joined[a:b] for a, b in zip(starts, ends[-n:].tolist())]
    return np.fromiter(map(functools.partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64, n)


def lane_hashes(hashes: np.ndarray, lane: int) -> np.ndarray:
    """The hashes of a lane: as they are for the first, mixed anew for each other."""
    if lane == 0:
        return hashes
    z = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majorities(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text, with `sizes` hashes one after another, the bits that more than half of its hashes have."""
    out = np.zeros(len(sizes), np.uint64)
    if not len(flat):
        return out
    # sums of at most 255 hashes fit into the bytes of a word, eight bits of each hash at a time
    pieces = -(-sizes // 255)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    first = np.cumsum(pieces) - pieces
    at = (np.cumsum(sizes) - sizes)[owner] + 255 * (np.arange(len(owner)) - first[owner])
    full = np.flatnonzero(sizes)
    for j in range(8):
        low = (flat >> np.uint64(j)) & np.uint64(0x0101010101010101)
        counts = np.add.reduceat(low, at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts = np.add.reduceat(counts, first[full], axis=0)
        for k in range(8):
            out[full] |= (2 * counts[:, k] > sizes[full]).astype(np.uint64) << np.uint64(8 * k + j)
    return out


def fingerprints(docs: DataFrame, words_each: int = 4, lanes: int = 1) -> DataFrame:
    """(doc_id, print): the lanes of each text as big-endian bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()
        for b in text_slices(batches, most=1 << 20):
            trim()
            each = [shingle_hashes(t, words_each) for t in utf8(b.column(1))]
            flat, sizes = np.concatenate(each), np.array([len(h) for h in each], dtype=np.int64)
            bits = np.stack([majorities(lane_hashes(flat, k), sizes) for k in range(lanes)], axis=1)
            raw = bits.astype(">u8").tobytes()
            yield batch(schema, b.column(0), [raw[i : i + 8 * lanes] for i in range(0, len(raw), 8 * lanes)])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, print binary")


def spanning_links(bits: np.ndarray, limit: int, radius: int, depth: int = 0, whole: np.ndarray | None = None, most: int = 0) -> list[tuple[int, int]]:
    """Links (by index) that join the members of a bucket as all links within `limit` bits, and within `most` of whole prints if given, would.

    Of any link between two components, one end lies outside the largest component; so it is
    enough to compare the members outside it with all members, until each has been compared.
    """
    m = len(bits)
    if m > LARGE and depth < 2:
        links = []
        for mask in masks(radius, seed=depth + 2):
            for run in runs(bits & mask):
                links += [(run[a], run[b]) for a, b in spanning_links(bits[run], limit, radius, depth + 1, None if whole is None else whole[run], most)]
        return links
    label, size = np.arange(m), np.ones(m, np.int64)
    done, links = np.zeros(m, bool), []
    while True:
        largest = int(np.argmax(size))
        todo = np.flatnonzero(~done & (label != largest)) if size[largest] > 1 else np.flatnonzero(~done)
        if not len(todo):
            return links
        p = int(todo[0])
        done[p] = True
        near = np.flatnonzero(np.bitwise_count(bits ^ bits[p]) <= limit)
        if whole is not None:
            near = near[np.bitwise_count(whole[near] ^ whole[p]).sum(axis=1) <= most]
        others, first = np.unique(label[near], return_index=True)
        for x, i in zip(others.tolist(), near[first].tolist()):
            if x != label[p]:
                links.append((p, i))
                mine = int(label[p])
                keep, gone = (mine, x) if size[mine] >= size[x] else (x, mine)
                label[label == gone] = keep
                size[keep] += size[gone]
                size[gone] = 0


def runs(keys: np.ndarray) -> list[np.ndarray]:
    """Indices of each set of two or more equal keys."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    cuts = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
    long = np.flatnonzero(ends - starts > 1)
    return [order[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist())]


def dealt_to(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """The parts that the keys' hashes name, each with the indices dealt to it."""
    to = (((keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)
    order = np.argsort(to, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
        yield int(to[some[0]]), some


_ENTRY = np.dtype([("bits", "<u8"), ("key", "V8")])


def near_links(nodes: DataFrame, lanes: int, radius: int, limit: int | None = None) -> DataFrame:
    """Links (u, v) between the keys of distinct (key, print) nodes: a spanning forest for each bucket of each table.

    With a limit, nodes move with their whole prints: a forest of links within the radius alone
    could not be thinned out later without losing others that it stands for.
    """
    n = nodes.count()
    table_masks = masks(radius)
    tables = lanes * len(table_masks)
    parts = max(1, -(-4 * reducers(nodes.sparkSession) // tables), n // PACKED)
    entry = _ENTRY if limit is None else np.dtype([*_ENTRY.descr, ("whole", "<u8", (lanes,))])
    packed_schema = pa.schema([("part", pa.int32()), ("tab", pa.int32()), ("nodes", pa.binary())])
    link_schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.frombuffer(b"".join(b.column(0).to_pylist()), "V8")
            bits = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u8").reshape(-1, lanes).astype(np.uint64)
            for lane in range(lanes):
                entries = np.empty(len(keys), entry)
                entries["bits"], entries["key"] = bits[:, lane], keys
                if limit is not None:
                    entries["whole"] = bits
                rows = ([], [], [])
                for t, mask in enumerate(table_masks.tolist(), lane * len(table_masks)):
                    for to, some in dealt_to(bits[:, lane] & np.uint64(mask), parts):
                        rows[0].append(to)
                        rows[1].append(t)
                        rows[2].append(entries[some].tobytes())
                yield batch(packed_schema, *rows)

    def link(key: tuple, table: pa.Table) -> pa.Table:
        held()
        entries = np.frombuffer(b"".join(table.column("nodes").to_pylist()), entry)
        bits = entries["bits"].copy()
        whole = None if limit is None else entries["whole"]
        u, v = [], []
        pairs = []
        for r in runs(bits & table_masks[key[1].as_py() % len(table_masks)]):
            if len(r) == 2:
                pairs.append(r)
            elif links := spanning_links(bits[r], radius, radius, 0, None if whole is None else whole[r], limit or 0):
                a, b = np.array(links).T
                u.append(r[a])
                v.append(r[b])
        if pairs:
            a, b = np.array(pairs).T
            near = np.bitwise_count(bits[a] ^ bits[b]) <= radius
            if whole is not None:
                near &= np.bitwise_count(whole[a] ^ whole[b]).sum(axis=1) <= limit
            u.append(a[near])
            v.append(b[near])
        out = [[x.tobytes() for x in entries["key"][np.concatenate(w)]] if w else [] for w in (u, v)]
        return pa.Table.from_batches([batch(link_schema, *out)])

    dealt = nodes.select("key", "print").mapInArrow(deal, "part int, tab int, nodes binary")
    return dealt.groupBy("part", "tab").applyInArrow(link, "u binary, v binary").distinct()


def close_links(links: DataFrame, nodes: DataFrame, limit: int, lanes: int) -> DataFrame:
    """The links whose prints differ in at most `limit` bits of all lanes."""
    lane = lambda c, k: F.conv(F.hex(F.substring(c, 8 * k + 1, 8)), 16, -10).cast("long")
    apart = sum((F.bit_count(lane(F.col("p"), k).bitwiseXOR(lane(F.col("q"), k))) for k in range(lanes)), F.lit(0))
    one, two = (nodes.select(F.col("key").alias(k), F.col("print").alias(p)) for k, p in (("u", "p"), ("v", "q")))
    return links.join(one, "u").join(two, "v").where(apart <= limit).select("u", "v")


def linked(known: DataFrame, lanes: int = 1, radius: int = 4, limit: int | None = None) -> DataFrame:
    """(doc_id, print, component_id) for (doc_id, print) rows, a stored table.

    Fingerprints are linked if they differ in at most radius bits of a lane and, with a limit,
    in at most limit bits of all lanes.
    """
    key = F.col("print") if lanes == 1 else F.unhex(F.lpad(F.hex(F.xxhash64("print")), 16, "0"))
    least = stored(known.groupBy("print").agg(F.min("doc_id").alias("least")).select(key.alias("key"), "print", "least"), "nodes")
    roots = components(near_links(least, lanes, radius, limit))
    members = roots.union(roots.select("root", "root").distinct()).toDF("key", "root")
    ids = members.join(least, "key").groupBy("root").agg(F.min("least").alias("component_id"))
    joined = salted_join(members, ids, ["root"], "key").select("key", "component_id")
    labels = stored(least.join(joined, "key", "left").select("print", F.coalesce("component_id", "least").alias("component_id")), "labels")
    return salted_join(known, labels, ["print"], "doc_id").select("doc_id", "print", "component_id")


def near_duplicates(docs: DataFrame, words_each: int = 4, lanes: int = 1, radius: int = 4, limit: int | None = None) -> DataFrame:
    """(doc_id, print, component_id) of every document."""
    return linked(stored(fingerprints(docs, words_each, lanes), "fingerprints"), lanes, radius, limit)


def sketches(docs: DataFrame, words_each: int) -> DataFrame:
    """(doc_id, copy, key, print, shingles) of each text: a hash of its bytes and one of its set of shingles, WORDS lanes over that set, and the set in 32 bits each."""
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("key", pa.binary()), ("print", pa.binary()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held()
        for b in text_slices(batches, most=1 << 20):
            trim()
            each = [np.unique(shingle_hashes(t, words_each)) for t in utf8(b.column(1))]
            flat, sizes = np.concatenate(each), np.array([len(h) for h in each], dtype=np.int64)
            raw = np.stack([majorities(lane_hashes(flat, k), sizes) for k in range(WORDS)], axis=1).astype(">u8").tobytes()
            keys = [xxhash.xxh64_digest(h.tobytes(), seed=SEED) for h in each]
            sets = [np.unique((h >> np.uint64(32)).astype("<u4")).tobytes() for h in each]
            yield batch(schema, b.column(0), b.column(2), keys, [raw[i : i + 8 * WORDS] for i in range(0, len(raw), 8 * WORDS)], sets)

    rows = docs.select(docs["doc_id"], docs["text"], F.xxhash64(docs["text"]).alias("copy"))
    return rows.mapInArrow(run, "doc_id long, copy long, key binary, print binary, shingles binary")


def lane_bits(prints: list[bytes], lanes: range = range(LANES)) -> Iterator[np.ndarray]:
    """For each of the lanes, 64 bits drawn from each print's bits."""
    bits = np.unpackbits(np.frombuffer(b"".join(prints), np.uint8).reshape(-1, 8 * WORDS), axis=1).T.copy()
    for lane in lanes:
        drawn = np.random.default_rng([SEED, lane]).choice(64 * WORDS, 64, replace=False)
        yield np.packbits(bits[drawn], axis=0, bitorder="little").T.copy().view("<u8").ravel()


def near_others(bits: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which members of a bucket are within FAR bits of one with another label.

    It is enough to compare the members outside the most frequent label with all; or, where these
    are many, each member that none of those before has found.
    """
    which, counts = np.unique(label, return_inverse=True, return_counts=True)[1:]
    outside = np.flatnonzero(which != np.argmax(counts))
    each = 2 * len(outside) > len(bits)
    found = np.zeros(len(bits), bool)
    for p in range(len(bits)) if each else outside.tolist():
        if not (each and found[p]):
            near = (np.bitwise_count(bits ^ bits[p]) <= FAR) & (which != which[p])
            found |= near
            found[p] |= near.any()
    return found


_LABELLED = np.dtype([*_ENTRY.descr, ("label", "<u4")])
_FOUND = pa.schema([("u", pa.binary()), ("v", pa.binary()), ("g", pa.int64()), ("h", pa.binary()), ("c", pa.int64())])


def candidates(nodes: DataFrame, n: int, lanes: range, other: str) -> DataFrame:
    """What may be alike of n distinct (key, print, label) nodes, but for nodes of one label: rows (u, other, g, h, c).

    A bucket of two gives a pair of u and the other one. A larger one is named by g, and by its least member h, and gives its members with their labels c, but
    those far from all of other labels; for `other` "hub" each with the member that is nearest to
    the majority of their bits (a text that many are copies of, if it is there), else alone. So a
    bucket gives rows in proportion to its members.
    """
    table_masks = masks(1, width=COVERED)
    tables = len(lanes) * len(table_masks)
    parts = max(1, -(-EACH * reducers(nodes.sparkSession) // tables), n // PACKED)
    packed_schema = pa.schema([("part", pa.int32()), ("tab", pa.int32()), ("nodes", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()
        for b in batches:
            if not b.num_rows:
                continue
            entries = np.empty(b.num_rows, _LABELLED)
            entries["key"] = np.frombuffer(b"".join(b.column(0).to_pylist()), "V8")
            entries["label"] = b.column(2).to_numpy().astype(np.uint32)
            for lane, bits in zip(lanes, lane_bits(b.column(1).to_pylist(), lanes)):
                entries["bits"] = bits
                rows = ([], [], [])
                for t, mask in enumerate(table_masks, lane * len(table_masks)):
                    for to, some in dealt_to(bits & mask, parts):
                        rows[0].append(to)
                        rows[1].append(t)
                        rows[2].append(entries[some].tobytes())
                yield batch(packed_schema, *rows)

    def find(key: tuple, table: pa.Table) -> pa.Table:
        import xxhash

        held()
        t = key[1].as_py()
        entries = np.frombuffer(b"".join(table.column("nodes").to_pylist()), _LABELLED)
        bits, keys, label = entries["bits"].copy(), entries["key"].copy(), entries["label"].copy()
        name = lambda i: keys[i].tobytes()
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        for r in runs(bits & table_masks[t % len(table_masks)]):
            if (label[r] == label[r[0]]).all():
                continue
            if len(r) == 2:
                if np.bitwise_count(bits[r[0]] ^ bits[r[1]]) <= FAR:
                    for x, y in zip(out, (*sorted(map(name, r)), None, None, None)):
                        x.append(y)
                continue
            g = r[near_others(bits[r], label[r])]
            if len(g):
                g = g[np.argsort(keys[g].view(">u8"))]
                hub = g[middle(bits[g])]
                near = np.bitwise_count(bits[g] ^ bits[hub]) <= FAR
                out[0].extend(map(name, g))
                out[1].extend(name(hub) if other == "hub" and k and i != hub else None for i, k in zip(g, near))
                out[2].extend([xxhash.xxh64_intdigest(keys[g].tobytes()) - (1 << 63)] * len(g))
                out[3].extend([name(g[0])] * len(g))
                out[4].extend(label[g].tolist())
        return pa.Table.from_batches([batch(_FOUND, *out)]).rename_columns(["u", other, "g", "h", "c"])

    dealt = nodes.select("key", "print", "label").mapInArrow(deal, "part int, tab int, nodes binary")
    return dealt.groupBy("part", "tab").applyInArrow(find, f"u binary, {other} binary, g long, h binary, c long")


def middle(bits: np.ndarray) -> int:
    """The index of the member that is nearest to the majority of the members' bits."""
    ones = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
    majority = np.packbits(2 * ones > len(bits)).view("<u8")[0]
    return int(np.argmin(np.bitwise_count(bits ^ majority)))


def alike(common, size, other):
    """Whether sets of these sizes with so many common members have a Jaccard similarity of LEAST_ALIKE."""
    return common >= LEAST_ALIKE * (size + other - common) - 1e-9


def alike_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets of shingles are alike."""
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()
        for b in batches:
            keep = []
            for p, q in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(w.as_buffer(), "<u4") for w in (p, q))
                keep.append(bool(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield pa.RecordBatch.from_arrays(b.columns[:2], schema=schema).filter(pa.array(keep, pa.bool_()))

    one, two = (sets.select(F.col("key").alias(k), F.col("shingles").alias(s)) for k, s in (("u", "p"), ("v", "q")))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "p", "q").mapInArrow(run, "u binary, v binary")


def alike_links(sets: list[np.ndarray], label: np.ndarray) -> list[tuple[int, int]]:
    """Links (by index) that join the sets of a bucket, which have these labels already, as all links between alike sets would."""
    sizes = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(sizes)
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    label, size = label.copy(), np.bincount(label, minlength=len(sets))
    done, links = np.zeros(len(sets), bool), []
    while len(todo := np.flatnonzero(~done & (label != np.argmax(size)))) or (size.max() == 1 and not done.all()):
        p = int(todo[0]) if len(todo) else int(np.flatnonzero(~done)[0])
        done[p] = True
        has = np.zeros(len(values), bool)
        has[ids[ends[p] - sizes[p] : ends[p]]] = True
        sums = np.append(0, np.cumsum(has[ids]))
        near = np.flatnonzero(alike(sums[ends] - sums[ends - sizes], sizes, sizes[p]))
        others, first = np.unique(label[near], return_index=True)
        for x, i in zip(others.tolist(), near[first].tolist()):
            if x != label[p]:
                links.append((p, i))
                mine = int(label[p])
                size[mine] += size[x]
                size[x] = 0
                label[label == x] = mine
    return links


def gathered(members: DataFrame) -> DataFrame:
    """The members (g, h, u, c) of buckets as rows (g, u, c) of groups in which all meet that meet in a bucket.

    Buckets that share members are one group, so that a member comes once and not for each of its
    buckets. Where that makes more than TOGETHER members, the buckets stay apart; and members of a
    bucket of more than that are dealt to blocks, of which any two meet in a group.
    """
    # a member's buckets, 216 at most, are linked through the least of their h, so that few links are left
    named = members.select("u", "h").distinct().withColumn("v", F.min("h").over(Window.partitionBy("u")))
    merged = components(named.select("u", "v").union(named.select("h", "v")))
    each = members.select("u", "c").distinct().join(merged, F.col("u") == F.col("node"), "left")
    each = stored(each.select(F.xxhash64(F.coalesce("root", "u")).alias("g"), "u", "c"), "members")
    large = each.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > TOGETHER).select("g")
    apart = members.select("g", "u", "c").join(each.join(large, "g", "left_semi").select("u"), "u", "left_semi")
    groups = each.join(large, "g", "left_anti").select("g", "u", "c").union(apart.select("g", "u", "c").distinct())
    sizes = groups.groupBy("g").agg(F.count("*").alias("n"))
    blocks = F.when(F.col("n") > TOGETHER, F.ceil(2 * F.col("n") / TOGETHER)).otherwise(1)
    dealt = groups.join(sizes, "g").withColumn("k", blocks).withColumn("a", F.pmod(F.xxhash64("u"), F.col("k")))
    dealt = dealt.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    # of one block alone there is no group, unless there is no other block
    dealt = dealt.where("k = 1 or a <> b")
    return dealt.select(F.when(F.col("k") == 1, F.col("g")).otherwise(F.xxhash64("g", F.least("a", "b"), F.greatest("a", "b"))).alias("g"), "u", "c")


def close_members(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """The members (g, u, c) of buckets whose prints are within LIMIT bits of some member's of another component."""
    schema = pa.schema([("g", pa.int64()), ("u", pa.binary()), ("c", pa.int64())])

    def close(table: pa.Table) -> pa.Table:
        held()
        whole = np.frombuffer(b"".join(table.column("print").to_pylist()), "<u8").reshape(-1, WORDS)
        label = table.column("c").to_numpy()
        stays = [bool((np.bitwise_count(whole[label != c] ^ p).sum(axis=1, dtype=np.int64) <= LIMIT).any()) for p, c in zip(whole, label)]
        return table.select(["g", "u", "c"]).cast(schema).filter(pa.array(stays, pa.bool_()))

    joined = members.join(nodes.select(F.col("key").alias("u"), "print"), "u").select("g", "u", "c", "print")
    return joined.groupBy("g").applyInArrow(close, "g long, u binary, c long")


def bucket_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between alike sets of each bucket, for members (g, u, c) of component c so far."""
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def link(table: pa.Table) -> pa.Table:
        held()
        keys = table.column("u").to_pylist()
        _, label = np.unique(table.column("c").to_numpy(), return_inverse=True)
        links = alike_links([np.frombuffer(x, "<u4") for x in table.column("shingles").to_pylist()], label)
        return pa.Table.from_batches([batch(schema, [keys[a] for a, _ in links], [keys[b] for _, b in links])])

    joined = members.join(sets.select(F.col("key").alias("u"), "shingles"), "u").select("g", "u", "c", "shingles")
    return joined.groupBy("g").applyInArrow(link, "u binary, v binary")


def alike_components(known: DataFrame) -> DataFrame:
    """(node, root) as components() gives it, for all links between alike sets that meet in a bucket.

    The first lanes' stars join most of what is alike; the other lanes look only for links between
    the components that these give; what is left are buckets with members of several components, and
    there all links between components are found from the sets themselves.
    """
    nodes = stored(known.groupBy("key").agg(F.first("print").alias("print")), "nodes")
    n = nodes.count()
    sets = known.select("key", "shingles")
    label = lambda node: F.xxhash64(node).bitwiseAND(0xFFFFFFFF)

    def searched(named: DataFrame, lanes: range, v: str) -> tuple[DataFrame, DataFrame]:
        found = stored(candidates(named, n, lanes, v).distinct(), "candidates")
        both = found.where(F.col(v).isNotNull()).select(F.least("u", v).alias("u"), F.greatest("u", v).alias("v")).distinct()
        pairs = stored(close_links(both, nodes, LIMIT, WORDS), "pairs")
        return found.where("g is not null"), stored(alike_pairs(pairs, used_sets(sets, pairs)), "links")

    first, links = searched(nodes.select("key", "print", label(F.col("key")).alias("label")), range(FIRST), "hub")
    roots = components(links)
    named = nodes.join(roots, nodes["key"] == roots["node"], "left").select("key", "print", label(F.coalesce("root", "key")).alias("label"))
    second, more = searched(named, range(FIRST, LANES), "v")
    # buckets of the second pass have members of several components, of the first one some
    first = stored(first.join(roots, first["u"] == roots["node"], "left").select("g", "h", "u", label(F.coalesce("root", "u")).alias("c")), "buckets")
    mixed = first.groupBy("g").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("g")
    members = first.join(mixed, "g", "left_semi").select("g", "h", "u", "c").union(second.select("g", "h", "u", "c"))
    mixed = stored(close_members(gathered(members), nodes), "mixed")
    last = stored(bucket_links(mixed, used_sets(sets, mixed.select("u", F.lit(None).cast("binary").alias("v")))), "links")
    return components(roots.toDF("u", "v").union(more).union(last))


def used_sets(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (key, shingles) that pairs (u, v) name, a stored table with each key once."""
    used = pairs.select("u").union(pairs.select("v")).where("u is not null").distinct().toDF("key")
    found = sets.join(used.hint("merge"), "key", "left_semi").groupBy("key").agg(F.first("shingles").alias("shingles"))
    return stored(found, "sets")


def distinct(docs: DataFrame, words_each: int = 5) -> DataFrame:
    """docs with one document of each near-duplicate group: that with the least doc_id, one without an id only if all are.

    Rows of a null or repeated doc_id go or stay each by its own text; of rows with the same id and
    the same text one stays, if any.

    Documents are linked if their sets of five-word shingles have a Jaccard similarity of at
    least 0.8. Sets of a similarity s differ in about acos(2 s / (1 + s)) / pi of their prints'
    bits, 15 % at 0.8; pairs are compared if they meet in some bucket of 72 lanes, which about
    98.5 % do at 0.8 and more above; the README has measured shares.
    """
    known = stored(sketches(docs, words_each), "sketches")
    roots = alike_components(known)
    members = roots.union(roots.select("root", "root").distinct()).toDF("key", "root")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")
    known = known.select("doc_id", "copy", "key")
    least = known.groupBy("key").agg(F.min(row).alias("least"))
    firsts = members.join(least, "key").groupBy("root").agg(F.min("least").alias("first"))
    joined = salted_join(members, firsts, ["root"], "key").select("key", "first")
    labels = stored(least.join(joined, "key", "left").select("key", F.coalesce("first", "least").alias("first")), "labels")
    judged = salted_join(known, labels, ["key"], "copy").select("doc_id", "copy", row.eqNullSafe(F.col("first")).alias("stays"))
    # rows that can't be told apart by id and text: none stays (0), or more than one would (2); a row that isn't here stays
    fates = judged.groupBy("doc_id", "copy").agg(F.sum(F.col("stays").cast("int")).alias("n")).where("n <> 1")
    fates = stored(fates.select(F.col("doc_id").alias("_fate_id"), F.col("copy").alias("_fate_copy"), F.least("n", F.lit(2)).alias("_fate_n")), "fates")
    found = docs.join(fates, docs["doc_id"].eqNullSafe(fates["_fate_id"]) & F.xxhash64(docs["text"]).eqNullSafe(fates["_fate_copy"]), "left")
    once = found.where("_fate_n = 2").dropDuplicates(["_fate_id", "_fate_copy"])
    return found.where("_fate_n is null").unionByName(once).select(*[docs[c] for c in docs.columns])
