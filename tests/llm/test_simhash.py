import itertools
import random
import re

import numpy as np
import xxhash

from millrace.llm import simhash


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, limit):
    """prints: {doc_id: int} -> {doc_id: least reachable}"""
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= limit:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: find(i) for i in prints}


def check(rows, got):
    prints = {i: brute_print(t) for i, t in rows}
    want = brute_components(prints, 4)
    got = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for i in prints:
        assert got[i].print.hex() == f"{prints[i]:016x}", i
        assert got[i].component_id == want[i], i


def test_masks_cover():
    rng = random.Random(1)
    for radius in (1, 4, 6):
        ms = [int(m) for m in simhash.masks(radius)]
        assert len(ms) == 2 ** (radius + 1) - 1
        for _ in range(3000):
            diff = sum(1 << b for b in rng.sample(range(64), rng.randint(1, radius)))
            assert any(not diff & m for m in ms)


def test_spanning_links_join_as_all_links_would(monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 60)
    rng = random.Random(2)
    for _ in range(12):
        centres = [rng.getrandbits(64) for _ in range(4)]
        nodes = list({rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(150)})
        links = simhash.spanning_links(np.array(nodes, np.uint64), 4, 4)
        want = brute_components(dict(enumerate(nodes)), 4)
        parent = list(range(len(nodes)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            assert (nodes[a] ^ nodes[b]).bit_count() <= 4
            a, b = sorted((find(a), find(b)))
            parent[b] = a
        assert {i: find(i) for i in want} == want


def test_chains_and_edges(docs_of):
    rng = random.Random(4)
    words = ["w%d" % i for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(60):  # a chain: each text changes one word of the one before
        base = base[:]
        base[rng.randrange(120)] = rng.choice(words)
        rows.append((100 - i, " ".join(base)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "One Two"), (504, "one\ttwo"), (505, "x y z q " * 3000), (506, "É é")]
    check(rows, simhash.near_duplicates(docs_of(rows, extra=("print", "u", "least"))).collect())
    again = simhash.near_duplicates(docs_of([(3, "a b"), (3, "a b"), (2, "a b"), (None, "a b"), (None, "zz")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in again) == [(0, 0), (0, 2), (2, 2), (3, 2), (3, 2)]
    assert simhash.near_duplicates(docs_of([(3, "a b")]).limit(0)).count() == 0


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, simhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect())


def test_lanes_link_similar_texts_only(docs_of):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, groups = [], {}
    for g in range(30):
        base = [word() for _ in range(300)]
        for _ in range(3):
            text = base[:]
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(300)] = word()
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(text)))
    got = simhash.near_duplicates(docs_of(rows), words_each=5, lanes=8, radius=4, limit=85).collect()
    assert all(groups[r.doc_id] == groups[r.component_id] for r in got)
    assert len({r.component_id for r in got}) <= 40


def changed(base, places, tag):
    """base with the words at these places replaced by new ones."""
    out = base[:]
    for i in places:
        out[i] = f"{tag}x{i}"
    return out


def test_distinct_joins_pairs_of_a_similarity_from_0_8(docs_of):
    rows, like, unlike = [], [], []
    for g in range(120):
        base = ["g%dw%d" % (g, i) for i in range(200)]
        # each changed word takes 5 of 196 shingles: a similarity of 0.815, or of 0.742
        n = 4 if g < 90 else 6
        (like if n == 4 else unlike).append(2 * g + 1)
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(changed(base, range(10, 10 + 20 * n, 20), "c")))]
    kept = {r.doc_id for r in simhash.distinct(docs_of(rows)).collect()}
    assert {r[0] for r in rows if r[0] % 2 == 0} <= kept and set(unlike) <= kept
    assert len(kept & set(like)) <= 4


def test_links_within_a_limit_are_all_links(docs_of):
    rng = random.Random(11)
    base = ["w%d" % i for i in range(300)]
    rows = [(i, " ".join(changed(base, rng.sample(range(300), rng.randrange(0, 14)), f"c{i}"))) for i in range(150)]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(rows), words_each=1, lanes=4, radius=4, limit=12).collect()}
    bits = {i: np.frombuffer(r.print, ">u8").astype(np.uint64) for i, r in got.items()}
    parent = {i: i for i in got}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(got), 2):
        apart = np.bitwise_count(bits[a] ^ bits[b])
        if apart.min() <= 4 and apart.sum() <= 12:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert 5 < len({find(i) for i in got}) < 145
    assert {i: r.component_id for i, r in got.items()} == {i: find(i) for i in got}


def test_alike_links_join_as_all_links_would():
    rng = random.Random(12)
    for _ in range(12):
        base = rng.sample(range(10**6), 60)
        sets = [np.unique(np.array(base[: 60 - k] + rng.sample(range(10**6), k), np.uint32)) for k in (rng.randrange(0, 12) for _ in range(80))]
        ties = [(a, b) for a, b in itertools.combinations(range(80), 2) if len(x := set(sets[a]) & set(sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - len(x))]
        label = np.arange(80)
        for a, b in rng.sample(ties, min(10, len(ties))):
            label[label == label[b]] = label[a]

        def joined(pairs):
            to = label.copy()
            for a, b in pairs:
                to[to == to[b]] = to[a]
            return {frozenset(np.flatnonzero(to == x).tolist()) for x in to}

        links = simhash.alike_links(sets, label)
        assert set(map(frozenset, links)) <= set(map(frozenset, ties)) and joined(links) == joined(ties)


def test_distinct_joins_families_through_their_base(docs_of):
    rng = random.Random(13)
    # copies of a similarity of 0.815 to their base, of about 0.66 to each other
    base = ["a%d" % i for i in range(200)]
    rows = [(0, " ".join(base))] + [(i, " ".join(changed(base, range(at := rng.randrange(5, 50), at + 136, 45), f"c{i}"))) for i in range(1, 150)]
    # copies of 0.99, which share large buckets, and a few that only the base is alike enough to
    base = ["b%d" % i for i in range(1000)]
    rows += [(1000, " ".join(base))] + [(1000 + i, " ".join(changed(base, [rng.randrange(8, 990)], f"d{i}"))) for i in range(1, 300)]
    rows += [(1300 + i, " ".join(changed(base, range(10 + i % 5, 10 + i % 5 + 22 * 40, 40), f"e{i}"))) for i in range(12)]
    kept = {r.doc_id for r in simhash.distinct(docs_of(rows)).collect()}
    assert {0, 1000} <= kept
    assert len(kept) <= 6


def test_distinct_drops_rows_and_not_ids(docs_of):
    text = {x: " ".join(f"{x}{i}" for i in range(200)) for x in "abcdefg"}
    near = lambda x: text[x] + " more"
    rows = [(1, text["a"]), (None, near("a")), (None, text["b"]), (None, text["c"]), (None, near("c")), (None, text["c"])]
    rows += [(2, text["d"]), (2, text["e"]), (3, near("d")), (5, text["f"]), (6, near("f")), (6, text["g"]), (6, text["g"]), (7, None), (8, "")]
    got = [(r.doc_id, r.text) for r in simhash.distinct(docs_of(rows, extra=("copy", "key", "stays"))).collect()]
    least_c = [r for r in got if r[0] is None and r[1] in (text["c"], near("c"))]
    assert len(least_c) == 1
    want = [(1, text["a"]), (None, text["b"]), (2, text["d"]), (2, text["e"]), (5, text["f"]), (6, text["g"]), (7, None)]
    assert sorted(map(repr, got)) == sorted(map(repr, want + least_c))


def test_near_others_is_all_pairs():
    rng = random.Random(14)
    for kinds in (1, 2, 5, 300):
        centres = [rng.getrandbits(64) for _ in range(6)]
        bits = [rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 16))) for _ in range(300)]
        label = [rng.randrange(kinds) if kinds < 300 and rng.random() < 0.2 else (0 if kinds < 300 else i) for i in range(300)]
        want = [any(y != x and (a ^ b).bit_count() <= simhash.FAR for b, y in zip(bits, label)) for a, x in zip(bits, label)]
        assert simhash.near_others(np.array(bits, np.uint64), np.array(label, np.uint32)).tolist() == want


def test_members_of_a_very_large_bucket_stay_together(spark):
    rng, n = np.random.default_rng(15), 4500
    drawn = rng.permutation(64 * simhash.WORDS)  # any print, then other bits of lane 0 that no table masks
    bits = np.tile(drawn % 2, (n, 1)).astype(np.uint8)
    free = np.random.default_rng([simhash.SEED, 0]).choice(64 * simhash.WORDS, 64, replace=False)[simhash.COVERED :]
    bits[:, free] = rng.integers(0, 2, (n, len(free)))
    rows = [(i.to_bytes(8, "big"), np.packbits(b).tobytes(), i) for i, b in enumerate(bits)]
    nodes = spark.createDataFrame(rows, "key binary, print binary, label long")
    lane = next(simhash.lane_bits([r[1] for r in rows], range(1)))
    want = {rows[i][0] for i in range(n) if np.count_nonzero(np.bitwise_count(lane ^ lane[i]) <= simhash.FAR) > 1}
    found = simhash.candidates(nodes, n, range(1), "hub").where("g is not null").select("g", "u", "h").distinct().collect()
    groups = {}
    for r in found:
        groups.setdefault(r.g, set()).add(bytes(r.u))
    assert len(want) > 4096 and list(groups.values()) == [want]
    assert {bytes(r.h) for r in found} == {min(want)}


def test_what_meets_in_a_bucket_meets_in_a_group(spark, monkeypatch):
    rng = random.Random(16)
    key = lambda i: i.to_bytes(8, "big")
    buckets = [rng.sample(range(100 * k, 100 * k + 40), rng.randrange(2, 12)) for k in range(6) for _ in range(20)]
    buckets.append(list(range(700, 760)))
    buckets += [rng.sample(range(100), 5) for _ in range(3)]
    rows = [(g, key(min(b)), key(u), u % 7) for g, b in enumerate(buckets) for u in b]
    members = spark.createDataFrame(rows, "g long, h binary, u binary, c long")
    for most in (8192, 50, 25, 8):
        monkeypatch.setattr(simhash, "TOGETHER", most)
        groups = {}
        for r in simhash.gathered(members).collect():
            assert r.c == int.from_bytes(r.u) % 7
            groups.setdefault(r.g, []).append(int.from_bytes(r.u))
        met = {p for g in groups.values() for p in itertools.combinations(sorted(g), 2)}
        assert {p for b in buckets for p in itertools.combinations(sorted(b), 2)} <= met
        assert all(len(g) == len(set(g)) <= 1.8 * most for g in groups.values())
    assert len(buckets) < 130 and len(groups) > 60
