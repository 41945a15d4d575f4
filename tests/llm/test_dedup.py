"""Line dedup, suffix dedup and SimHash against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from wildgrid.llm import line_dedup, simhash, suffix_dedup
from wildgrid.llm.levels import LevelledRuns

SCHEMA = "doc_id long, text string, kept string, _row long, fp string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 7, "f") for i, t in rows], SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghéñ", k=rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    passage, line = words(rng, 90), "A very common LINE of thirty characters"
    rows = [(k, words(rng, rng.randint(1, 120))) for k in range(40)]
    rows += [(100 + k, words(rng, 20) + passage + words(rng, 20)) for k in range(12)]
    rows += [(200 + k, f"{words(rng, 5)}\n \t{line.lower() if k % 2 else line}\x0b\n{words(rng, 9)}\n{line}") for k in range(9)]
    base = words(rng, 150)
    rows += [(300 + k, base) for k in range(5)] + [(310 + k, base + f" tail{k}") for k in range(5)]
    rows += [(400, None), (401, ""), (402, "\n\n"), (None, "no id " * 60), (None, line), (500, "a" * 900), (501, "ab" * 450)]
    rows += [(600, rows[0][1]), (600, rows[0][1]), (601, "same id\n" + line), (601, "same id, other text\n" + line)]
    return rows


def lines_brute(rows):
    def key(line):
        stripped = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in stripped)

    docs = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                docs[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            held = docs.get(key(line), set())
            last = max((d for d in held if d is not None), default=None)
            if len(held) < 3 or doc == last:
                kept.append(line)
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def as_sorted(rows):
    return sorted(map(tuple, rows), key=repr)


def test_lines(spark, corpus):
    got = line_dedup.digests(spark, frame(spark, corpus)).collect()
    assert as_sorted(got) == as_sorted(lines_brute(corpus))
    assert sum(r.n_dropped for r in got) > 10


def test_lines_keep_other_columns(spark, corpus):
    docs = frame(spark, corpus)
    out = line_dedup.drop_lines(spark, docs, kept="rest", batches=7)
    assert out.columns == [*docs.columns, "rest", "n_lines", "n_dropped"]
    assert out.count() == len(corpus)
    assert line_dedup.digests(spark, docs.limit(0)).count() == 0


def test_runs_merge_by_levels(spark):
    store = LevelledRuns(spark, ["k"], {"n": "sum", "low": "min", "high": "max"})
    want = defaultdict(list)
    for batch in range(9):
        rows = [(k % (batch + 3), batch * 10 + k) for k in range(8)]
        for k, v in rows:
            want[k].append(v)
        store.add(spark.createDataFrame([(k, 1, v, v) for k, v in rows], "k long, n long, low long, high long"))
    sizes = [len(level) for level in store.levels]
    assert sum(sizes) < 9 and len(sizes) >= 3
    from pyspark.sql import functions as F

    got = {r.k: (r.n, r.low, r.high) for r in store.totals(F.col("n") > 1).collect()}
    assert got == {k: (len(v), min(v), max(v)) for k, v in want.items() if len(v) > 1}


def suffix_brute(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for doc, text in texts:
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - length + 1):
            if seen[text[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        out.append((doc, len(text), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats(spark, corpus):
    got = suffix_dedup.digests(spark, frame(spark, corpus)).collect()
    assert as_sorted(got) == as_sorted(suffix_brute(corpus, 200))
    assert sum(r.n_removed for r in got) > 1000


@pytest.mark.parametrize("length, batches, crowded", [(60, 5, 50_000), (60, 1, 0), (200, 3, 2)])
def test_repeats_of_other_lengths_and_crowded_anchors(spark, corpus, length, batches, crowded):
    out = suffix_dedup.remove_repeats(spark, frame(spark, corpus), length=length, batches=batches, crowded=crowded)
    got = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest())
           for r in out.collect()]
    assert as_sorted(got) == as_sorted(suffix_brute(corpus, length))


def test_repeats_of_nothing(spark, corpus):
    assert suffix_dedup.digests(spark, frame(spark, corpus).limit(0)).count() == 0


def test_repeats_in_small_pieces(spark, corpus, monkeypatch):
    group = [(0, 0, b"")]
    texts = [(t or "").encode() for _, t in corpus]
    whole = Counter()
    for group in suffix_dedup.pieces(texts, 200):
        text, start, windows, anchor, _ = suffix_dedup.segments(group, 200)
        for t, s, n, a in zip(text, start, windows, anchor):
            for i in range(s, s + n):
                whole[(int(t), int(i))] += 1
    want = {(k, i) for k, t in enumerate(texts) for i in range(len(t) - 199)}
    assert set(whole) == want and set(whole.values()) == {1}


def test_suffix_ranks():
    data = np.frombuffer(b"banana bandana banana\0ban", np.uint8)
    for depth in (1, 3, 8, 11, 20):
        ranks = suffix_dedup.suffix_ranks(data, depth)
        padded = data.tobytes() + bytes(depth)
        cut = [padded[i : i + depth] for i in range(len(data))]
        order = {c: k for k, c in enumerate(sorted(set(cut)))}
        # Bytes of zero at the end and past it are told apart from depth nine on.
        assert [order[c] for c in cut] == ranks.tolist() or depth > 8
        assert all((ranks[i] == ranks[j]) == (cut[i] == cut[j]) for i in range(21) for j in range(21) if max(i, j) + depth <= 25)


def fingerprint_brute(text):
    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    found = [w for w in low.split(" ") if w]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 4]) for i in range(max(len(found) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_brute(points, radius):
    parent = {p: p for p in points}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for p in points:
        for q in points:
            if p < q and bin(p ^ q).count("1") <= radius:
                parent[find(p)] = find(q)
    return {p: find(p) for p in points}


def test_near_copies(spark, corpus):
    got = simhash.digests(spark, frame(spark, corpus)).collect()
    prints = [fingerprint_brute(t) for _, t in corpus]
    root = components_brute(set(prints), 4)
    least = defaultdict(list)
    for (doc, _), p in zip(corpus, prints):
        least[root[p]].append(doc)
    want = [(doc, f"{p:016x}", min((d for d in least[root[p]] if d is not None), default=None)) for (doc, _), p in zip(corpus, prints)]
    assert as_sorted(got) == as_sorted(want)


@pytest.mark.parametrize("cell_rows", [8192, 4])
def test_links_connect_what_brute_force_connects(spark, cell_rows):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(12)]
    points = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centres for _ in range(25)}
    points |= {rng.getrandbits(64) for _ in range(100)} | {0, 2**64 - 1}
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in points]
    links = simhash.links_within(spark, spark.createDataFrame(signed, "fp long"), 4, cell_rows).collect()
    root = components_brute(points, 4)
    parent = {p: p for p in points}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in links:
        a, b = a % 2**64, b % 2**64
        assert bin(a ^ b).count("1") <= 4
        parent[find(a)] = find(b)
    groups = lambda f: {frozenset(q for q in points if f(q) == f(p)) for p in points}
    assert groups(find) == groups(root.get)


@pytest.mark.parametrize("n", [10, 10_000, 10**8])
def test_thresholds_keep_the_pigeonhole(n):
    rng = np.random.default_rng(1)
    bits = rng.random((500, 64)) < rng.uniform(0.2, 0.8, 64)
    both = bits.T.astype(float) @ bits / 500 * n
    plan = simhash.allocate(n, both, 4)
    used = [b for part, _ in plan for b in part]
    assert len(used) == len(set(used))
    assert sum(t + 1 for _, t in plan) == 5


def test_one_of_each(spark, corpus):
    docs = frame(spark, corpus)
    got = simhash.one_of_each(spark, docs)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    groups = {r.component_id for r in simhash.digests(spark, docs).collect()}
    assert sorted(ids, key=repr) == sorted(groups, key=repr)
    assert simhash.one_of_each(spark, docs.limit(0)).count() == 0
