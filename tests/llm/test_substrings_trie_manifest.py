"""Word-sequence dedup, prefix trie and manifest against brute force, with odd rows of every kind."""

import random
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from wildgrid.llm import merkle_manifest, prefix_trie, substring_dedup


def as_sorted(rows):
    return sorted(map(tuple, rows), key=repr)


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


# --- word sequences

SCHEMA = "doc_id long, text string, start long, spans string, kept string, k1 long, data string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", "k", 2, "d") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    passage, intro = words(rng, 60), words(rng, 12)
    rows = [(k, " ".join(words(rng, rng.randint(0, 90)))) for k in range(30)]
    rows += [(100 + k, " ".join(words(rng, 9) + passage[k : 60 - k] + words(rng, 9))) for k in range(20)]
    # Many different texts around one frequent prefix.
    rows += [(200 + k, " ".join(words(rng, 20) + intro + words(rng, 40))) for k in range(25)]
    rows += [(300, "\t \n".join(passage)), (301, " ".join(passage)), (301, " ".join(passage)), (302, "a " * 300), (303, "a b " * 80)]
    rows += [(304, "é" * 9000 + " " + " ".join(passage)), (400, None), (401, ""), (402, " \x0b\x0c\r\n"), (403, "one")]
    rows += [(None, " ".join(passage[:40])), (None, None), (500, " ".join(words(rng, 34))), (501, " ".join(passage[:35]))]
    rows += [(502, "  ".join(passage[:36])), (503, " ".join(["x"] * 34)), (504, "\x00 \x1c " * 30)]
    return rows


def sequences_brute(rows, length):
    docs = [(d, (t or "").encode().split()) for d, t in rows]
    seen = Counter(tuple(w[i : i + length]) for _, w in docs for i in range(len(w) - length + 1))
    out = []
    for doc, found in docs:
        gone = [False] * len(found)
        for i in range(len(found) - length + 1):
            if seen[tuple(found[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept = b" ".join(w for w, g in zip(found, gone) if not g)
        out.append((doc, len(found), sum(gone), sha256(kept).hexdigest()))
    return out


def test_sequences(spark, corpus):
    got = substring_dedup.digests(spark, frame(spark, corpus)).collect()
    assert as_sorted(got) == as_sorted(sequences_brute(corpus, 35))
    assert sum(r.n_removed for r in got) > 1000


@pytest.mark.parametrize("length, prefixes, group", [(35, (8, 16), 3), (35, (8, 16), 0), (20, (4,), 2), (17, (16,), 50)])
def test_sequences_of_groups_that_do_not_fit(spark, corpus, length, prefixes, group):
    out = substring_dedup.remove_repeats(spark, frame(spark, corpus), length=length, prefixes=prefixes, group=group)
    got = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), sha256(r.kept).hexdigest()) for r in out.collect()]
    assert as_sorted(got) == as_sorted(sequences_brute(corpus, length))


def test_sequences_of_nothing(spark, corpus):
    assert substring_dedup.digests(spark, frame(spark, corpus).limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(spark, frame(spark, corpus), length=8)


def test_each_window_is_in_one_segment(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 5, n).astype(np.uint64) for n in (0, 34, 35, 36, 700, 200)] + [np.zeros(500, np.uint64)]
    monkeypatch.setattr(substring_dedup, "_PIECE", 256)
    held = Counter()
    rows = 0
    for group in substring_dedup.grouped(iter(texts), 35):
        for n, start, size, times, _, _ in zip(*substring_dedup.segments(group, 35, 8)):
            rows += 1
            held.update((int(n), int(i)) for i in range(start, start + size * times))
    assert set(held) == {(k, i) for k, t in enumerate(texts) for i in range(len(t) - 34)}
    assert set(held.values()) == {1}
    # A text of one word is a row for each piece, not for each word.
    assert rows < 400


def test_long_texts_are_cut_at_blanks(monkeypatch):
    monkeypatch.setattr(substring_dedup, "_SLICE", 7)
    text = b" ab\tcd  efghijklmnopq r\n\ns " * 5
    assert [w for part in substring_dedup.slices(text) for w in part] == text.split()
    spans = [(1, 3), (6, 7), (9, 25)]
    kept = [w for k, w in enumerate(text.split()) if not any(a <= k < b for a, b in spans)]
    assert substring_dedup.without(text, spans) == (len(text.split()), b" ".join(kept))


# --- conversations


def trie_brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    turns = {c: [(r, x) for _, _, r, x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, own in turns.items():
        h = crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, turns_of in built.items():
        for d in range(len(turns_of) + 1):
            members[turns_of[:d]].append(c)
            if d:
                children[turns_of[: d - 1]].add(turns_of[:d])
    saved, leaves = Counter(), Counter()
    for node, held in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(held) - 1) * len(node[-1][1]) if node else 0
            leaves[node[:d]] += node not in children
    out = []
    for node, held in members.items():
        ends = ",".join(str(c) for c in sorted(held) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(held), len(node), parent, len(held), len(children[node]) if node in children else 0,
                    leaves[node], saved[node], sha256(ends.encode()).hexdigest()))
    return out


def talks(spark, rows):
    schema = "conv_id long, turn long, role string, text string, depth long, c string, k1 string, at string"
    return spark.createDataFrame([(*r, 9, "c", "k", "a") for r in rows], schema)


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(8)
    said = ["", "hello", "é" * 40, "yes, please", "ab", "a", "b"]
    rows = []
    for c in range(0, 160):
        if c % 7:
            rows += [(c, t, rng.choice(["user", "assistant", "u", None]), rng.choice(said[: 2 + c % 6])) for t in range(rng.randint(1, 14))]
    rows += [(1000 + k, 1, "user", "one and the same") for k in range(40)]
    rows += [(2000, t // 3 if t % 5 else None, "user", f"turn {t % 11}") for t in range(300)]
    rows += [(2003, t, None, None) for t in range(12)] + [(2004, None, "user", "x")] * 3 + [(None, 1, "user", "lost"), (None, None, None, None)]
    return rows + [(2010, 1, "user", "long " * 50_000), (-7, 1, "user", "minus"), (-5, 1, "user", "minus")]


@pytest.mark.parametrize("bits, chunk", [(10, 12), (2, 0)])
def test_trie(spark, conversations, monkeypatch, bits, chunk):
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", bits)
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", chunk)
    rows = [r for r in conversations if r[0] is None or r[0] >= 0]
    got = prefix_trie.digests(spark, talks(spark, rows))
    assert as_sorted(got.collect()) == as_sorted(trie_brute(rows))


def test_trie_of_few(spark):
    assert prefix_trie.digests(spark, talks(spark, [(1, 1, "u", "x")]).limit(0)).count() == 0
    # Base conversation absent and all own turns cut off: the root alone.
    lone = next(c for c in range(1, 99) if c % 5 and crc32(str(c).encode()) % 9 >= 2)
    rows = [(lone, 1, "user", "x")]
    assert as_sorted(prefix_trie.digests(spark, talks(spark, rows)).collect()) == as_sorted(trie_brute(rows))
    assert len(trie_brute(rows)) == 1


# --- manifest


def joined(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return joined("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([joined(levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def way(levels, at, fanout):
    out = []
    for level in levels[:-1]:
        start = at // fanout * fanout
        out.append((at - start, level[start : start + fanout]))
        at //= fanout
    return out


def manifest_brute(rows, fanout=16):
    held = defaultdict(list)
    for doc, text, lang, source, n in rows:
        held[source].append((doc, leaf_of(doc, source, lang, n, text), text, lang, n))
    order = sorted(held, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        held[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = tree([r[1] for r in held[s]], fanout)
    top = tree([trees[s][-1][0] for s in order], fanout)
    out = []
    for k, s in enumerate(order):
        for i, (doc, leaf, text, lang, n) in enumerate(held[s]):
            path = way(trees[s], i, fanout) + way(top, k, fanout)
            proof = joined(x for at, run in path for j, x in enumerate(run) if j != at)
            now = leaf
            if doc is not None and crc32(str(doc).encode()) % 5 == 0:
                low = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
                now = leaf_of(doc, s, lang, n, low)
            for at, run in path:
                now = joined([*run[:at], now, *run[at + 1 :]])
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return out


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(6)
    rows = [(k, f"Text {k} ÄB", "en", f"s{rng.randrange(3)}" if k % 3 else "hot", k) for k in range(700)]
    rows += [(1000 + k, "Own", None, f"alone {k}", 3) for k in range(40)]
    rows += [(None, None, None, None, None), (None, "x", "en", None, 1), (5, "", "", "", 0), (5, "", "", "", 0), (6, "No", "", "é", 0)]
    return rows + [(7, "Same", "de", "copies", 4)] * 60 + [(8, "L" * 400_000, "en", "hot", None), (9, "A:1-", "-", "~", 0)]


def docs(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, leaf string, p long, grp string, path string"
    return spark.createDataFrame([(*r, "l", 0, "g", "p") for r in rows], schema)


def test_manifest(spark, documents):
    got = merkle_manifest.digests(spark, docs(spark, documents))
    assert as_sorted(got.collect()) == as_sorted(manifest_brute(documents))


@pytest.mark.parametrize("fanout, height", [(2, 1), (3, 2), (2, 0), (16, 1)])
def test_proofs_lead_to_the_root(spark, documents, fanout, height):
    got = merkle_manifest.proofs(spark, docs(spark, documents), fanout=fanout, height=height).collect()
    want = manifest_brute(documents, fanout)
    assert as_sorted((r.doc_id, r.leaf, r.subroot, r.root, joined(u.others for u in r.path)) for r in got) == as_sorted(w[:5] for w in want)
    assert all(merkle_manifest.fold(r.leaf, [(u.place, u.others) for u in r.path]) == r.root for r in got)
    assert not any(merkle_manifest.fold(joined(["other"]), [(u.place, u.others) for u in r.path]) == r.root for r in got)


def test_manifest_of_one_or_none(spark, documents):
    assert merkle_manifest.digests(spark, docs(spark, documents).limit(0)).count() == 0
    one = documents[:1]
    assert as_sorted(merkle_manifest.digests(spark, docs(spark, one)).collect()) == as_sorted(manifest_brute(one))
