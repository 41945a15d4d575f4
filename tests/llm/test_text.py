"""Byte BPE, decontamination and licence scans."""

import hashlib
import random
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from wildgrid.llm import byte_bpe, decontaminate, licenses, registry

ODD = [(1, None), (2, ""), (2, ""), (None, "ab"), (3, " \n\t  x  "), (4, "Ünï 漢字 🙂 don't 12345 ... !!"), (5, "a" * 3000), (6, "\x00\x7f")]


def frame(spark, rows, name="doc_id"):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], f"{name} long, text string, hits string, ids long")


def test_bpe_equals_tiktoken(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.load_ranks(path)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    rows = ODD + [(10 + k, "".join(rng.choices("abc deé\n  '!tsre漢🙂0", k=rng.randint(1, 400)))) for k in range(60)]
    got = byte_bpe.digests(frame(spark, rows), registry.tokenizer(spark)).collect()
    want = []
    for doc, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert byte_bpe.digests(frame(spark, rows).limit(0), registry.tokenizer(spark)).count() == 0


def test_bpe_of_long_texts(monkeypatch):
    import public_tokenizers as P

    tokenizer = byte_bpe.Tokenizer(byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    text = "some words, and more of them " * 200
    usual = tokenizer.encode(text)
    monkeypatch.setattr(byte_bpe, "_PIECES", 10)
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 2)
    assert tokenizer.encode(text) == usual
    assert tokenizer.decode(usual) == text.encode()


def test_columns_of_ids(spark):
    bpe = registry.tokenizer(spark)
    rows = frame(spark, ODD).withColumn("packed", bpe.encode(F.col("text"))).withColumn("back", bpe.decode(F.col("packed")))
    assert all(bytes(r.back) == (r.text or "").encode() for r in rows.collect())


BENCH = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short-item here"), (2, "tiny"), (3, None),
         (None, "nobody owns these words"), (4, ""), (5, "one two three four five six seven eight nine ten eleven")]
DOCS = [
    (1, None), (2, ""), (3, "zero ONE two three, four five six seven eight nine ten eleven twelve"), (3, "short item HERE tiny"),
    (4, "short item, there"), (5, "nobody owns these words tiny"), (6, "one two three four five six seven eight nine"),
    (None, "tiny " * 30), (7, "éÉ one"),
]


def hits_brute(rows, bench):
    out = []
    for doc, text in rows:
        words, hit, items = decontaminate.words_of(text), set(), set()
        for item, body in bench:
            parts = decontaminate.words_of(body)
            size = min(10, len(parts))
            windows = {tuple(parts[i : i + size]) for i in range(len(parts) - size + 1)} if size else set()
            for i in range(len(words)):
                if size and tuple(words[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    items |= {str(item)} - {"None"}
        listed = ",".join(sorted(items))
        out.append((doc, len(words), len(hit), len(items), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_windows(spark):
    got = decontaminate.digests(spark, frame(spark, DOCS), frame(spark, BENCH, "item_id")).collect()
    assert sorted(map(tuple, got), key=repr) == hits_brute(DOCS, BENCH)


def test_windows_in_blocks(spark):
    rng = random.Random(8)
    bench = [(k, " ".join(rng.choices("abcdef", k=rng.randint(1, 14)))) for k in range(12)]
    docs = [(k, " ".join(rng.choices("abcdef", k=rng.randint(0, 200)))) for k in range(40)]
    whole = decontaminate.find_windows(spark, frame(spark, docs), frame(spark, bench, "item_id"))
    parts = decontaminate.find_windows(spark, frame(spark, docs), frame(spark, bench, "item_id"), block_words=20)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, parts.collect()))
    got = decontaminate.digests(spark, frame(spark, docs), frame(spark, bench, "item_id")).collect()
    assert sorted(map(tuple, got), key=repr) == hits_brute(docs, bench)


def test_no_benchmark_and_no_documents(spark):
    docs, bench = frame(spark, DOCS), frame(spark, BENCH, "item_id")
    assert not any(r.contaminated for r in decontaminate.digests(spark, docs, bench.limit(0)).collect())
    assert decontaminate.digests(spark, docs.limit(0), bench).count() == 0


def test_every_known_sentence_has_a_cue_and_its_own_form():
    assert all(any(cue in s.lower() for cue in licenses.CUES) for s in licenses.SENTENCES.values())
    assert len(licenses.known_sentences()) == len(licenses.SENTENCES)
    assert all(name in licenses.SENTENCES for _, names in licenses.RULES for name in names)


def test_licenses(spark):
    s = licenses.SENTENCES
    rows = [
        (1, None), (2, ""), (3, "nothing of the kind"), (3, f"Intro. {s['apache-short']} More words."),
        (4, "\n".join([s["apache-header"], "unknown between", s["apache-comply"], s["apache-copy"]])),
        (5, f"{s['mit-short'].upper()}\n{s['cc-by-nc']}\n{s['mit-short']}"),
        (6, "\n".join(s[n] for n in ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"))),
        (7, s["mit-notice"]), (None, s["cc0"]), (8, "license " * 20_000),
    ]
    got = {(r.doc_id, r.n_sentences, r.n_matches, r.licenses) for r in licenses.digests(frame(spark, rows)).collect()}
    assert got == {
        (1, 0, 0, ""), (2, 0, 0, ""), (3, 0, 0, ""), (3, 1, 1, "Apache-2.0"), (4, 3, 1, "Apache-2.0"), (5, 3, 3, "CC-BY-NC-4.0,MIT"),
        (6, 4, 1, "BSD-3-Clause"), (7, 1, 0, ""), (None, 1, 1, "CC0-1.0"), (8, 0, 0, ""),
    }
    assert licenses.digests(frame(spark, rows).limit(0)).count() == 0


def test_every_known_sentence_is_found_in_a_text(spark):
    names = list(licenses.SENTENCES)
    rows = [(k, f"Before it. {licenses.SENTENCES[n]}\nAfter it.") for k, n in enumerate(names)]
    got = {r.doc_id: r.sentence_ids for r in licenses.digests(frame(spark, rows)).collect()}
    assert got == dict(enumerate(names))
    both = f"{licenses.SENTENCES['mpl-2']} {licenses.SENTENCES['mpl-2-dist']} See appendix v. Licensed under CC BY 4.0."
    assert licenses.digests(frame(spark, [(1, both)])).first().licenses == "CC-BY-4.0,MPL-2.0"


def test_padded_license_lines(spark):
    s = licenses.SENTENCES["mit-short"]
    rows = [(1, " " * 500 + s), (2, "/" + "*" * 300 + " " + s + " " + "*" * 300 + "/"), (3, "許諾" * 200 + " " + s), (4, "x" * 400 + " " + s)]
    got = {r.doc_id: r.licenses for r in licenses.digests(frame(spark, rows)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "MIT", 4: ""}


def test_notices_in_any_wrapping(spark):
    def whole(*names):
        return " ".join(next(s for i, s in licenses.WHOLE if n in i.split()) for n in names)

    gpl = whole("gpl-version-3", "gpl-no-warranty", "gpl-details")
    older = gpl.replace("software:", "software;").replace("Foundation,", "Foundation;").replace("version 3", "version 2")
    url = "http://www.apache.org/licenses/LICENSE-2.0"
    apache = whole("apache-header") + f" You may obtain a copy of the License at {url} " + whole("apache-required", "apache-see")
    bsd = "{} 1. {} 2. {}".format(*map(whole, ("bsd-redistribution", "bsd-source", "bsd-binary")))
    notices = {"MIT": whole("mit-grant", "mit-notice", "mit-as-is"), "GPL-3.0": gpl, "GPL-2.0": older, "Apache-2.0": apache,
               "BSD-2-Clause": bsd, "BSD-3-Clause": f"{bsd} 3. {whole('bsd-endorse')}", "ISC": whole("isc-grant"),
               "MPL-2.0": licenses.SENTENCES["mpl-2"]}
    rows, want = [], {}
    for k, (name, notice) in enumerate(notices.items()):
        for width in (28, 45, 72, 100, 9999):
            for start in ("", "# ", " * "):
                want[len(rows)] = (1, name)
                lines = "\n".join(start + line for line in textwrap.wrap(notice, width, break_long_words=False, break_on_hyphens=False))
                rows.append((len(rows), f"Some words before\n\n{lines}\n\nand after"))
    rows.append((len(rows), "Permission is hereby granted, free of\n\ncharge, to any person obtaining a copy"))
    want[len(rows) - 1] = (0, "")
    got = {r.doc_id: (r.n_matches, r.licenses) for r in licenses.digests(frame(spark, rows)).collect()}
    assert got == want
