import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wildgrid.operators import similarity
from wildgrid.operators.numbering import first_per_key, with_position
from wildgrid.plans import identification as ident
from wildgrid.plans.external import augment_predictions
from conftest import rows

TEXT = "id_str string, embedding array<float>, description string"
BIO = "id_str string, embedding array<float>"
QUERY = "query_id long, q_clip array<float>, q_bio array<float>, q_dino array<float>, known_species string"
SPECIES = ("taxon_id long, name string, family string, `order` string, image_url string, "
           "dataset_records long, subrepresented boolean")
D = 6


def vector(rng):
    return [float(np.float32(rng.uniform(-1, 1))) for _ in range(D)]


def data(spark, seed=1, n_text=60, n_query=25):
    rng = random.Random(seed)
    texts = [(f"sp_{i}", vector(rng), f"d{i}") for i in range(n_text)]
    texts += [texts[0], texts[0], ("sp_3", texts[3][1], "other text")]  # copies, and one id twice
    bios = [(f"sp_{i}", vector(rng)) for i in range(n_text) if i % 7 != 6]
    bios += [("sp_5", vector(rng))]  # one id twice
    anchors = [(f"sp_{rng.randrange(n_text)}", vector(rng)) for _ in range(200)]
    anchors += [("sp_1", vector(rng)) for _ in range(100)]  # one species with a third of all images
    anchors = [a for a in anchors if a[0] not in ("sp_2", "sp_4")]
    species = [
        (-1 - i, f"Sp {i}", None if i % 5 == 0 else f"F{i % 3}", f"O{i % 2}", None, i, i % 4 == 0)
        for i in range(n_text) if i % 9 != 8
    ] + [(-500, "SP 1", "wrong", "wrong", "wrong", 0, False)]
    queries = [(q, vector(rng), vector(rng), vector(rng), "sp 1" if q % 2 else None) for q in range(n_query)]
    frames = {
        "queries": spark.createDataFrame(queries, QUERY),
        "text_clip": spark.createDataFrame(texts, TEXT),
        "text_bio": spark.createDataFrame(bios, BIO),
        "anchors": spark.createDataFrame(anchors, BIO),
        "species": spark.createDataFrame(species, SPECIES),
    }
    return frames, (queries, texts, bios, anchors, species)


def normalised(v):
    v = np.array(v, dtype="float64")
    return v / np.sqrt((v * v).sum())


def brute(raw, top_m, top_k, lam=0.7):
    queries, texts, bios, anchors, species = raw
    bio = {}
    for i, v in sorted(bios, reverse=True):
        bio[i] = v  # the smallest vector of an id is used
    meta = {}
    for s in sorted(species, reverse=True):
        meta.setdefault(s[1].lower().replace(" ", "_"), s)
    out = {}
    for q, qc, qb, qd, _ in queries:
        cands = []
        for slug, v, text in texts:
            if slug in bio:
                c, b = float(normalised(qc) @ np.array(v)), float(normalised(qb) @ np.array(bio[slug]))
                cands.append((-round((c + b) / 2, 10), slug, text, c, b))
        first = []
        for rank, (_, slug, text, c, b) in enumerate(sorted(cands)[:top_m], 1):
            m = meta.get(slug)
            name = m[1] if m else slug.replace("_", " ").capitalize()
            first.append({"rank": rank, "slug": slug, "description": text, "name": name,
                          "family": m and m[2], "order": m and m[3], "subrepresented": bool(m and m[6]),
                          "score_bioclip": round(b, 4), "score_clip": round(c, 4), "score_ensemble": round((c + b) / 2, 4)})
        for cand in first:
            sims = [float(normalised(qd) @ np.array(v)) for s, v in anchors if s == cand["slug"]]
            dino = max(sims) if sims else 0.0
            cand["score_dino"] = round(dino, 4)
            cand["score_final"] = round(lam * cand["score_ensemble"] + (1 - lam) * dino, 4)
        again = sorted(first, key=lambda r: -r["score_final"])
        for i, r in enumerate(again, 1):
            r["rank_final"], r["rank_delta"] = i, r["rank"] - i
        out[q] = (first, again[:top_k])
    return out


@pytest.mark.parametrize("left_block, right_block, chunk", [(8192, 8192, 256), (9, 7, 2)])
def test_stages_equal_brute_force(spark, monkeypatch, left_block, right_block, chunk):
    """Small blocks cut the corpus, and the species with most images, many times."""
    monkeypatch.setattr(similarity, "CHUNK", chunk)
    monkeypatch.setattr(similarity, "LEFT_BLOCK", left_block)
    monkeypatch.setattr(similarity, "RIGHT_BLOCK", right_block)
    frames, raw = data(spark)
    want = brute(raw, 15, 5)
    got = ident.identify(*frames.values(), top_m=15, top_k=5)
    fields = ["query_id", "rank", "slug", "description", "name", "family", "order", "subrepresented",
              "score_bioclip", "score_clip", "score_ensemble"]
    assert rows(got["stage1"], *fields) == sorted(
        (tuple([q, *[r[f] for f in fields[1:]]]) for q in want for r in want[q][0][:10]), key=repr
    )
    fields = ["query_id", "rank_final", "rank_delta", "slug", "description", "score_dino", "score_final"]
    assert rows(got["stage2"], *fields) == sorted(
        (tuple([q, *[r[f] for f in fields[1:]]]) for q in want for r in want[q][1]), key=repr
    )
    for r in got["stage3"].collect():
        top = want[r.query_id][1]
        margin = top[0]["score_final"] - top[1]["score_final"]
        family = sum(1 for c in top if c["family"] and c["family"] == top[0]["family"]) / len(top)
        order = sum(1 for c in top if c["order"] and c["order"] == top[0]["order"]) / len(top)
        assert (r.predicted_species, r.margin) == (top[0]["name"], round(margin, 4))
        assert (r.family_consensus, r.order_consensus) == (round(family, 2), round(order, 2))
        text = (f"Top-1 '{top[0]['name']}' con score_final={top[0]['score_final']:.4f}; margen sobre #2 = {margin:.4f}; "
                f"consenso de familia en top-5 = {family * 100:.0f}%; consenso de orden = {order * 100:.0f}%")
        if top[0]["subrepresented"]:
            text += "; especie subrepresentada en el dataset (pocos registros de referencia)"
        assert r.rationale == text + "."
    known = {r.query_id: r.top1_is_known for r in got["known"].collect()}
    assert known == {q: want[q][1][0]["name"].lower() == "sp 1" for q in want if q % 2}


def test_no_candidates(spark):
    frames, _ = data(spark, n_text=10, n_query=2)
    frames["text_bio"] = frames["text_bio"].filter("false")
    got = ident.identify(*frames.values())
    assert got["stage2"].count() == 0
    assert rows(got["stage3"], "query_id", "predicted_species", "confidence", "margin", "rationale") == [
        (0, None, "baja", None, "Sin candidatos."), (1, None, "baja", None, "Sin candidatos."),
    ]


def test_a_single_candidate_has_its_own_score_as_margin(spark):
    frames, _ = data(spark, n_text=4, n_query=3)
    frames["text_clip"] = frames["text_clip"].filter("description = 'd0'").distinct()
    got = ident.identify(*frames.values())
    scores = dict(rows(got["stage2"], "query_id", "score_final"))
    assert dict(rows(got["stage3"], "query_id", "margin")) == scores


def test_a_query_without_direction_finds_nothing(spark):
    frames, _ = data(spark, n_text=5, n_query=3)
    flat = F.when(F.col("query_id") == 1, F.transform("q_clip", lambda x: x * 0)).otherwise(F.col("q_clip"))
    frames["queries"] = frames["queries"].withColumn("q_clip", flat.cast("array<float>"))
    got = ident.identify(*frames.values())
    assert {r.query_id for r in got["stage1"].collect()} == {0, 2}
    assert dict(rows(got["stage3"], "query_id", "rationale"))[1] == "Sin candidatos."


def test_corpus_vectors_are_not_scaled(spark):
    frames, _ = data(spark, n_text=4, n_query=1)
    longer = {**frames, "text_clip": frames["text_clip"].withColumn("embedding", F.transform("embedding", lambda x: (x * 4).cast("float")))}
    a = dict(rows(ident.identify(*frames.values())["stage1"], "description", "score_clip"))
    b = dict(rows(ident.identify(*longer.values())["stage1"], "description", "score_clip"))
    assert all(abs(b[k] - 4 * a[k]) < 1e-3 for k in a)


def test_one_id_with_a_third_of_the_corpus(spark, monkeypatch):
    """Copies of a text are merged, so they do not fill a block, and still take their ranks."""
    monkeypatch.setattr(similarity, "RIGHT_BLOCK", 50)
    rng = random.Random(2)
    best = [1.0] + [0.0] * (D - 1)
    texts = [("hot", best, "h")] * 500 + [(f"t{i}", vector(rng), "x") for i in range(1000)]
    frame = spark.createDataFrame(texts, TEXT)
    bios = frame.select("id_str", "embedding").distinct()
    corpus = ident.align_spaces(frame, bios)
    assert corpus.count() == 1001
    queries = spark.createDataFrame([(1, best, best, best, None)], QUERY)
    species = spark.createDataFrame([], SPECIES)
    first = ident.stage1(queries, frame, bios, species)
    assert [r.slug for r in first.orderBy("rank").collect()] == ["hot"] * 30


def test_augmenting_keeps_values_without_metadata(spark):
    predictions = spark.createDataFrame(
        [(1, "ant", "F0", "O0", "i0", 5), (2, "unknown", "F1", None, None, None), (3, None, "F2", None, None, None)],
        "query_id int, name string, family string, `order` string, image_url string, dataset_records long",
    )
    species = spark.createDataFrame([(-2, "ANT", "F9", None, None, 0, False), (-1, "Ant", "F8", None, "i8", None, False)], SPECIES)
    assert rows(augment_predictions(predictions, species), "query_id", "taxon_id", "family", "order", "image_url", "dataset_records") == sorted([
        (1, -1, "F8", "O0", "i8", 5), (2, None, "F1", None, None, None), (3, None, "F2", None, None, None),
    ], key=repr)


def test_augmenting_falls_back_on_other_names(spark):
    predictions = spark.createDataFrame(
        [(1, "", "ANT", "bee"), (2, None, "", "Bee"), (3, "cat", "ant", None), (4, "", None, "")],
        "query_id int, name string, target_species string, species string",
    )
    species = spark.createDataFrame([(-1, "Ant", "F1", None, None, None, False), (-2, "bee", "F2", None, None, None, False)], SPECIES)
    assert rows(augment_predictions(predictions, species), "query_id", "name", "taxon_id", "family") == sorted(
        [(1, "ANT", -1, "F1"), (2, "Bee", -2, "F2"), (3, "cat", None, None), (4, "", None, None)], key=repr
    )
    unnamed = augment_predictions(predictions.drop("name"), species)
    assert rows(unnamed, "query_id", "name", "family") == sorted(
        [(1, "ANT", "F1"), (2, "Bee", "F2"), (3, "ant", "F1"), (4, None, None)], key=repr
    )


def test_first_per_key_treats_null_as_a_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 3, "z"), (None, 4, "w")], "k string, o int, v string")
    assert rows(first_per_key(df, ["k"], ["o"])) == sorted([("a", 1, "y"), (None, 3, "z")], key=repr)


def test_positions_follow_the_order_without_gaps(spark):
    values = list(range(5000))
    random.Random(4).shuffle(values)
    df = spark.createDataFrame([(v // 10, v % 10) for v in values], "a int, b int").repartition(13)
    got = with_position(df, ["a", "b"], "n").collect()
    assert sorted((r.n, r.a * 10 + r.b) for r in got) == [(i, i) for i in range(5000)]
