"""Structured words, dense regions, recall, marginals and the pipeline's stages against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loglattice.llm import _words, cotraining, jaccard_join, mixing, packing, pii, substrings, tokens_rans, vectors
from loglattice.llm.queries import _tokenizer

DATA = "/root/testdata/sf0.001"


def passage(seed, n):
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdefgh") for _ in range(pick.randint(2, 7))) for _ in range(n))


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


def word_sets(texts, width=5):
    sets = {}
    for i, text in texts:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    return sets


def components_of(sets, near):
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in near:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {i: root(i) for i in sets}


def near_pairs(sets):
    """Pairs at 0.75 or more, by counting shared shingles."""
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in sets.items():
        shared = Counter(j for x in s for j in holders[x] if j < i)
        yield from ((j, i) for j, n in shared.items() if 100 * n >= 75 * (len(s) + len(sets[j]) - n))


def removed(texts, width=20):
    seen, out = set(), {}
    for i, text in sorted(texts):
        w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            run = tuple(w[k : k + width])
            if run in seen:
                gone[k : k + width] = [True] * width
            seen.add(run)
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.fixture(scope="module")
def structured(spark):
    """Pairs of words whose polynomial hashes modulo 2**64 agree whatever the base, alone and in the middle of texts."""
    texts = []
    for n in (1024, 2048, 4096, 8192):
        one, two = thue_morse(n), thue_morse(n, "ba")
        for word in (one, two):
            texts.append((len(texts), word))
            texts.append((len(texts), f"{passage(n, 12)} {word} {passage(n + 1, 12)}"))
    # windows of two words in the same structure
    for letters in ("xy", "yx"):
        texts.append((len(texts), " ".join({"x": "alpha", "y": "beta"}[c] for c in thue_morse(64, letters))))
    texts += [(len(texts) + k, t) for k, t in enumerate(("x" * 100_000, "x" * 100_001, "a\0 a", "a a\0"))]
    return texts, spark.createDataFrame(texts, "doc_id long, text string")


def test_word_hashes_and_runs():
    n = 4096
    column = pa.array([thue_morse(n), thue_morse(n, "ba"), None, "", "a", "a\0", "ab", "abcdefgh", "abcdefghi", "x" * 64, "x" * 65, "aé", "A"])
    _, offsets, data = next(_words.blocks(column))
    hashes, first = _words.word_hashes(offsets, data)
    assert len(set(hashes.tolist())) == len(hashes) == 11 and np.diff(first).tolist() == [1, 1, 0, 0, *[1] * 9]
    lower, _ = _words.word_hashes(offsets, data, lower=True)
    assert lower[-1] == lower[2]
    draw = np.random.default_rng(3).integers(0, 1 << 61, 300, dtype=np.uint64)
    base = _words.BASES[0]
    for width in (1, 2, 5, 7, 20):
        got = _words._rolled(draw, width, base)
        want = []
        for i in range(301 - width):
            value = 0
            for x in draw[i : i + width].tolist():
                value = (value * base + x) % _words.PRIME
            want.append(value)
        assert [int(g) % _words.PRIME for g in got] == want


def test_structured_words_keep_their_own_ids(structured):
    from tokenizers import Tokenizer

    texts, docs = structured
    whole = Tokenizer.from_file(_tokenizer())
    ids = {i: whole.encode(t, add_special_tokens=False).ids for i, t in texts}
    for r in tokens_rans.token_files(docs, _tokenizer()).collect():
        own = [*ids[r["doc_id"]], 2]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    for r in packing.pack(docs, _tokenizer()).collect():
        assert r["ids_crc32"] == zlib.crc32(np.array([*ids[r["doc_id"]], 1][r["start"] : r["start"] + r["length"]], "<u4").tobytes())


def test_structured_words_are_not_mistaken(structured):
    texts, docs = structured
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(docs).collect()}
    assert got == removed(texts)
    sets = word_sets(texts)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(docs).collect()}
    labels = components_of(sets, near_pairs(sets))
    assert found == {i: (len(s), labels[i]) for i, s in sets.items()}


def test_windows_over_many_buckets(spark, monkeypatch):
    """So many buckets that windows name their document and offset themselves, and shares of one key."""
    shared = passage(1, 400)
    texts = [(i, f"{passage(100 + i, 30)} {' '.join(shared.split()[i : i + 60])} {passage(200 + i, 10)}") for i in range(120)]
    texts += [(i, texts[3][1]) for i in range(120, 140)] + [(140, None), (141, "")]
    monkeypatch.setattr(substrings, "bucket_keys", lambda spark, size: (list(range(40)), 3))
    got = substrings.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == removed(texts)


def _drifting(families, copies, changes, seed):
    pick, out = random.Random(seed), []
    for family in range(families):
        base = passage(1000 * seed + family, 60).split()
        for _ in range(copies):
            own = list(base)
            for _ in range(pick.randint(0, changes)):
                own[pick.randrange(60)] = f"w{pick.randint(0, 30)}"
            out.append((len(out), " ".join(own)))
    return out


@pytest.mark.parametrize(("leaf", "dense"), [(256, 0.7), (24, 0.7), (24, 0.97)])
def test_dense_regions(spark, monkeypatch, leaf, dense):
    """More than a thousand near copies of one text, many of them beyond the threshold: joined whole, divided, in blocks."""
    texts = _drifting(1, 1100, 5, 7) + [(2000 + i, t) for i, t in _drifting(3, 60, 4, 8)]
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "SALT", 4 * leaf)
    monkeypatch.setattr(jaccard_join, "DENSE", dense)
    monkeypatch.setattr(jaccard_join, "SPLIT", leaf // 2)
    levels, voronoi = [], jaccard_join._voronoi
    monkeypatch.setattr(jaccard_join, "_voronoi", lambda level: levels.append(level) or voronoi(level))
    sets = word_sets(texts)
    labels = components_of(sets, near_pairs(sets))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == labels and len(set(labels.values())) > 100 and levels


def test_one_key_may_hold_most_rows(spark):
    """Exact copies, empty texts and null ids in numbers that one task must not hold."""
    texts = [(i, "the same text of more than five words here") for i in range(3000)] + [(3000 + i, "") for i in range(2000)] + [(None, "x y z")] * 500 + [(6000, passage(5, 30))]
    got = jaccard_join.classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert len(got) == len(texts) and all(r["component_id"] == (0 if r["doc_id"] < 3000 else r["doc_id"]) for r in got if r["doc_id"] is not None)
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)


def test_vectors_against_brute_force(spark, monkeypatch):
    """20,000 vectors in shards far larger than the beam, with ties at the threshold, copies and clashing columns."""
    draw = np.random.default_rng(11)
    centre = draw.normal(size=(4000, 16))
    rows = centre[draw.integers(0, 4000, 19_900)] + 0.1 * draw.normal(size=(19_900, 16))
    rows = np.concatenate([rows, rows[:96], np.eye(16)[:1] * 20, [[19, 39**0.5, *[0] * 14]], [[0, 0, 3, 4, *[0] * 12]] * 2]).astype(np.float32).astype(np.float64)
    table = spark.createDataFrame([(i, v.tolist(), 1, 2, "k") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, n long, c long, key string")
    monkeypatch.setattr(vectors, "LEAST_SHARDS", 5)
    got = {r["vec_id"]: r for r in vectors.near_vectors(table).collect()}
    norms = np.linalg.norm(rows, axis=1)
    links, pairs = np.zeros(len(rows), np.int64), []
    for a in range(0, len(rows), 2000):
        near = (rows[a : a + 2000] @ rows.T) / np.outer(norms[a : a + 2000], norms) >= 0.95
        near[np.arange(len(near)), a + np.arange(len(near))] = False
        links[a : a + 2000] = near.sum(1)
        pairs += [(a + x, y) for x, y in zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True)]
    found = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum() and links.sum() > 20_000
    labels = components_of({i: None for i in range(len(rows))}, pairs)
    assert sum(got[i]["component_id"] != labels[i] for i in range(len(rows))) <= 0.005 * len(rows)
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(len(rows)))


def test_raked_marginals_and_budget(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = mixing.described(docs)
    cells = rows.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("n"))
    out = mixing.raked(cells)
    assert mixing.off_target(out) < 0.02 and mixing.off_target(mixing.raked(cells, sweeps=60)) < 1e-4
    total, kept = out.agg(F.sum("n"), F.sum(F.col("n") * F.col("probability"))).first()
    assert abs(kept / total - mixing.BUDGET) < 0.01
    picked = mixing.mixture(docs).where("selected").agg(F.sum("tokens")).first()[0]
    assert 0.3 < picked / total < 0.7
    many = mixing.mixture(docs)
    few = {r["doc_id"]: r["selected"] for r in many.collect()}
    before = mixing.MOST_CELLS
    try:
        mixing.MOST_CELLS = 0  # the way without a broadcast of all cells
        assert {r["doc_id"]: r["selected"] for r in mixing.mixture(docs).collect()} == few
    finally:
        mixing.MOST_CELLS = before


def test_raking_plans_of_few_stages(spark):
    """One sweep's windows at most are dealt anew in a plan, and none where one task rakes; both give the same weights."""
    cells = spark.range(600).selectExpr("concat('s', id % 20) as _source", "concat('l', id % 3) as _lang", "concat('t', id div 60) as _topic", "(id * 7919) % 1000 as n")
    cells = cells.groupBy("_source", "_lang", "_topic").agg(F.sum("n").alias("n"))
    tracker, found = spark.sparkContext.statusTracker(), {}
    for name, options in (("alone", {}), ("dealt", {"few": 0})):
        spark.sparkContext.setJobGroup(f"raking {name}", name)
        try:
            out = mixing.raked(cells, **options).collect()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs = [tracker.getJobInfo(i) for i in tracker.getJobIdsForGroup(f"raking {name}")]
        assert jobs and max(len(job.stageIds) for job in jobs) <= 3 + len(mixing.DIMENSIONS)
        found[name] = {(r["_source"], r["_lang"], r["_topic"]): (r["weight"], r["probability"]) for r in out}
    assert found["alone"].keys() == found["dealt"].keys() and len(found["alone"]) == 600
    for cell, values in found["alone"].items():
        assert values == pytest.approx(found["dealt"][cell], rel=1e-9)


def test_views_exchange_labels(spark):
    import io

    pick, rows, labels = random.Random(3), [], []
    for i in range(1500):
        text, bad, rude = passage(i, 60), i % 5 == 0, i % 7 == 0
        text = " ".join(f"{w}###" for w in text.split()) if bad else text
        rows.append((i, text + (f" {pick.choice(['scum', 'moron', 'trash'])}" * 3 if rude else ""), "en", "s"))
        if i < 900:
            labels.append((i, int(not bad), int(rude)))
    labels += [(5, 1, None), (5, None, 1)]  # labels of one row in parts, ties by the largest
    model = cotraining.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), handed=50)
    given = dict(np.load(io.BytesIO(model)))
    assert given["quality_handed"].sum() > 0 and given["toxic_handed"].sum() > 0 and given["quality_handed"].max() <= 50 * cotraining.ROUNDS


def test_base_spans_against_plain_patterns(spark):
    assert [s for s in pii.base_spans("0" * 5000 + "300.1.1.1 300.1.1.1 " + "0" * 5000 + "25.1.1.255") if s[0] == "ip"] == [("ip", 5020, 10030)]
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        text, spans = r["text"] or "", []
        spans += [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        spans += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        cards = [(m, re.sub("[^0-9]", "", m[0])) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)]
        spans += [("card", m.start(), m.end()) for m, d in cards if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0]
        spans += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert pii.base_spans(text) == spans


def test_contexts_with_many_unseen_strings_are_trusted(spark):
    rows = [(i, f"{passage(i, 5)} callback +1 23{i:02d} 555 60{i:02d} {passage(900 + i, 5)}") for i in range(12)]
    rows += [(100 + i, f"callback 555-667-88{i:02d} {passage(600 + i, 3)}") for i in range(20)]  # more unseen than seen
    rows += [(300, "callback 555-667-8800 x"), (301, f"{'long' * 40} 555-667-8899 y")]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + i] == "phone:9:21" for i in range(20)) and got[300] == "phone:9:21" and got[301] == ""
    assert pii._contexts("a,b 1.2.3.4,5.6.7.8 c9d", [(4, 11), (12, 19)]) == [("ab", ""), ("", "cd")]


def test_redaction_keeps_columns_of_any_name(spark):
    kind = "doc_id long, text string, n_chars long, _k long, _d string, _h long, _spans string, _state int, row string, id long, spans string, `a b` int"
    rows = [(1, "mail a.b@c.de or +1 (234) 555-6789 now", 0, 42, "d", 7, "s", 1, "r", 9, "t", 3), (2, None, None, 1, None, None, None, None, None, None, None, None), (3, "x", 5, *[None] * 9), (None, "ip 1.2.3.4", 9, *[None] * 9)]
    rows.append(rows[0])
    table = spark.createDataFrame(rows, kind)
    got = sorted((tuple(r) for r in pii.redact(table).collect()), key=str)
    want = [(1, "mail [EMAIL] or [PHONE] now", 27, *rows[0][3:])] * 2 + [rows[1], rows[2], (None, "ip [IP]", 7, *[None] * 9)]
    assert got == sorted(want, key=str) and pii.redact(table).columns == table.columns and pii.redact(table.limit(0)).count() == 0


def test_padding_is_small(spark):
    texts = [(i, passage(i, 20 + i * 37 % 900)) for i in range(400)]
    pieces = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), _tokenizer()).collect()
    assert sum(r["padding"] for r in pieces) <= 0.02 * sum(r["length"] for r in pieces) + 2048


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """Documents with nulls, empties, repeats, copies and columns that clash, and a folder with their labels."""
    folder, pick = str(tmp_path_factory.mktemp("stage")), random.Random(9)
    rows, labels = [], []
    for i in range(260):
        bad, text = i % 6 == 0, passage(i, 60)
        rows.append((i, " ".join(f"{w}###" for w in text.split()) if bad else text, "en" if i % 3 else "de", "a" if i % 2 else "b", None))
        if i < 200:
            labels.append((i, int(not bad), 0))
    rows += [(300, rows[1][1], "en", "a", 3), (301, " ".join([*rows[1][1].split()[:58], "zzz", "yyy"]), None, None, 4), (302, None, "en", "a", None), (303, "", "en", "a", 0), (305, f"{passage(305, 40)} mail a.b@c.de", "en", "a", 9)]
    rows += [rows[7], rows[7], (None, passage(777, 50), "en", "a", None), (304, passage(304, 30_000), "en", "a", None)]
    rows = [(*r, pick.randint(0, 9), "x", 1, True) for r in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, folder, "doc_id long, text string, lang string, source string, n_chars long, component_id long, _slot string, weight int, selected boolean"


def test_stages(spark, staged):
    rows, folder, kind = staged
    docs = spark.createDataFrame(rows, kind)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        if name != "packing":
            assert out.columns == docs.columns
        got = out.collect()
        if name == "quality":
            kept = {r["doc_id"] for r in got}
            assert {302, 303}.isdisjoint(kept) and sum(i % 6 != 0 for i in kept if i is not None and i < 260) >= 200 and sum(i % 6 == 0 for i in kept if i is not None and i < 260) <= 4
        elif name == "near duplicates":
            sets = word_sets([(r[0], r[1]) for r in rows if r[0] is not None])
            labels = components_of(sets, near_pairs(sets))
            have, want = Counter(map(str, map(tuple, got))), Counter(str(r) for r in rows if r[0] is None or labels[r[0]] == r[0])
            assert not have - want and not want - have and labels[300] == labels[301] == 1
        elif name == "personal data":
            assert len(got) == len(rows) and [r["text"][-12:] for r in got if r["doc_id"] == 305] == ["mail [EMAIL]"]
            assert sorted(str(tuple(r)) for r in got if r["doc_id"] != 305) == sorted(str(r) for r in rows if r[0] != 305)
        elif name == "source mix":
            known = Counter(map(str, rows))
            assert Counter(str(tuple(r)) for r in got) <= known and 0 < len(got) < len(rows) and sum(r["doc_id"] == 7 for r in got) in (0, 3)
        else:
            assert len({(r["doc_id"], r["start"]) for r in got}) >= len({r[0] for r in rows}) and all(r["offset"] >= 0 and r["offset"] + r["length"] <= 2048 for r in got)


def test_whole_pipeline(spark, staged):
    rows, folder, kind = staged
    spark.createDataFrame(rows, kind).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    pieces = corpus_pipeline.run(spark, folder).collect()
    ids = {r["doc_id"] for r in pieces}
    assert ids and {300, 301, 302, 303}.isdisjoint(ids)
    by = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
