"""The pipeline's stages, each against a brute-force version, and its whole run on small tables."""

import os
import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from seqweave.llm import mixing, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return (t or "").encode().lower().split()


def shingles(t, n):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with toxic words, copies, benchmark passages, nulls in every column, empty and long texts, repeated rows."""
    rng, top = random.Random(3), tmp_path_factory.mktemp("sf")
    bag = [f"w{k}" for k in range(4000)]
    text = lambda n: " ".join(rng.choices(bag, k=n))
    items = [text(30) for _ in range(4)]
    rows = []
    for k in range(240):
        t = text(rng.randrange(20, 120))
        if k % 6 == 0:
            t += " scumword filthword"
        if k % 20 == 1:
            t = text(40) + " " + items[k % 4] + " " + text(40)
        rows.append((k, t, "en" if k % 5 else None, None if k % 11 == 0 else f"s{k % 4 if k % 3 else 0}"))
    for k in range(1, 60):  # near copies and copies
        t = rows[k][1].split()
        rows.append((1000 + k, " ".join(t if k % 3 == 0 else [*t, "more"] if k % 3 == 1 else t[1:]), "en", "s1"))
    rows += [(2000, None, None, None), (2001, "", "en", "s0"), (2002, text(5000), "en", "s0"), (2003, "Word", "en", "s2"), rows[7], rows[7], (None, items[0], None, None), (None, text(50), "en", "s1"), (None, None, None, None)]
    rows = [(*r, len(r[1]) if r[1] is not None else None) for r in rows]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    labels = [(r[0], 1, int("scumword" in (r[1] or ""))) for r in rows[:240]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top), [tuple(r) for r in rows], items


def brute_near(rows):
    """What near_dedup keeps, but for which of equal rows."""
    sets = [shingles(r[1], 5) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        new = [min(root[j] for j, b in enumerate(sets) if len(a & b) >= 0.8 * len(a | b)) for a in sets]
        if new == root:
            break
        root = new
    groups = defaultdict(list)
    for i, r in enumerate(root):
        groups[r].append(rows[i])
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def test_stages_against_brute_force(spark, folder):
    top, rows, items = folder
    docs = spark.read.parquet(f"{top}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]

    clean = [tuple(r) for r in stages["toxicity"](spark, docs, top).collect()]
    machine = toxicity.learned(docs, spark.read.parquet(f"{top}/labels.parquet"))
    want = [r for r in rows if toxicity.sigmoid(machine.margins([toxicity.terms((r[1] or "").encode())]))[0] < 0.5]
    assert Counter(clean) == Counter(want) and not any("scumword" in (r[1] or "") for r in clean) and len(clean) > 0.8 * len(rows)

    near = [tuple(r) for r in stages["near_dedup"](spark, spark.createDataFrame(clean, DOCS), top).collect()]
    assert Counter(near) == Counter(brute_near(clean))

    left = [tuple(r) for r in stages["decontamination"](spark, spark.createDataFrame(near, DOCS), top).collect()]
    sets = [shingles(t, 5) for t in items]
    assert Counter(left) == Counter(r for r in near if all(len(s & shingles(r[1], 5)) < 0.8 * len(s) for s in sets))

    frame = spark.createDataFrame(left, DOCS)
    mix = [tuple(r) for r in stages["mixing"](spark, frame, top).collect()]
    want = Counter()
    for r in mixing.mixed(frame).collect():
        want[r.doc_id, r.text, r.text] += r.copies
        if r.part:
            want[r.doc_id, r.text, " ".join(r.text.split()[: r.part])] += 1
    whole = {(r[0], r[1]) for r in left}
    got = Counter((r[0], " ".join((r[1] or "").split())) for r in mix)
    assert got == Counter({k: v for k, v in sum((Counter({(d, " ".join((t or "").split())): n}) for (d, _, t), n in want.items()), Counter()).items()})
    assert all((r[0], r[1]) in whole or any(t and t.startswith(r[1]) for d, t in whole if d == r[0]) for r in mix)
    assert all(r[4] == len(r[1]) for r in mix if r[1] is not None)

    out = stages["sharding"](spark, spark.createDataFrame(mix, DOCS), top).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r[0], r[1]) for r in mix)
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in sizes.items())


def test_whole_run(spark, folder):
    top, *_ = folder
    out = corpus_pipeline.run(spark, top)
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns) and out.count() > 100
    assert Counter(map(str, out.collect())) == Counter(map(str, corpus_pipeline.run(spark, top).collect()))


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    clash = spark.createDataFrame([], DOCS + ", shard string, slot string, size string, key string, row string, h string, id string, k1 string, stays string, n string")
    clash.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    full = spark.createDataFrame([(k, f"text {k} of five words or more", "en", "s", 5) for k in range(20)], DOCS)
    full = full.select("*", *[F.lit("clash").alias(c) for c in clash.columns if c not in full.columns])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, full, str(tmp_path))
        assert set(full.columns) <= set(out.columns) or name == "sharding"
        assert out.count() == 20 or name == "near_dedup"


def test_near_dedup_stores_less_than_its_texts(spark, tmp_path, monkeypatch):
    """Sets of shingles take more room than texts of short words; documents that share a passage with the next are not alike."""
    rng, stored = random.Random(11), []
    words = [[f"{rng.randrange(4000):x}" for _ in range(150)] for _ in range(400)]
    texts = [" ".join(a + b[:20] + b[-20:]) for a, b in zip(words, words[1:] + words[:1])]
    plain = simhash.reliable

    def recorded(df):
        out = plain(df)
        place = out.path_.removeprefix("file:")
        stored.append(sum(os.path.getsize(f"{place}/{x}") for x in os.listdir(place) if x.endswith(".parquet") and out.count()))
        return out

    monkeypatch.setattr(simhash, "reliable", recorded)
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOCS).coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "").count() == 400
    assert max(stored) < 0.5 * sum(map(len, texts))


def test_near_dedup_links_by_fingerprints(spark, monkeypatch):
    """Near copies of near fingerprints are settled by these; only the others, one in five here, are left to the exact way."""
    rng, asked = random.Random(12), []
    rows = []
    for k in range(0, 100, 2):
        base = [f"u{rng.randrange(10**6)}" for _ in range(1500)]
        rows += [(k, " ".join(base)), (k + 1, " ".join([*base, "more"] if k % 10 else base[:1250]))]
    plain = simhash.stars
    monkeypatch.setattr(simhash, "stars", lambda pairs, most: asked.append(pairs.count()) or plain(pairs, most))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], DOCS)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(range(0, 100, 2))
    assert len(asked) == 2 and asked[0] >= 30 and asked[0] + asked[1] == 50
