import itertools
import json
import math
import os
import random
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqweave.llm import decontaminate, hmm, html, mixing, sharding, simhash, topk, toolcalls, toxicity, urlfilter
from seqweave.llm.common import discard, reliable

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, g string"


def corpus(spark, n=120, seed=0):
    """Documents with copies, near copies, nulls, empty and long texts, repeated rows, a hot source, and clashing columns."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(3, 60))) for _ in range(n)]
    texts[5] = texts[6] = texts[4]
    texts[7] = texts[8] + " extra"
    texts[9], texts[10], texts[11], texts[12] = None, "", "Word", " ".join(rng.choices(words, k=5000))
    rows = [(k, t, "en", None if k % 11 == 0 else f"s{k % 4 if k % 3 else 0}", len(t or ""), "clash", "clash") for k, t in enumerate(texts)]
    rows += [rows[20], (None, "no id here", None, None, None, None, None)]
    return rows, spark.createDataFrame(rows, DOCS)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def tokens(t):
    return (t or "").encode().lower().split()


def test_bit_slices_against_brute_force():
    rng = np.random.default_rng(1)
    fp = rng.integers(-(2**63), 2**63 - 1, 800)
    for i in range(100, 500):
        fp[i] = int(fp[i % 100]) ^ int(sum(1 << int(k) for k in set(rng.integers(0, 62, rng.integers(0, 14)))))
    g = np.sort(rng.integers(0, 6, len(fp)))
    for r in (0, 2, 12):
        got = {(int(a), int(b), int(d)) for i, j, ds in simhash.linked(fp, g, r) for a, b, d in zip(i, j, ds)}
        want = {(i, j, d) for i in range(len(fp)) for j in range(i + 1, len(fp)) if g[i] == g[j] and (d := int(fp[i] ^ fp[j]).bit_count() if fp[i] ^ fp[j] >= 0 else (int(fp[i] ^ fp[j]) + 2**64).bit_count()) <= r}
        assert got == want


def test_differing_bits_of_signed_longs():
    a, b = np.array([0, 0, -1, 5], np.int64), np.array([-(2**63), -1, 1, 5], np.int64)
    assert simhash.differing(a, b).tolist() == [1, 64, 63, 0]


@pytest.mark.parametrize("tile", [4096, 3])
def test_simhash_classes(spark, tile):
    rows, docs = corpus(spark)

    def fp(t):
        w = tokens(t)
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [(r[0], fp(r[1])) for r in rows]
    root = list(range(len(fps)))
    for _ in fps:
        for i, (_, a) in enumerate(fps):
            root[i] = min(root[j] for j, (_, b) in enumerate(fps) if (a ^ b).bit_count() <= 2)
    comp = {i: min((fps[j][0] for j in range(len(fps)) if root[j] == root[i] and fps[j][0] is not None), default=None) for i in range(len(fps))}
    got = Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_classes(docs, tile=tile).collect())
    assert got == Counter((d, f, comp[i]) for i, (d, f) in enumerate(fps))
    assert simhash.near_classes(empty(spark)).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(2)
    base = [f"v{rng.randrange(900)}" for _ in range(200)]
    near = [w if k not in (50, 150) else "changed" for k, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, " ".join(rng.choices(base, k=200))), (5, None), (6, ""), (None, " ".join(base))]
    got = {r.doc_id: r.keeper for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, None: 1}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_deduplicated(spark):
    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    rows = [(None, a, 2), (None, a, 1), (None, a, 1), (3, b, 1), (3, b, 1), (3, a + " z", 5), (4, None, 1), (None, "", 1), (None, b + " y", 1), (9, "own words here", 1), (9, "other words there", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long")
    for df in (docs, docs.repartition(3)):
        out = simhash.deduplicated(df)
        assert out.columns == docs.columns
        assert Counter(map(tuple, out.collect())) == Counter([(3, b, 1), (3, a + " z", 5), (4, None, 1), (9, "own words here", 1), (9, "other words there", 1)])
    assert simhash.deduplicated(docs.limit(0)).count() == 0


def test_components_of_long_paths(spark):
    n = 3000
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[k], order[k + 1]) for k in range(n - 1)] + [(n + k, n) for k in range(1, 500)], "a long, b long")
    got = {r.v: r.root for r in simhash.connected(edges).collect()}
    assert got == {k: 0 if k < n else n for k in range(n + 500)}


def test_components_of_few_edges_take_one_table(spark, monkeypatch):
    rng, stored, plain = random.Random(3), [], simhash.reliable
    monkeypatch.setattr(simhash, "reliable", lambda df: stored.append(1) or plain(df))
    pairs = [(rng.randrange(-900, 900), rng.randrange(-900, 900)) for _ in range(800)] + [(-(1 << 63), (1 << 63) - 1), (5, 5)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = sorted(map(tuple, simhash.connected(edges).collect()))
    assert len(stored) == 1
    assert got == sorted(map(tuple, simhash.connected(edges, most=0).collect())) and len(got) == len(set(got)) > 900
    assert simhash.connected(edges.limit(0)).count() == 0


def test_near_duplicates_of_contiguous_edits(spark):
    rng = random.Random(7)
    text = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(0, 480, 4):
        base = text(404)
        rows += [(k, base), (k + 1, base[:324]), (k + 2, base + text(98)), (k + 3, base[:44] + text(360))]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id long, text string")
    got = {r.doc_id: r.keeper for r in simhash.near_duplicates(docs).collect()}
    assert got == {k: k if k % 4 == 3 else k - k % 4 for k, _ in rows}


def test_near_duplicates_of_repeated_lines(spark):
    rng = random.Random(8)
    rows = []
    for k in range(0, 120, 2):
        base = [f"u{rng.randrange(10**6)}" for _ in range(300)]
        rows += [(k, " ".join(base)), (k + 1, " ".join(base[:40] * 10 + base))]
    got = {r.doc_id: r.keeper for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k - k % 2 for k, _ in rows}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(9)
    line = [f"c{k}" for k in range(30)]
    texts = []
    for _ in range(60):
        base = [f"u{rng.randrange(3000)}" for _ in range(rng.randrange(1, 120))]
        for _ in range(4):
            cut, more = rng.randrange(len(base) // 4 + 1), rng.randrange(len(base) // 6 + 1)
            texts.append(" ".join(base[cut:] + [f"x{rng.randrange(3000)}" for _ in range(more)] + line * rng.randrange(3)))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    near = [[j for j, b in enumerate(sets) if len(a & b) >= 0.8 * len(a | b)] for a in sets]
    for _ in texts:
        root = [min(root[j] for j in js) for js in near]
    got = {r.doc_id: r.keeper for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root))


def test_decontamination(spark):
    rng = random.Random(4)
    item = " ".join(f"q{rng.randrange(80)}" for _ in range(30))
    long = " ".join(f"x{rng.randrange(500)}" for _ in range(3000))
    w = item.split()
    rows = [(1, long + " " + item.upper() + " " + long), (2, long), (3, None), (4, ""), (5, "tiny item"), (6, " ".join(w[:3] + ["no"] + w[4:])), (7, " ".join(w[:12])), (None, item), (None, long), (None, None), (1, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "tiny item"), (3, None), (4, " ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1): 1.0, (5, 2): 1.0, (6, 1): 22 / 26, (None, 1): 1.0}
    left = decontaminate.clean(docs, items)
    assert Counter(r.doc_id for r in left.collect()) == Counter([2, 3, 4, 7, None, None]) and left.columns == docs.columns
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_decontamination_of_many_items_at_once(spark, monkeypatch):
    """One document with items of several widths, repeated rows, and tables too large to broadcast."""
    rng = random.Random(14)
    items = [" ".join(f"q{rng.randrange(60)}" for _ in range(rng.choice([1, 2, 3, 5, 9, 40]))) for _ in range(40)]
    texts = [" ".join(rng.sample(items, rng.randrange(1, 12))) for _ in range(30)]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate([*texts, texts[0]])] * 2, "doc_id long, text string, own string")
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def cut(t, k):
        w = t.split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = {}
    for d, t in enumerate([*texts, texts[0]]):
        for i, x in enumerate(items):
            k = min(5, len(x.split()))
            s = cut(x, k)
            if len(s & cut(t, k)) >= 0.8 * len(s):
                want[d, i] = (len(s), len(s & cut(t, k)))
    for most in (decontaminate.small.__defaults__[-1], 0):
        monkeypatch.setattr(decontaminate.small, "__defaults__", (None, most))
        got = [((r.doc_id, r.item_id), (r.n_shingles, r.n_shared)) for r in decontaminate.contaminated(docs, table).collect()]
        assert dict(got) == want and len(got) == len(want)


def test_hypergeometric_matrix():
    rows, columns = [30, 0, 70, 11], [40, 41, 30]
    total = np.zeros((4, 3))
    for seed in range(300):
        m = np.array(sharding.communication_matrix(rows, columns, seed))
        assert m.sum(1).tolist() == rows and m.sum(0).tolist() == columns and (m >= 0).all()
        total += m
    assert np.allclose(total / 300, np.outer(rows, columns) / 111, atol=0.8)


def test_sharding(spark):
    rows, docs = corpus(spark)
    out = sharding.sharded(docs).collect()
    sizes = Counter(r.shard for r in out)
    assert len(out) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(8))
    for s in sizes:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    for r in out:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    again = sharding.sharded(docs.repartition(7), hot=1).collect()
    assert Counter((r.doc_id, r.text, r.g, r.shard, r.slot) for r in again) == Counter((r.doc_id, r.text, r.g, r.shard, r.slot) for r in out)
    assert sharding.sharded(empty(spark)).count() == 0
    same = sharding.sharded(spark.createDataFrame([(None, "x", "clash", 7)] * 205, "doc_id long, text string, law string, k long"), hot=30).collect()
    assert Counter(r.shard for r in same) == Counter({s: 26 if s < 5 else 25 for s in range(8)}) and {r.law for r in same} == {"rows"} and len({(r.shard, r.slot) for r in same}) == 205


def test_sharding_deals_uniformly(spark):
    """Over many seeds, each pair of rows, copies too, is in one shard as often as chance has it, and copies are no neighbours."""
    docs = spark.createDataFrame([(k // 4, "t") for k in range(24)], "doc_id long, text string")
    together, beside, seeds = 0, 0, 12
    shard_of = Counter()
    for seed in range(seeds):
        out = sharding.sharded(docs, shards=3, seed=seed).collect()
        for r in out:
            shard_of[r.doc_id, r.shard] += 1
        for i, a in enumerate(out):
            for b in out[:i]:
                if a.doc_id == b.doc_id:
                    together += a.shard == b.shard
                    beside += a.shard == b.shard and abs(a.slot - b.slot) == 1
    pairs = seeds * 36  # of copies
    assert abs(together / pairs - 7 / 23) < 0.08 and abs(beside / pairs - 3 * 7 / (23 * 12)) < 0.06
    assert all(abs(c / (4 * seeds) - 1 / 3) < 0.25 for c in shard_of.values())


def test_mixing(spark):
    rows, docs = corpus(spark)
    out = mixing.mixed(docs).collect()
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(tokens(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, held = {}, set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in held)
        share = sum(weight[s] for s in order if s not in held)
        target = {s: 3 * size[s] if s in held else rest * weight[s] / share for s in order}
        if not (more := {s for s in order if s not in held and target[s] > 3 * size[s]}):
            break
        held |= more
    taken = defaultdict(int)
    for r in out:
        assert r.size == len(tokens(r.text)) and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(out) == len(rows) and all(abs(taken[s] - target[s]) < 1 for s in order)
    copies = mixing.repeated(docs)
    assert copies.columns == docs.columns
    assert sum(len(tokens(r.text)) for r in copies.collect()) == sum(r.taken for r in out)
    assert mixing.mixed(empty(spark)).count() == 0 and mixing.repeated(empty(spark)).count() == 0


@pytest.mark.parametrize("most_bits", [1 << 20, 1])
def test_url_rules(spark, most_bits):
    rng = random.Random(6)
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'www.', 'a.b.', 'notwww.'])}{rng.choice(['example', 'Other'])}.{rng.choice(['com', 'net', 'org'])}{rng.choice(['', '/', '/en/', '/es/1', '/fr/x?y', '#z', '?/en/'])}" for _ in range(200)]
    urls += [None, "", "no scheme/en/", "x://", "http://com/"]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = spark.createDataFrame([*urlfilter.RULES, (None, "/", "allow")], "host string, path string, action string")

    def want(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:end].lower(), rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fit = [(len(h), len(p), h + p, a) for h, p, a in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[2:] if fit else (None, "allow")))

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judged(pages, rules, most_bits=most_bits).collect()}
    assert got == {k: want(u) for k, u in enumerate(urls)}
    assert urlfilter.judged(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urlfilter.judged(pages, rules.limit(0)).collect()} == {"allow"}


def test_levels_hash_anew(spark):
    """A key whose halves agree with a listed one's in their last 20 bits is told from it on some level."""
    yes, no = (spark.createDataFrame([x], "h1 long, h2 long") for x in ((5, 6), (5 + (3 << 20), 6 + (7 << 20))))
    c = urlfilter.cascade(yes, no)
    assert urlfilter.member(c, np.array([5, 5 + (3 << 20)]), np.array([6, 6 + (7 << 20)])).tolist() == [True, False]


def test_keys_of_equal_hashes_leave_the_cascade(spark):
    same = spark.createDataFrame([(5, 6)], "h1 long, h2 long")
    assert urlfilter.cascade(same, same) is None


def test_cascade_is_exact(spark):
    keys = urlfilter.with_halves(spark.range(4000).select(F.col("id").cast("string").alias("key")))
    yes, no = keys.filter("cast(key as int) % 7 = 0").select("h1", "h2"), keys.filter("cast(key as int) % 7 <> 0").select("h1", "h2")
    c = urlfilter.cascade(yes, no)
    both = keys.toPandas()
    assert (urlfilter.member(c, both.h1.to_numpy(), both.h2.to_numpy()) == (both.key.astype(int) % 7 == 0)).all()


def brute_top(rows, k=10, every=100):
    v = [(i, [math.floor(1024 * x) for x in e]) for i, e, *_ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    for q in {i for i, _ in v if i % every == 0}:
        scores = []
        for x in {tuple(e) for i, e in v if i == q}:
            scores += [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y)))), i) for i, y in v if i != q]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(want)


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(0, 0.3, 8)], 0) for k in range(500)]
    rows[3] = (3, rows[100][1], 0)
    rows += [(700, None, 0), (800, [float("nan")] * 8, 0), (900, [None] * 8, 0), (None, rows[0][1], 0), rows[5], rows[5], rows[200], (300, rows[7][1], 0), (1000, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect()) == brute_top(rows)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    huge = [(k, [float(x * 10.0 ** rng.integers(0, 12)) for x in e], 0) for k, e, _ in rows[:200]]
    df = spark.createDataFrame(huge, "vec_id long, embedding array<double>, score int")
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect()) == brute_top(huge)


def test_top_k_prunes_clusters(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (40, 16)) * 4
    rows = [(k, [float(x) for x in centres[k % 40] + rng.normal(0, 0.05, 16)]) for k in range(4000)]
    report = {}
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 7 == 0, report=report)
    assert sorted(tuple(r) for r in out.collect()) == brute_top(rows, every=7)
    assert report["groups"] >= 5 and report["copies"] < 0.6 * report["groups"] * report["vectors"]


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}"


def test_main_text():
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""
    got = html.main_text(page('<nav>menu</nav><div class="ad">buy</div><article><h1>A &amp; B</h1><p>one\n <b>two<br>three</p><aside>side</aside><form>f</form><p>four<section class="comments"><p>spam</p></section></article><footer>end</footer></body>'))
    assert got == "A & B\n\none two three\n\nfour"
    assert html.main_text(page('<div class="page has-x"><div id="sidebar">s</div><p>text &copy 1</p></div><div class="ad')) == "text © 1"
    kept = html.main_text(page('<div class="layout no-sidebar"><article class="post social-science"><h2 id="related-work">R</h2><h2 id="search">S</h2><p class="notice">N</p><b class="nav">x</b> <b>y</b> <b>z</b> <b>w</b></article></div>'))
    assert kept == "R\n\nS\n\nN\n\nx y z w"
    assert html.main_text(page("<main><h1>Title</h1><article><p>one</p></article><p>two</p><ul class='comment-list'><li>spam</li></ul></main>")) == "Title\n\none\n\ntwo"


def test_alignment_against_brute_force():
    rng = random.Random(11)

    def tree(depth):
        out = [rng.choice("abc"), 0, 1]
        for _ in range(rng.randrange(5)):
            out.append(rng.choice("xyz") if depth == 0 or rng.random() < 0.3 else tree(depth - 1))
        return out

    def best(a, b):
        """The most nodes that order-preserving pairs of like nodes give, by trying all."""
        if not isinstance(a, list) or not isinstance(b, list):
            return 0 if isinstance(a, list) or isinstance(b, list) else 2 if a == b else 1
        if a[0] != b[0]:
            return 0

        def rest(i, j):
            if i == len(a) or j == len(b):
                return 0
            return max(rest(i + 1, j), rest(i, j + 1), best(a[i], b[j]) + rest(i + 1, j + 1))

        return 1 + rest(3, 3)

    for _ in range(200):
        a, b = tree(2), tree(2)
        assert html.Aligner().weight(a, b) == best(a, b)
    assert html.rising([(0, 5), (1, 1), (2, 2), (3, 0), (4, 3)]) == [(1, 1), (2, 2), (4, 3)]


def long_page(k, n, kind):
    return page("<div>a menu of this site</div>" + "".join(f"<{kind}>t{k} {j} words</{kind}>" + ("<hr>" if kind == "div" else "") for j in range(n)) + "<div>end of page</div>")


@pytest.mark.parametrize("kind", ["p", "div"])
def test_long_pages(kind):
    pages = [long_page(k, n, kind) for k, n in enumerate((10_000, 9_000, 11_000))]
    began = time.time()
    wrapper = html.induced(pages)
    got = html.main_text(pages[1], wrapper)
    assert time.time() - began < 20
    assert got == "\n\n".join(f"t1 {j} words" for j in range(9_000))
    assert "words" in html.main_text("<div>" * 5000 + "words" + "</div>" * 5000)


def test_wrapper_induction(spark):
    menu = "<div>" + " ".join(f"Section {k} of our site" for k in range(60)) + "</div>"
    rows = [(k, f"http://h.org/{k}", page(f"<div>{menu}<div><p>Story {k} {'abc ' * k}</p><p>Shared notice</p><p>More of {k}</p></div><div>All rights reserved</div></div>")) for k in range(9)]
    copies = [(20 + k, f"http://copies.org/{k}", page(f"<article><p>The same words on every page of it</p></article><div>{k}</div>")) for k in range(5)]
    rows += [(10, "http://one.org/", page("<p>alone</p>")), (11, None, None), (12, None, page("<p>no url</p>")), rows[0], *copies]
    got = {r.page_id: r.text for r in html.extracted(spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, host string, wrapper string")).collect()}
    assert got[11] == "" and got[10] == "alone" and got[12] == "no url"
    assert all(got[k] == f"Story {k} {'abc ' * k}".strip() + f"\n\nMore of {k}" for k in range(9))
    assert all(got[20 + k] == "The same words on every page of it" for k in range(5))
    assert html.extracted(empty(spark, "page_id long, url string, html string")).count() == 0


def test_wrapper_induction_without_marks(spark):
    """Pages whose article, menu, advert and footer are plain divs give the same texts as those that are marked."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("page_id % 3 = 0")
    plain = F.regexp_replace(F.regexp_replace("html", r"<(/?)(article|nav|footer)\b[^>]*>", "<$1div>"), '<div class="ad">', "<div>")
    marked = {r.page_id: r.text for r in html.extracted(pages).collect()}
    got = {r.page_id: r.text for r in html.extracted(pages.withColumn("html", plain)).collect()}
    assert sum(got[k] == t for k, t in marked.items()) >= 0.99 * len(marked) and all(marked.values())


MESSAGES = "conv_id long, turn long, role string, text string, tool_calls string, tool_call_id string, status string"


def test_tool_calls(spark):
    def call(i, args, after=(), name="answer"):
        return json.dumps([{"id": i, "name": name, "arguments": args, "after": list(after)}])

    good = '{"turn": 1, "question": "b\\"q"}'
    rows = [
        (1, 0, "assistant", "", call("a", good, ["b", "nowhere"]), None), (1, 2, "assistant", "", call("b", good), None), (1, 3, "tool", "res", None, "a"), (1, 4, "tool", "later", None, "a"),
        (1, 5, "tool", "lost", None, "zz"), (1, 6, "assistant", "", call("a", good), None), (1, 7, "user", "hi", None, None), (1, 8, "user", "hi", "[{", None), (1, 9, "user", "hi", "[{}, {}]", None), (1, 10, "user", "", "[1]", None),
        (2, 0, "assistant", "", call("a", '{"turn": "1", "question": "x"}'), None), (2, 1, "assistant", "", call("c", good, name="nope"), None), (2, 2, "assistant", "", call("d", "not json"), None),
        (3, 0, "assistant", None, call("a", good, ["b"]), None), (3, 0, "assistant", None, call("b", good, ["a"]), None), (None, 0, "assistant", "", call("a", good), None), (4, None, "x", "y", None, "a"),
        (5, 0, None, None, None, None), (5, 0, None, None, None, None), (6, 0, "assistant", "", call("a", json.dumps({"text": "x " * 50_000, "to": "en"}), name="translate"), None),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], MESSAGES)
    out = toolcalls.linked(df).collect()
    got = Counter((r.conv_id, r.call_id, r.status) for r in out)
    assert got == Counter({
        (1, "a", "ok"): 1, (1, "b", "no_result"): 1, (1, "a", "repeated_result"): 1, (1, "zz", "orphan_result"): 1, (1, "a", "repeated_call"): 1, (1, None, "text"): 2, (1, None, "malformed"): 2,
        (1, None, "no_id"): 2, (2, "a", "invalid"): 1, (2, "c", "unknown_tool"): 1, (2, "d", "invalid"): 1, (3, "a", "cyclic"): 1, (3, "b", "cyclic"): 1, (None, None, "unplaced"): 1, (4, None, "unplaced"): 1,
        (5, None, "text"): 2, (6, "a", "no_result"): 1,
    })
    ok = {(r.conv_id, r.call_id): r for r in out if r.status in ("ok", "no_result")}
    assert (ok[1, "a"].place, ok[1, "a"].level) == (2, 1) and (ok[1, "b"].place, ok[1, "b"].level) == (2, 0)
    assert ok[1, "a"].json == '{"arguments":{"question":"b\\"q","turn":1},"id":"a","name":"answer","result":"res"}'
    assert toolcalls.linked(df.limit(0)).count() == 0


def made(rows):
    return [(c, t, "assistant", "", json.dumps([{"id": i, "name": "answer", "arguments": "{}", "after": after} for i, after in calls]), None, None) for c, t, calls in rows]


@pytest.mark.parametrize("local", [toolcalls.LOCAL, 0])
def test_tool_calls_in_long_chains(spark, local):
    n = 1000
    rows = [(1, t, [(f"k{t}", [f"k{t + 1}"])]) for t in range(n)] + [(2, 0, [(f"k{k}", [f"k{k + 1}"]) for k in range(n)])]
    got = {(r.conv_id, r.call_id): (r.place, r.level) for r in toolcalls.linked(spark.createDataFrame(made(rows), MESSAGES), local=local).collect()}
    assert got == {(1, f"k{k}"): (n - 1, n - 1 - k) for k in range(n)} | {(2, f"k{k}"): (0, n - 1 - k) for k in range(n)}


@pytest.mark.parametrize("local", [toolcalls.LOCAL, 0])
def test_tool_calls_against_brute_force(spark, local):
    rng, rows, want = random.Random(5), [], {}
    for c in range(30):
        turn = {f"c{k}": rng.randrange(6) for k in range(rng.randrange(2, 14))}
        after = {i: rng.sample(list(turn), rng.choice([0, 1, 1, 2, 3]) % (len(turn) + 1)) for i in turn}
        if c % 2:  # no cycles
            after = {i: [j for j in js if j > i] for i, js in after.items()}
        rows += [(c, t, [(i, after[i])]) for i, t in turn.items()]
        key = {}
        while new := {i: max([(turn[i], 0), *((key[j][0], key[j][1] + 1) for j in after[i])]) for i in turn if i not in key and all(j in key for j in after[i])}:
            key |= new
        want |= {(c, i): (*key.get(i, (turn[i], None)), i not in key) for i in turn}
    got = {(r.conv_id, r.call_id): (r.place, r.level, r.status == "cyclic") for r in toolcalls.linked(spark.createDataFrame(made(rows), MESSAGES), local=local).collect()}
    assert got == want


def test_toxicity_learns_pairs():
    rng = random.Random(1)
    bag = [f"w{k}" for k in range(200)]
    texts, y = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(rng.choices(bag, k=20) + ["insultx"] * a + ["groupy"] * b))
        y.append(float(a and b))
    m = toxicity.fit([toxicity.terms(t.encode()) for t in texts[:1000]], np.array(y[:1000]))
    hit = (toxicity.sigmoid(m.margins([toxicity.terms(t.encode()) for t in texts[1000:]])) >= 0.5) == np.array(y[1000:])
    assert hit.mean() > 0.95


def test_toxicity_against_pairwise_sums():
    rng = np.random.default_rng(2)
    index = np.full(toxicity.BUCKETS, -1)
    index[rng.choice(toxicity.BUCKETS, 40, replace=False)] = np.arange(40)
    m = toxicity.Machine(index, -0.7, rng.normal(0, 1, 40), rng.normal(0, 1, (40, 4)))
    own = np.flatnonzero(index >= 0)
    buckets = [np.sort(rng.choice(own, n, replace=False)) for n in (0, 1, 2, 7, 40)] + [np.array([int(np.flatnonzero(index < 0)[0])])]
    want = []
    for b in buckets:
        f = [k for k in index[b] if k >= 0]
        want.append(-0.7 + sum(m.w[k] for k in f) + sum(m.v[i] @ m.v[j] for i, j in itertools.combinations(f, 2)))
    assert np.allclose(m.margins(buckets), want)


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.scored(docs, toxicity.learned(docs, labels)).filter("held_out").join(labels, "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n[1, 0]) and n.get((0, 1), 0) <= 0.002 * n[0, 0]


def test_toxicity_keeps_its_sample_in_few_files(spark, monkeypatch):
    """However many partitions a shuffle has: a file takes three processes on a local disk, and the sample is bounded."""
    files, plain = [], toxicity.reliable
    monkeypatch.setattr(toxicity, "reliable", lambda df: files.append(len((out := plain(df)).inputFiles())) or out)
    monkeypatch.setattr(toxicity, "discard", lambda *_: None)
    docs = spark.createDataFrame([(k, f"word{k % 7} bad{k % 2}") for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int")
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        machine = toxicity.learned(docs, labels)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) == 1 and files[0] <= 2 * spark.sparkContext.defaultParallelism
    assert [r.predicted for r in toxicity.scored(docs, machine).orderBy("doc_id").collect()] == [k % 2 for k in range(300)]


def test_toxicity_fits_in_little_memory(monkeypatch):
    """The driver fits the machine, so a step's sums are made of a part of the documents at a time."""
    rng = np.random.default_rng(4)
    y = (rng.random(20_000) < 0.3).astype(float)
    index = np.full(toxicity.BUCKETS, -1)
    index[:400] = np.arange(400)
    features = [np.sort(rng.choice(200 + 200 * int(t), int(k), replace=False)).astype(np.int32) for t, k in zip(y, rng.integers(0, 160, len(y)))]
    features[0] = features[-1] = np.zeros(0, np.int32)
    monkeypatch.setattr(toxicity, "STEPS", 3)
    tracemalloc.start()
    m = toxicity.fitted(features, y, index)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # 1.6 million entries; sums over all of them at once took 50 MB
    for size in (1 << 30, 5000):
        monkeypatch.setattr(toxicity, "FIT_AT_ONCE", size)
        other = toxicity.fitted(features, y, index)
        assert np.allclose([m.bias, *m.w, *m.v.ravel()], [other.bias, *other.w, *other.v.ravel()], rtol=0, atol=1e-9)


def test_tables_between_steps_have_no_mark_of_success(spark):
    df = reliable(spark.range(100).repartition(3))
    path = df.path_.removeprefix("file:")
    assert df.count() == 100 and not [x for x in os.listdir(path) if "_SUCCESS" in x]
    discard(df)
    assert not os.path.exists(path)


def test_toxicity(spark):
    rows, docs = corpus(spark, 200)
    rows = [(k, (t or "") + " scum" if k and k % 9 == 0 else t, *r) for k, t, *r in rows]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(r[0], int(r[0] % 9 == 0 and r[0] > 0)) for r in rows if r[0] is not None and r[0] % 2 == 0], "doc_id long, toxic int")
    out = toxicity.scored(docs, toxicity.learned(docs, labels)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    wrong = [r.doc_id for r in out if r.doc_id and r.predicted != (r.doc_id % 9 == 0)]
    assert len(wrong) <= 2
    assert toxicity.clean(docs, labels).columns == docs.columns
    assert toxicity.scored(empty(spark), toxicity.learned(empty(spark), labels)).count() == 0


def test_hmm_against_brute_force(spark):
    rows, docs = corpus(spark)
    counts, least, voc, model = hmm.fitted(hmm.training(docs), head=40, symbols=20, states=3)
    out = hmm.scored(docs, counts, least, voc, model).collect()
    c = Counter()
    for d, t, *_ in rows:
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            c.update([*tokens(t), b""])
    n, v = sum(c.values()), len(c)
    ids = {w: k for k, w in enumerate(voc.words.split())}
    text = {d: t for d, t, *_ in rows}
    for r in out:
        w = tokens(text[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(c[x] > 0 for x in [*w, b""]), n)
        assert abs(r.base_score - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, b""])) < 1e-6
        syms = [ids[x] if ids.get(x, 99) < 20 else 20 for x in w] + [21]
        a, log = model.start * model.emit[syms[0]], 0.0
        for k, s in enumerate(syms):
            a = a if k == 0 else (a @ model.move) * model.emit[s]
            log += math.log10(a.sum())
            a = a / a.sum()
        log += sum(math.log10((c[x] + 1) / (voc.rest_n + voc.rest_v + 1)) for x, s in zip(w, syms) if s == 20)
        assert abs(r.score - log) < 1e-6
    assert np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1)
    rare = sum(c.values()) - c[b""] - sum(voc.counts[:20])
    assert (voc.rest_n, voc.rest_v) == (rare, v - 1 - 20)
    assert hmm.scored(empty(spark), *hmm.fitted(hmm.training(empty(spark)))).count() == 0


def test_baum_welch_raises_the_likelihood(spark):
    _, docs = corpus(spark)
    sums = []
    for rounds in (0, 1, 3):
        fit = hmm.fitted(docs, head=300, symbols=250, states=3, rounds=rounds)
        sums.append(hmm.scored(docs, *fit).agg(F.sum("score")).first()[0])
    assert sums == sorted(sums)


def test_expected_counts_of_long_texts():
    """In segments, side by side with others, and by sums over all paths, the counts are the same."""
    rng = np.random.default_rng(6)
    part = lambda *n: (x := rng.random(n) + 0.1) / x.sum(-1, keepdims=True)
    m = hmm.Model(part(3), part(3, 3), part(3, 7).T.copy())
    seqs = [rng.integers(0, 7, n).astype(np.int32) for n in (41, 1, 2, 10, 20)]
    for s in seqs:
        alone = hmm.Batch([s]).expected(m, 7)
        for piece in (1, 3, 7, 10, 100):
            for a, b in zip(alone, hmm.expected_of_long(s, m, 7, piece)):
                assert np.allclose(a, b)
    together = hmm.Batch(seqs).expected(m, 7)
    for a, b in zip(together, (sum(x) for x in zip(*(hmm.expected_of_long(s, m, 7, 6) for s in seqs)))):
        assert np.allclose(a, b)
    s = seqs[3][:5]
    total, starts, moves, emitted = 0.0, np.zeros(3), np.zeros((3, 3)), np.zeros((7, 3))
    for path in itertools.product(range(3), repeat=5):
        p = m.start[path[0]] * np.prod([m.emit[x, k] for x, k in zip(s, path)]) * np.prod([m.move[a, b] for a, b in zip(path, path[1:])])
        total += p
        starts[path[0]] += p
        for a, b in zip(path, path[1:]):
            moves[a, b] += p
        for x, k in zip(s, path):
            emitted[x, k] += p
    for a, b in zip((starts, moves, emitted), hmm.expected_of_long(s, m, 7, 2)):
        assert np.allclose(a / total, b)


def test_start_is_of_whole_documents(spark):
    """Kinds of documents that differ only behind a long common beginning, one of them rare, get states of their own."""
    rng = random.Random(3)
    same = " ".join(f"s{k % 40}" for k in range(900))
    rows = [(k, same + " " + " ".join(f"{'ab'[k % 50 == 0]}{rng.randrange(30)}" for _ in range(600))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    *_, voc, model = hmm.fitted(docs, head=200, symbols=150, states=2, rounds=1)
    ids = {w: k for k, w in enumerate(voc.words.split())}
    weight = {c: sum(model.emit[ids[f"{c}{k}".encode()]] for k in range(30)) for c in "ab"}
    assert max(weight["b"]) > 5 * min(weight["b"])
