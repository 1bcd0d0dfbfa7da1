"""URL rules, packing, sharding, quality, top-k, HTML and the differencing against brute force, round trips and held-out accuracy."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from celestrum.llm import bytewords as bw
from celestrum.llm import differencing, html_text, packing, quality, registry, sharding, shared, topk, url_rules
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], SF)


# URL rules


def brute_rule(host, path, rules):
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[2:] if fit else (None, "allow")


def test_url_rules(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "ROWS_PER_SWEEP", 7)
    rng = random.Random(4)
    hosts = ["org", "a.org", "b.a.org", "xa.org", "com", "c.com", "", "a", "é.com", "a..org"]
    paths = ["", "/", "/x", "/x/", "/x/y", "/x/yz", "/xé", "/\uffff", "/x/y/z" * 50]
    rules = {(rng.choice(hosts[:-1]), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(40)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [(k, rng.choice(hosts), rng.choice(paths), "old") for k in range(300)] + [(900, None, None, "old"), (900, None, None, "old")]
    df = spark.createDataFrame(urls, "page_id long, host string, path string, rule string")
    table = spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")
    got = url_rules.apply_rules(df, table).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r["rule"], r["verdict"]) == brute_rule(r["host"] or "", r["path"] or "", rules), r
    assert {r["verdict"] for r in url_rules.apply_rules(df, table.limit(0), "block").collect()} == {"block"}
    assert url_rules.apply_rules(df.limit(0), table).count() == 0


def test_url_rules_of_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a.org", "/x", 5, 6, 7), (2, "b", "", 8, 9, 10)], "_key long, host string, path string, _h long, _p long, _won long")
    rules = spark.createDataFrame([("org", "/", "block")], "host string, path string, verdict string")
    got = sorted(tuple(r) for r in url_rules.apply_rules(df, rules).collect())
    assert got == [(1, "a.org", "/x", 5, 6, 7, "org/", "block"), (2, "b", "", 8, 9, 10, None, "allow")]


def test_sweeps_of_a_host_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "ROWS_PER_SWEEP", 500)
    urls = spark.range(12_000).select(F.concat(F.lit("h"), "id", F.lit(".com")).alias("host"), F.concat(F.lit("/fr/"), "id").alias("path"))
    rules = spark.createDataFrame([("com", "/fr/", "allow"), ("com", "/de/", "block")], "host string, path string, verdict string")
    got = url_rules.apply_rules(urls, rules)
    assert got.where("rule = 'com/fr/'").count() == 12_000
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("Window") :]
    assert "_key" in window and "hashpartitioning(_key" in window
    exchange = window[window.index("Exchange hashpartitioning") :].splitlines()[0]
    assert "_key" in exchange and "_salt" in exchange, exchange


def test_url_parts(spark):
    urls = ["HTTP://EXAMPLE.Org/A?b#c", "x", None, "a://b", "a://b?c/d", "s://h#f://g/", "\n://Ü.com\n/p\nq", "http://"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url")))
    assert [tuple(r) for r in df.collect()] == [("example.org", "/A"), ("", ""), ("", ""), ("b", ""), ("b", ""), ("h", ""), ("Ü.com\n", "/p\nq"), ("", "")]


def test_url_rules_are_native(spark):
    plan = registry.QUERIES["op1_url_filter"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# Differencing, packing, sharding


def test_differencing_is_the_textbooks():
    assert sorted(np.bincount(differencing.difference([8, 7, 6, 5, 4], 2), weights=[8, 7, 6, 5, 4])) == [14, 16]
    assert sorted(np.bincount(differencing.difference([5, 5, 5, 4, 4, 3, 3, 1], 3), weights=[5, 5, 5, 4, 4, 3, 3, 1])) in ([9, 10, 11], [10, 10, 10])
    assert len(differencing.difference([], 3)) == 0 and differencing.difference([4], 3).tolist() == [0]
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1000, 500)
    sums = np.bincount(differencing.difference(sizes, 40), weights=sizes, minlength=40)
    assert sums.max() - sums.min() < 0.005 * sums.mean()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    word = lambda: rng.choice(["over", "the", " ", "it's", "x1", "日本", "\n", "naïve,", "!?", "\t", "I'LL", "12.5"])
    long = " ".join(f"word{k % 977}" for k in range(30000))
    return [None, "", " ", "a  b", "<|endoftext|> x", long, "same text", "same text"] + [" ".join(word() for _ in range(rng.randrange(400))) for _ in range(60)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(k, t, 5, "clash") for k, t in enumerate(texts)], "doc_id long, text string, size int, start string").repartition(3)


def test_encoder_equals_the_tokenizer(texts):
    enc = packing.Encoder(packing.default_tokenizer())
    for part in bw.slices(pa.array(texts), limit=3000):
        ids, bounds = enc.encode(part)
        for k in range(len(part)):
            want = enc.tokenizer.encode(texts[part.first + k] or "", add_special_tokens=False).ids
            assert ids[bounds[k] : bounds[k + 1]].tolist() == want


def test_encoder_at_white_space():
    enc = packing.Encoder(packing.default_tokenizer())
    rng = random.Random(12)
    parts = ["\n", "\n", " ", " ", "\t", "\r", "\x0b", "\x1c", "\x85", "\u00a0", "\u2028", "\u3000", "a", "b's", ".", "1", "\u00e9", "\u2019", "\u65e5"]
    texts = ["a\n\nb", "a\n\n\n\nb", "a\n", "", "\n\n", "\nb", "a \n b", "a  \n  b", "  a", "a\n \n"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(4000)]
    texts += ["".join(rng.choice(["\n", " ", "a", "}"]) for _ in range(30)) for _ in range(1000)]
    for part in bw.slices(pa.array(texts), limit=3000):
        ids, bounds = enc.encode(part)
        for k in range(len(part)):
            t = texts[part.first + k]
            assert ids[bounds[k] : bounds[k + 1]].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_packing_is_a_round_trip(spark, texts, docs):
    packed = packing.pack(docs, packing.default_tokenizer())
    rows = packed.collect()
    enc = packing.encoder(packing.default_tokenizer())
    for k, t in enumerate(texts):
        own = sorted((r["start"], r["ids"]) for r in rows if r["doc_id"] == k)
        ids = [i for _, part in own for i in part]
        assert ids == [*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert [s for s, _ in own] == np.cumsum([0] + [len(p) for _, p in own])[:-1].tolist()
    for r in rows:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    p = packing.padding(packed).first()
    assert p["padded"] < 0.05 * p["tokens"] + 4 * 1024
    assert packing.pack(docs.limit(0), packing.default_tokenizer()).count() == 0


@pytest.mark.parametrize(("groups_per_task", "fan"), [(20_000, 500), (9, 3), (2, 2)])
def test_sharding(spark, texts, docs, groups_per_task, fan):
    rows = sharding.assign(docs, 7, groups_per_task=groups_per_task, fan=fan).collect()
    assert len(rows) == len(texts)
    size = {k: len((t or "").encode()) + 16 for k, t in enumerate(texts)}
    of_text = {}
    for r in rows:
        assert r["size"] == size[r["doc_id"]]
        assert of_text.setdefault(r["text"] or "", r["shard"]) == r["shard"]
    for s in range(7):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    sums = np.bincount([r["shard"] for r in rows if r["doc_id"] != 5], weights=[r["size"] for r in rows if r["doc_id"] != 5], minlength=7)
    others = np.sort(sums)[1:]  # the long text has a shard alone
    assert others.max() - others.min() < 0.25 * others.max()
    assert sharding.assign(docs.limit(0)).count() == 0


def test_one_task_shards_as_differencing_over_all_groups(spark, texts, docs):
    rows = sharding.assign(docs, 7).collect()
    groups = {}
    for t in texts:
        groups[t or ""] = groups.get(t or "", 0) + len((t or "").encode()) + 16
    sizes = list(groups.values())
    want = np.bincount(differencing.difference(sizes, 7), weights=sizes, minlength=7)
    got = np.bincount([r["shard"] for r in rows], weights=[r["size"] for r in rows], minlength=7)
    assert sorted(want) == sorted(got)


def test_a_tree_of_partial_partitions_is_differencing_of_them(spark):
    """Each step against the textbook on its nodes, and the whole nearly as even as one step."""
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 5000, 3000)
    groups = spark.createDataFrame([(f"{k:05d}", int(s)) for k, s in enumerate(sizes)], "group string, bytes long")
    got = sharding.shards_of(groups, 10, groups_per_task=100, fan=4).toPandas()
    assert len(got) == 3000 and got.group.is_unique
    sums = np.bincount(got.shard, weights=sizes[got.group.astype(int)], minlength=10)
    assert sums.max() - sums.min() < 0.001 * sums.mean()


def test_sharding_of_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a", 7, 8, 9), (2, "a", 7, 8, 9), (None, None, 1, 2, 3), (None, None, 1, 2, 3)], "doc_id long, text string, _group long, _bucket long, _k long")
    got = sorted(sharding.assign(rows, 2).collect(), key=repr)
    assert [(r["doc_id"], r["_group"], r["_bucket"], r["_k"]) for r in got] == [(1, 7, 8, 9), (2, 7, 8, 9), (None, 1, 2, 3), (None, 1, 2, 3)]
    assert {(r["shard"], r["slot"]) for r in got} == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_shards_of_many_documents_are_nearly_equal(spark):
    d = registry.QUERIES["op6_sharding"](spark, "/root/testdata/sf0.01").toPandas()
    sums = d.groupby("shard")["size"].sum()
    assert len(sums) == 40 and sums.max() - sums.min() < 0.02 * sums.mean()


# Quality


def test_quality_tells_junk_from_prose(spark):
    d = registry.QUERIES["op7_quality"](spark, "/root/testdata/sf0.01").toPandas()
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    m = d.merge(known, on="doc_id")
    m = m[m.held_out]
    assert len(m) > 80 and (m.predicted == m.quality).mean() > 0.95 and d.score.between(0, 1).all()


def test_scores_are_those_of_the_features_one_by_one(spark, docs, texts):
    rng = np.random.default_rng(5)
    model = rng.standard_normal(1 << quality.BUCKET_BITS).astype(np.float32)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs.unionByName(docs.limit(3)), model).collect()}
    for k, t in enumerate(texts):
        data, found = (t or "").encode(), [0]
        words = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
        for j, w in enumerate(words):
            found.append(int(bw.words(next(bw.slices(pa.array([w.decode()]))), bw.SPACED, fold=False).hashes[0]) >> (64 - quality.BUCKET_BITS))
            found.append(1 if j and words[j - 1] == w else 2)
        for n in (3, 4):
            found += [((int.from_bytes(data[j : j + n], "little") + n) * 2654435761 % (1 << 32)) >> (32 - quality.BUCKET_BITS) for j in range(len(data) - n + 1)]
        mean = float(np.mean(model[found].astype(np.float64)))
        assert got[k] == pytest.approx(1 / (1 + math.exp(-mean)), abs=1e-6)


def test_a_fitted_model_falls_in_loss():
    texts = ["good words here now", "bad bad bad bad", "fine text of words", "junk junk junk"] * 20
    labels = [1, 0, 1, 0] * 20
    model = quality.fit(texts, labels)
    scores = np.concatenate([b.column("score").to_numpy() for b in quality._score(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts)})]), model, ["text"])])
    assert ((scores >= 0.5) == np.array(labels)).all()


def test_a_sample_has_the_least_hashes(spark):
    rows = spark.range(5000).select((F.col("id") % 2500).alias("k"))
    got = [r["k"] for r in shared.sample(rows, 100, "k").collect()]
    want = [r["k"] for r in rows.distinct().orderBy(F.shiftrightunsigned(F.xxhash64("k"), 1)).limit(100).collect()]
    assert len(got) == 100 and got == want and shared.sample(rows, 9000, "k").count() == 2500


def test_packing_of_null_ids(spark):
    rows = spark.createDataFrame([(None, "some text"), (None, "some text"), (3, None)], "doc_id long, text string")
    got = packing.pack(rows, packing.default_tokenizer()).collect()
    assert sorted((r["doc_id"] is None, r["length"]) for r in got) == [(False, 1), (True, 3), (True, 3)]


def test_quality_of_odd_tables(spark, docs):
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (6, 1), (7, 1), (9, 3)], "doc_id long, quality int")
    model = quality.learn(docs, labels)  # one class alone
    assert {r["score"] for r in quality.score(docs, model).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0 and not quality.learn(docs, labels.limit(0)).any()


def test_quality_sample_goes_on_after_a_long_text(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(quality, "fit", lambda texts, labels: taken.append(sorted(zip(texts, labels, strict=True))))
    order = [r[0] for r in spark.range(6).orderBy(F.xxhash64("id")).collect()]
    text = {k: "x" * (1000 if n in (0, 3) else 10 + n) for n, k in enumerate(order)}
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, quality int")
    quality.learn(docs, labels, sample_bytes=100)
    assert taken == [sorted((text[k], k % 2) for n, k in enumerate(order) if n not in (0, 3))]
    quality.learn(docs, labels)
    assert len(taken[1]) == 6
    with pytest.raises(ValueError, match="labelled"):
        quality.learn(docs, labels, sample_bytes=5)


# Top-k


@pytest.mark.parametrize(("query_block", "wave"), [(2048, 256), (3, 2)])
def test_top_k_is_exact(spark, query_block, wave):
    rng = np.random.default_rng(2)
    v = (rng.standard_normal((400, 24)) * rng.uniform(0.2, 2, (400, 1))).astype(np.float32)
    v[100:140] = v[60:100]
    rows = [(k, v[k].tolist(), 1) for k in range(400)] + [(500, None, 1), (550, [1.0, None], 1), (600, [float("nan")] * 24, 1), (650, [float("inf")] * 24, 1), (None, [1.0] * 24, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(5)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(df, F.col("vec_id") % 50 == 0, query_block=query_block, wave=wave).collect())
    whole = np.floor(256 * v.astype(np.float64))
    want = []
    for q in range(0, 400, 50):
        s = whole @ whole[q]
        order = [k for k in np.lexsort((np.arange(400), -s)) if k != q][:5]
        want += [(q, n + 1, k, int(s[k])) for n, k in enumerate(order)]
    assert got == sorted(want)
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (3, [1.0]), (3, [1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(few, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [(0, 1, 3, 65536), (0, 2, 3, 65536)]


def test_bounds_hold_and_rule_rows_out():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((8, 16)) * 200
    v = np.floor(centres[rng.integers(0, 8, 4000)] + rng.standard_normal((4000, 16)) * 5)
    p = topk.choose_pivots(v[:500], 16)
    rows = topk.Candidates(np.arange(4000), v, p)
    queries, own = v[:40], np.arange(40)
    bound = rows.bounds(queries, topk.distances(queries, p))
    for b in range(len(rows.first)):
        assert (queries @ rows.vectors[rows.first[b] : rows.last[b]].T <= bound[:, b : b + 1]).all()
    best = topk.Best(40, 5)
    done = topk.evaluate(best, own, queries, topk.distances(queries, p), rows)
    assert done < 0.3 * 40 * 4000
    scores = queries @ v.T
    scores[own, own] = -np.inf
    for q in range(40):
        want = np.lexsort((np.arange(4000), -scores[q]))[:5]
        assert best.ids[q].tolist() == want.tolist() and best.scores[q].tolist() == scores[q][want].tolist()


def test_share_of_products_computed(spark):
    """How much the pivots spare on the table's vectors, which are hardly clustered."""
    counter = spark.sparkContext.accumulator(0)
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    n = topk.search(vectors, F.col("vec_id") % 50 == 0, counter=counter).count()
    total = vectors.count() * n / 5
    print(f"products computed: {counter.value / total:.2f} of all")
    assert 0 < counter.value <= total * 1.01


# HTML


def test_minimum_cut_is_the_cheapest_labelling():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randrange(1, 9)
        costs = [rng.uniform(-1, 1) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 0.8)) for _ in range(12)]

        def price(label, costs=costs, edges=edges):
            return sum(max(c, 0) if not x else max(-c, 0) for c, x in zip(costs, label, strict=True)) + sum(w for a, b, w in edges if label[a] != label[b])

        got = html_text.minimum_cut(costs, edges)
        assert price(got) == pytest.approx(min(price([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n)))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:"</p>"}</style><script>if (a<b) {"</p>"}</script></head><body>
<header><h1>Site name</h1><p>Best site of all sites. Really.</p></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies. Please agree to all of them.</div><div class="sidebar"><p>Popular things. Very popular things indeed.</p></div>
<article><h1>A &amp; B</h1><p>First   <b>bold</b>&nbsp;words<!-- no --> here.<p>Second &lt;one&gt; &#233;<br>next line.</p><form><label>Mail</label><input></form><ul><li>point one<li>point two</ul>
<div class="ad-box">Buy now! It is cheap.</div><p>Les.</p></article><section id="comments"><p>I like it. Thanks for this long article.</p></section><footer>&copy; us</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "A & B\nFirst bold words here.\nSecond <one> é next line.\npoint one\npoint two\nLes."
    assert html_text.main_text(PAGE[:900]).startswith("A & B\nFirst bold words here.")
    for odd in (None, "", "<", "<p", "&#xD800;<p>", "<div class='" + "a" * 100000, "</p></p>", "<" * 2000, '<a b="' * 500):
        assert isinstance(html_text.main_text(odd), str)
    assert html_text.main_text("<p>Only some words.</p><p>And more of them.</p>") == "Only some words.\nAnd more of them."


def paragraphs(*texts, tag="p"):
    return "".join(f"<{tag}>{t}</{tag}>" for t in texts)


PROSE = ("The river rose for three days. Nobody had seen it so high.", "Short one.", "By the fourth morning the bridge was gone, and so was the mill.", "It rained on.")


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<body><div class="page has-sidebar">%s</div></body>', PROSE),
        ('<body><div class="with-comments no-sidebar"><h1>Flood</h1>%s</div></body>', ("Flood", *PROSE)),
        ('<article><h1>Flood</h1><div class="share-price-story">%s</div></article>', ("Flood", *PROSE)),
        ('<article><div class="article-header"><h1>Flood</h1></div>%s</article>', ("Flood", *PROSE)),
        ('<article><h1>Flood</h1><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be so.</p>%s</article>', ("Flood", "Let x=1 be so.", *PROSE)),
        ("<article>%s<noscript><p>Plain words.</p></noscript></article>", (*PROSE, "Plain words.")),
        ('<form id="aspnet"><div><h1>Flood</h1>%s</div></form>', ("Flood", *PROSE)),
        ("<html><head><title>T</title><meta charset=x><div><h1>Flood</h1>%s</div>", ("Flood", *PROSE)),
        ('<main>%s<section id="comments"><p>So sad. I was there.</p><p>Me too! It was bad.</p></section></main>', PROSE),
        ('<article>%s<article class="comment"><p>So sad. I was there.</p></article></article>', PROSE),
        ('<div class="content">%s</div><div class="sidebar-right"><p>Popular posts. Read them all today.</p></div>', PROSE),
        ("<div><address>%s</address></div>", ("".join(f"{t} " for t in PROSE).strip(),)),
    ],
)
def test_articles_are_whole(page, want):
    text = paragraphs(*PROSE) if "<address>" not in page else " ".join(PROSE)
    assert html_text.main_text(page % text) == "\n".join(want)


def price(blocks, costs, edges, label):
    return sum(max(c, 0) if not x else max(-c, 0) for c, x in zip(costs, label, strict=True)) + sum(w for a, b, w in edges if label[a] != label[b])


def test_the_flow_decides_real_pages(spark, monkeypatch):
    """On pages of the table the maximum flow runs, overturns what the classifier says, and the labels are the cheapest there are."""
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    weights, flows, cuts = html_text.fit(pages[::2]), [], []
    flow, cut = html_text._flow, html_text.minimum_cut
    monkeypatch.setattr(html_text, "_flow", lambda *a: flows.append(1) or flow(*a))
    monkeypatch.setattr(html_text, "minimum_cut", lambda costs, edges: cuts.append((costs, edges)) or cut(costs, edges))
    overturned = tried = 0
    for page in pages[1::2]:
        blocks, keep, odds = html_text.labelled(page, weights)
        overturned += sum((o > 0) != k for o, k in zip(odds, keep, strict=True))
        costs, edges = cuts.pop()
        n = len(blocks)
        if n <= 11:
            tried += 1
            fixed = [c > 0 for c in costs[n:]]
            best = min(price(blocks, costs, edges, [*(bool(m >> k & 1) for k in range(n)), *fixed]) for m in range(1 << n))
            assert price(blocks, costs, edges, [*keep, *fixed]) == pytest.approx(best)
    assert len(flows) == len(pages[1::2]) and overturned > len(flows) / 2 and tried


def test_a_fitted_classifier_tells_blocks_of_other_pages(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    weights = html_text.fit(pages[::2])
    loss = {"fitted": 0.0, "prior": 0.0}
    right = total = 0
    for page in pages[1::2]:
        blocks, elements = html_text.parse(page)
        mark, _, _ = html_text.marks(blocks, elements)
        x, y = html_text._features(blocks), np.array([mark[b.element] > 0 for b in blocks])
        share = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum()))
        for name, w in (("fitted", weights), ("prior", np.array(html_text.PRIOR))):
            loss[name] += (share * np.log1p(np.exp(np.where(y, -(x @ w), x @ w)))).sum()
        right += ((x @ weights > 0) == y).sum()
        total += len(y)
    assert loss["fitted"] < loss["prior"] and right > 0.85 * total
    assert (html_text.fit([]) == html_text.PRIOR).all() and (html_text.fit(["<p>No article.</p>", ""]) == html_text.PRIOR).all()


def test_flows_of_long_and_deep_pages():
    page = "<div>" * 3000 + "".join(f"<p>Line {k} of many. It goes on.</p>" for k in range(3000)) + "</span>" * 3000
    assert html_text.main_text(page).count("\n") == 2999


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None)], "page_id long, url string, html string, text string")
    rows = html_text.extract(df).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in rows) == [(1, len(html_text.main_text(PAGE)))] * 2 + [(2, 0)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_articles_of_the_pages_table_are_whole(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    for page in pages.html:
        text = html_text.main_text(page)
        article = page.split("<article>")[1]
        assert text.count("\n") + 1 == sum(bool(p.strip()) for p in article.split("</article>")[0].replace("</h1>", "<p>").replace("</p>", "<p>").replace("<b>", "").replace("<br>", "").replace("<h1>", "").split("<p>"))
