"""Decontamination, near-duplicates, repeated strings and n-grams against brute force on small fixtures."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from celestrum.llm import bytewords as bw
from celestrum.llm import decontaminate, mapped, near_dups, ngram, repeats, shared
from celestrum.llm.components import components

WORDS = "alpha Beta gamma délta EPS zeta eta theta iota kappa lam mu".split()


def corpus(n=60, seed=3):
    """Texts with copies, near copies, shared passages, repeats, odd ones and nulls."""
    rng = random.Random(seed)
    words = lambda k: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(k))
    passage, out = words(60), []
    for k in range(n):
        kind = k % 6
        if kind == 0 or not out:
            out.append(words(rng.randrange(1, 150)))
        elif kind == 1:
            out.append(rng.choice([t for t in out if t]))
        elif kind == 2:
            t = rng.choice([t for t in out if t]).split(" ")
            t[rng.randrange(len(t))] = "changed"
            out.append(" ".join(t))
        elif kind == 3:
            out.append(words(30) + " " + passage + "\n" + words(rng.randrange(3)))
        elif kind == 4:
            out.append("Ab " * rng.randrange(150))
        else:
            out.append(rng.choice([None, "", "  \n", "One", "one two", passage, "\x00\x00 x", "ẞ" * 130 + passage]))
    return out


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "clash", k % 3) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept int").repartition(3)


def tokens(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())


def test_words_and_grams_are_those_of_the_text(texts):
    known = {}
    for part in bw.slices(pa.array(texts), limit=500):
        w = bw.words(part, bw.SPACED)
        for k in range(len(part)):
            want = tokens(texts[part.first + k])
            got = w.hashes[w.of_row[k] : w.of_row[k + 1]].tolist()
            assert len(got) == len(want)
            for a, b in zip(want, got, strict=True):
                assert known.setdefault(a, b) == b
    assert len(set(known.values())) == len(known)


def test_winnowing_marks_a_least_value_of_each_window():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 50, 400).astype(bw.U64)
    marked = bw.winnowed(h, 8)
    for k in range(len(h) - 7):
        assert (marked[k : k + 8] & (h[k : k + 8] == h[k : k + 8].min())).any()


def brute_hits(texts, items):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for t in texts:
        w, hit, found = word(t), set(), set()
        for name, text in items:
            v = word(text)
            n = min(13, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(str(name))
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 200])
def test_contamination(spark, texts, docs, block_bytes):
    passage = corpus()[3].split("\n")[0]
    items = [(1, " ".join(passage.split()[35:60])), (2, "one TWO"), (10, passage), (7, None), (8, ""), (9, "absent words of no text at all in here really none of them"), (2, "ab ab ab")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.find_contamination(docs, bench, block_bytes=block_bytes).collect()}
    for k, want in enumerate(brute_hits(texts, items)):
        assert got[k] == want, texts[k]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.find_contamination(docs, bench, cut=True, block_bytes=block_bytes).collect()}
    for (n, hit, _), (m, _, _) in zip(brute_hits(texts, items), brute_hits([cut[k] for k in range(len(texts))], items), strict=True):
        assert m == n - hit
    assert {r["n_hit"] for r in decontaminate.find_contamination(docs, bench.limit(0)).collect()} == {0}
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0


def brute_groups(texts, size, percent):
    sets = []
    for t in texts:
        w = tokens(t)
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            i, j = sorted((find(a), find(b)))
            root[j] = i
    return [(len(s), find(k)) for k, s in enumerate(sets)]


@pytest.mark.parametrize(("size", "percent", "chunk", "short"), [(3, 85, 4096, 12), (3, 85, 4, 1), (5, 80, 4096, 12)])
def test_near_duplicates(texts, docs, size, percent, chunk, short):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dups.find_near_duplicates(docs, size, percent, chunk=chunk, short=short).collect()}
    assert [got[k] for k in range(len(texts))] == brute_groups(texts, size, percent)


def test_near_duplicates_of_odd_tables(spark, docs):
    rows = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (3, None), (None, None), (2, "x y z w")], "doc_id long, text string")
    got = sorted(near_dups.find_near_duplicates(rows).collect(), key=repr)
    assert len(got) == 6 and all(r["kept"] for r in got if r["doc_id"] is None)
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"]} == {(5, 5), (3, 3), (2, 2)}
    assert near_dups.find_near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_carry_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", 7, 8, 9), (2, "a b c d e f", 1, 2, 3)], "doc_id long, text string, key long, at long, file long")
    got = sorted(tuple(r) for r in near_dups.find_near_duplicates(rows, carry=("key", "at", "file")).select("doc_id", "component_id", "key", "at", "file").collect())
    assert got == [(1, 1, 7, 8, 9), (2, 1, 1, 2, 3)]
    with pytest.raises(ValueError, match="kept"):
        near_dups.find_near_duplicates(rows.withColumnRenamed("key", "kept"), carry=("kept",))


def planned(monkeypatch) -> list[str]:
    """The plans of tables that are written from now on."""
    plans, write = [], shared.written
    monkeypatch.setattr(shared, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    return plans


def test_near_duplicates_broadcast_nothing(spark, monkeypatch):
    plans = planned(monkeypatch)
    shared.written(near_dups.query(spark, "/root/testdata/sf0.001"), "result")
    assert sum(p.count("SortMergeJoin") for p in plans) >= 7
    assert not any("Broadcast" in p for p in plans)


def test_words_of_a_long_text_are_those_of_its_pieces():
    text = "Ab  cd " * 900_000 + "x" * 5_000_000 + " end"
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    w = bw.words(bw.Texts(0, data, np.array([0, len(data)])), bw.SPACED)
    short = bw.words(next(bw.slices(pa.array(["Ab  cd " + "x" * 5_000_000 + " end"]), 1 << 30)), bw.SPACED)
    assert len(w.hashes) == 1_800_002 and w.of_row.tolist() == [0, 1_800_002]
    assert w.hashes[-4:].tolist() == short.hashes.tolist() and w.ends[-1] == len(data) and w.starts[2] == 7


def test_agreement_misses_one_in_a_million():
    for percent in (80, 85):
        m, p = near_dups.agreement(percent), percent / 100
        below = sum(math.comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(m))
        assert below <= 1e-6 < below + math.comb(64, m) * p**m * (1 - p) ** (64 - m)


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 130)] + [(7, k) for k in range(8, 20)] + [(3, 3), (200, 199), (198, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in range(100, 131)} == {100} and {got[k] for k in range(7, 20)} == {7} and got[200] == got[199] == 198 and 3 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(texts, window, keep_first):
    data, seen = [(t or "").encode() for t in texts], defaultdict(list)
    for k, t in enumerate(data):
        for p in range(len(t) - window + 1):
            seen[t[p : p + window]].append((k, p))
    gone = [np.zeros(len(t), dtype=bool) for t in data]
    for places in seen.values():
        for k, p in places[keep_first:] if len(places) > 1 else ():
            gone[k][p : p + window] = True
    return data, gone


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("crowd", [repeats.CROWD, 1])
def test_repeats(texts, docs, keep_first, crowd):
    got = {r["doc_id"]: r for r in repeats.remove_repeats(docs, keep_first=keep_first, crowd=crowd).collect()}
    for k, (t, gone) in enumerate(zip(*brute_repeats(texts, 200, keep_first), strict=True)):
        kept = np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        assert (got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"], got[k]["kept_sha256"]) == (len(t), gone.sum(), runs, hashlib.sha256(kept).hexdigest())
        assert got[k]["text"] == (texts[k] if not gone.any() else kept.decode(errors="ignore"))


def test_repeated_rows_are_repeats(spark):
    text = " ".join(f"w{k}" for k in range(90))
    rows = spark.createDataFrame([(1, text), (1, text), (None, "short"), (2, None)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in repeats.remove_repeats(rows).collect()) == [0, 0, len(text), len(text)]
    assert repeats.remove_repeats(rows.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [repeats.CROWD, 1])
def test_first_of_texts_without_different_ids(spark, crowd):
    same = " ".join(f"w{k}" for k in range(90))
    tails = ["", " a", " and b of more than a few bytes " * 9, " c" * 60]
    for key in (None, 5):
        rows = spark.createDataFrame([(key, same + t) for t in tails] + [(None, "short"), (7, same)], "doc_id long, text string").repartition(3)
        got = repeats.remove_repeats(rows, keep_first=True, crowd=crowd).collect()
        # Of the shared string one copy stays.
        assert sum(same in r["text"] for r in got) == 1 and len(got) == 6
        assert next(r["text"] for r in got if r["doc_id"] == 7) == ""
    least = -(1 << 63)
    rows = spark.createDataFrame([(None, same), (least, same), (least, same)], "doc_id long, text string")
    assert sorted((r["doc_id"] is None, r["text"]) for r in repeats.remove_repeats(rows, keep_first=True, crowd=crowd).collect()) in ([(False, ""), (False, ""), (True, same)], [(False, same), (False, same), (True, "")])


def test_longest_previous_factors():
    rng = random.Random(2)
    for _ in range(60):
        data = bytes(rng.choice(b"ab") for _ in range(rng.randrange(40)))
        order = sorted(range(len(data)), key=lambda k: data[k:])
        alike = lambda i, j: next((n for n in range(len(data)) if data[i : i + n + 1] != data[j : j + n + 1] or max(i, j) + n >= len(data)), 0)
        common = np.array([0] * bool(data) + [alike(i, j) for i, j in itertools.pairwise(order)], dtype=np.int64)
        length, before, after = repeats.previous_factors(np.array(order, dtype=np.int64), common)
        for n, k in enumerate(order):
            assert length[n] == max((alike(j, k) for j in range(k)), default=0)
            for to in (before[n], after[n]):
                assert to < 0 or order[to] < k
            assert not length[n] or length[n] in [alike(order[to], k) for to in (before[n], after[n]) if to >= 0]


def test_query_takes_its_rows_from_previous_factors(texts):
    """Every result of the sorting step goes through the two arrays."""
    code = repeats.context_factors.__code__.co_names, repeats._sort.__code__.co_names
    assert all("previous_factors" in names for names in code)


def test_parts_of_a_long_text_have_its_anchors():
    rng = random.Random(8)
    text = " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(6000)) + "Ab " * 900
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    whole = bw.Texts(0, data, np.array([0, len(data)]))
    docs = repeats.Docs(np.array([5]), np.array([9], dtype=bw.U64))

    def found(limit):
        out = []
        for part in repeats._parts(whole, docs, 200, limit):
            a = repeats.Anchors(part, 200)
            own = np.flatnonzero(a.own)
            out += zip(*repeats._occurrences(a, part, own).values(), a.left[own], a.right[own], strict=True)
            assert np.isin(repeats._windows(a, a.own, part, 200), repeats._windows(a, a.own | True, part, 200)).all()
        return out

    assert found(1 << 30) == found(5000) == found(777)


def test_long_texts_and_clashing_names(spark):
    rng = random.Random(8)
    words = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(n))
    passage = words(40)
    long = words(150_000) + passage + words(150_000)
    texts = [long, "x " + passage, words(20)]
    assert len(long) > 1.4 * 2 * repeats.SLICE_BYTES
    rows = spark.createDataFrame([(k, t, 70 + k, "b") for k, t in enumerate(texts)], "doc_id long, text string, _id long, bucket string")
    got = {r["doc_id"]: r for r in repeats.remove_repeats(rows).collect()}
    for k, (t, gone) in enumerate(zip(*brute_repeats([long[1_500_000:-1_500_000], *texts[1:]], 200, False), strict=True)):
        assert (got[k]["n_removed"], got[k]["_id"], got[k]["bucket"]) == (gone.sum(), 70 + k, "b") and len(t)
    assert got[0]["n_removed"] >= len(passage)


def test_a_missing_file_is_an_error(tmp_path):
    path = str(tmp_path / "x")
    os.makedirs(path)
    for k in (0, 2):
        mapped.store(f"{path}/words-{k}", {"a": np.arange(k + 1)})
    with pytest.raises(OSError, match="2 of 3"):
        mapped.manifest(path, "words", 4, 3)
    there = mapped.manifest(path, "words", 4, 2)
    assert there.tolist() == [True, False, True, False]
    os.remove(f"{path}/words-2")
    folder = mapped.Folder(f"{path}/words", there)
    assert folder[0]["a"].tolist() == [0] and folder[1] is None
    with pytest.raises(FileNotFoundError):
        folder[2]


def test_maps_hold_few_descriptors(tmp_path):
    for k in range(300):
        mapped.store(f"{tmp_path}/f-{k}", {"a": np.arange(4)})
    folder = mapped.Folder(f"{tmp_path}/f", np.ones(300, dtype=bool), limit=40)
    before = len(os.listdir("/proc/self/fd"))
    for k in [*range(300), *range(300)]:
        assert folder[k]["a"][3] == 3
    assert len(os.listdir("/proc/self/fd")) <= before + 40 and len(folder.files.held) == 40


def kneser_ney(texts):
    """Probability of a word after a word, by the textbook."""
    pairs, single = Counter(), Counter()
    for t in texts:
        w = [*tokens(t), b"</s>"]
        single.update(w)
        pairs.update(zip([b"<s>", *w[:-1]], w, strict=True))
    before = Counter(b for _, b in pairs)

    def discounts(values):
        n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        if min(n) == 0:
            return [0, 0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [0, *(min(k + 1, max(0, k + 1 - (k + 2) * y * n[k + 1] / n[k])) for k in range(3))]

    d2, d1 = discounts(pairs.values()), discounts(before.values())
    rest = sum(d1[min(3, c)] for c in before.values()) / len(pairs)
    after = defaultdict(list)
    for (a, _), c in pairs.items():
        after[a].append(c)

    def p(a, b):
        low = max(0, before[b] - d1[min(3, before[b])]) / len(pairs) + rest / (len(single) + 1)
        if a not in after:
            return low
        c, total = pairs[a, b], sum(after[a])
        return max(0, c - d2[min(3, c)]) / total + sum(d2[min(3, v)] for v in after[a]) / total * low

    return p, single


def test_ngram_scores(spark, texts, docs):
    train = [t for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 7 != 2]
    p, single = kneser_ney(train)
    got = {r["doc_id"]: r for r in ngram.score(docs, ngram.train(docs.where(~ngram.held_out()))).collect()}
    n = sum(single.values())
    for k, t in enumerate(texts):
        w = [*tokens(t), b"</s>"]
        assert got[k]["score"] == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip([b"<s>", *w[:-1]], w, strict=True)))
        assert got[k]["base_score"] == pytest.approx(sum(math.log10((single[b] + 1) / (n + len(single) + 1)) for b in w))
        assert (got[k]["n_tokens"], got[k]["n_known"], got[k]["train_tokens"]) == (len(w), sum(b in single for b in w), n)
    everything = [*single, b"never seen"]
    assert sum(p(b"<s>", b) for b in everything) == pytest.approx(1.0)


def kneser_ney_of(texts, order):
    """Probability of a word after order - 1 words, by the textbook, from order - 1 begin signs on."""
    tables = {order: Counter()}
    for t in texts:
        w = [b"<s>"] * (order - 1) + [*tokens(t), b"</s>"]
        tables[order].update(tuple(w[k : k + order]) for k in range(len(w) - order + 1))
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    discount, after = {}, {k: defaultdict(list) for k in tables}
    for k, table in tables.items():
        n = [sum(v == c for v in table.values()) for c in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if min(n) else 0
        discount[k] = [0, *(min(c + 1, max(0, c + 1 - (c + 2) * y * n[c + 1] / n[c])) for c in range(3))] if min(n) else [0, 0.5, 1.0, 1.5]
        for g, c in table.items():
            after[k][g[:-1]].append(c)

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (len(tables[1]) + 1)
        low, own = p(gram[1:]), after[k].get(gram[:-1])
        if not own:
            return low
        c, d = tables[k][gram], discount[k]
        return max(0, c - d[min(3, c)]) / sum(own) + sum(d[min(3, v)] for v in own) / sum(own) * low

    return p, [g[0] for g in tables[1]]


@pytest.mark.parametrize(("order", "more"), [(2, {}), (3, {}), (3, {"held": 500}), (3, {"split": 9}), (2, {"split": 9}), (3, {"split": 9, "held": 500}), (3, {"wide": True, "split": 30}), (4, {"held": 500}), (5, {"split": 5})])
def test_ngram_scores_of_orders(spark, texts, docs, order, more):
    train = [t for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 7 != 2]
    p, words = kneser_ney_of(train, order)
    model = ngram.train(docs.where(~ngram.held_out()), order, **more)
    assert bool(len(model.hot)) == ("split" in more)
    got = {r["doc_id"]: r["score"] for r in ngram.score(docs, model).collect()}
    for k, t in enumerate(texts):
        w = [b"<s>"] * (order - 1) + [*tokens(t), b"</s>"]
        assert got[k] == pytest.approx(sum(math.log10(p(tuple(w[j : j + order]))) for j in range(len(w) - order + 1)))
    context = tuple([b"<s>"] * (order - 2) + [tokens(train[0])[0]])
    assert sum(p((*context, b)) for b in [*words, b"never seen"]) == pytest.approx(1.0)


def test_pieces_of_a_long_text_have_its_tokens():
    text = " ".join(f"w{k % 7}" for k in range(3000)) + "x" * 300 + " " * 400 + "end"
    whole = next(ngram.tokens_of(pa.array([text]), 3, 1 << 30))
    found, lead = [], 0
    for t in ngram.tokens_of(pa.array([text]), 3, 100):
        assert t.hashes[: t.lead].tolist() == found[len(found) - t.lead :]
        found += t.hashes[t.lead :].tolist()
        lead = max(lead, t.lead)
    assert found == whole.hashes.tolist() and lead == 2 and not t.more


def test_ngram_scores_of_a_long_text(spark):
    long = " ".join(f"w{k % 911}" for k in range(1_300_000))
    assert len(long) > 2 * bw.SLICE_BYTES
    rows = spark.createDataFrame([(0, long, "x"), (1, "w1 w2 w3", "y"), (2, None, "z")], "doc_id long, text string, bucket string")
    model = ngram.train(rows, 3)
    got = {r["doc_id"]: r for r in ngram.score(rows, model).collect()}
    assert model.tokens == 1_300_006 and got[0]["n_tokens"] == got[0]["n_known"] == 1_300_001 and got[2]["n_tokens"] == 1 and got[1]["bucket"] == "y"
    assert got[0]["score"] / got[0]["n_tokens"] > -0.01  # each word follows from the two before


def test_ngram_looks_up_each_context_once(spark, texts, docs, monkeypatch):
    model = ngram.train(docs, 3)
    some = next(ngram.tokens_of(pa.array(texts), 3))
    asked, found = [], ngram._found
    monkeypatch.setattr(ngram, "_found", lambda file, context, *more: asked.extend(context.tolist()) or found(file, context, *more))
    ngram.Reader(model).score(some)
    contexts = set()
    for t in texts:
        w = [b"<s>", b"<s>", *tokens(t)]  # the end is no context
        contexts |= {(b,) for b in w[1:]} | set(zip(w, w[1:], strict=False))
    assert len(asked) == len(set(asked)) == len(contexts)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_ngrams_of_too_many_bits(spark, texts, docs, monkeypatch, order):
    """Sorted by columns, n-grams and scores are those of packed ones."""
    reader = ngram.Reader(ngram.train(docs, order, split=9))
    some = list(ngram.tokens_of(pa.array(texts), order))
    packed = [ngram._counted_grams(reader, some, order), *map(reader.score, some)]
    monkeypatch.setattr(ngram, "_packs", lambda columns, most: None)
    columns, counts = ngram._counted_grams(reader, some, order)
    assert np.array(columns).tolist() == np.array(packed[0][0]).tolist() and counts.tolist() == packed[0][1].tolist()
    for t, got in zip(some, packed[1:], strict=True):
        assert reader.score(t)["score"].tolist() == got["score"].tolist()


@pytest.mark.parametrize("cells", [1, 8])
def test_ngram_buckets(monkeypatch, cells):
    """Counts and totals of a bucket's contexts, of which some have many next words and some the same low half."""
    monkeypatch.setattr(ngram, "CELLS", cells)
    monkeypatch.setattr(ngram, "CELL", 1 << 20)
    rng = np.random.default_rng(7)
    rows = {}
    for c in range(300):
        context = int(rng.integers(0, 1 << 64, dtype=np.uint64)) & ~0xFFFFFF00 if c % 3 else int(rng.integers(0, 1 << 64, dtype=np.uint64))
        for w in rng.integers(0, 500, [1, 1, 3, 20, 200][c % 5]).tolist():
            rows[context, w] = int(rng.integers(1, 5))
    # One context for all that the bucket can't tell apart.
    every = np.unique(np.array([c for c, _ in rows], dtype=np.uint64))
    _, alone = np.unique(ngram._cells(every, 1, cells).astype(np.uint64) << np.uint64(32) | every & np.uint64(0xFFFFFFFF), return_index=True)
    alone = set(every[alone].tolist())
    rows = {g: n for g, n in rows.items() if g[0] in alone}
    grams = sorted(rows)
    array = lambda v, kind: np.array(v, dtype=kind)
    file = ngram._stored(array([c for c, _ in grams], np.uint64), array([w for _, w in grams], np.uint32), array([rows[g] for g in grams], np.int64), 1)
    contexts = sorted({c for c, _ in grams}) + [12345]
    count, stats = ngram._found(file, array(contexts, np.uint64), np.full(len(contexts), 500), np.tile(np.arange(500), len(contexts)), 1)
    assert count.tolist() == [rows.get((c, w), 0) for c in contexts for w in range(500)]
    for c, got in zip(contexts, stats.T.tolist(), strict=True):
        own = [rows.get((c, w), 0) for w in range(500)]
        assert got == [sum(own), own.count(1), own.count(2), sum(n > 2 for n in own)]


def test_ngram_query_uses_longer_contexts():
    assert ngram.ORDER >= 3


def test_ngram_of_nothing(spark, docs):
    model = ngram.train(docs.limit(0))
    assert {r["n_known"] for r in ngram.score(docs, model).collect()} == {0}
