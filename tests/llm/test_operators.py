"""The ten operators against brute force, round trips, held-out accuracy and edge tables."""

import collections
import itertools
import math
import random
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilscan.llm import ann, decontaminate, line_dedup, ngram_lm, packing, quality, queries, reshard, simhash, toxicity, transducers, url_filter
from veilscan.llm.common import crc_mod

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: null and empty texts, null ids, repeated rows, a long word, a long text, columns that clash
EDGE = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (None, "words without an id here.", "en", "a", 3), (3, "Same text, twice. Same text, twice.", "en", "a", 1),
    (3, "Same text, twice. Same text, twice.", "en", "a", 1), (4, "x" * 60_000, "en", "b", 60_000), (5, "Ein langer Satz steht hier, mit vielen Wörtern danach. " * 3000, "de", "b", 1), (6, " \t\n ", "en", "b", 4), (7, "\0 zero\0bytes", None, "b", 1),
]
CLASH = ["size", "shard", "id", "pos", "h", "gone", "score", "label", "fp", "u", "v", "seg", "words", "key", "host", "base", "old_shard", "blk", "vector", "b", "g", "rank"]


@pytest.fixture(scope="module")
def edge(spark):
    docs = spark.createDataFrame(EDGE, DOCS)
    return docs.withColumns({c: F.lit("clash") for c in CLASH}).withColumn("place", F.concat(F.lit("f"), F.col("source")))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS).withColumn("place", F.lit("f"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# 1 resharding


def test_transfers_are_cheapest():
    rng = random.Random(1)
    for _ in range(40):
        sizes, shards = [rng.randint(0, 4) for _ in range(rng.randint(1, 3))], rng.randint(1, 3)
        room = reshard.equal_capacities(sum(sizes), shards)
        price = lambda flow: sum(n for (i, j), n in flow.items() if i != j)
        made = reshard.solve_transfers(sizes, room)
        general = reshard.solve_transfers(sizes, room, {})
        ways = [[t for t in itertools.product(range(s + 1), repeat=shards) if sum(t) == s] for s in sizes]
        least = min(sum(t[j] for i, t in enumerate(w) for j in range(shards) if i != j) for w in itertools.product(*ways) if all(sum(t[j] for t in w) == room[j] for j in range(shards)))
        for flow in (made, general):
            assert price(flow) == least
            assert [sum(n for (i, _), n in flow.items() if i == k) for k in range(len(sizes))] == sizes
            assert [sum(n for (_, j), n in flow.items() if j == k) for k in range(shards)] == room


def test_transfers_follow_prices():
    flow = reshard.solve_transfers([6, 0], [2, 2, 2], {(0, 1): 5, (0, 2): 1, (1, 0): 0})
    assert flow == {(0, 0): 2, (0, 1): 2, (0, 2): 2}
    with pytest.raises(ValueError):
        reshard.solve_transfers([5], [4])


def test_reshard_whole_table(spark):
    rows = queries.op1_reshard(spark, "/root/testdata/sf0.01").collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["size"] == len(docs[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(docs[r["doc_id"]].encode()) for r in rows)
    held, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        held[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(held) == set(range(16)) and max(held.values()) <= 1.01 * min(held.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_reshard_moves_little_and_rewrites(spark, tmp_path):
    rows = [(k, "t" * 99, f"f{k % 4}", k) for k in range(400)] + [(1000 + k, "t" * 99, "f0", k) for k in range(100)]
    made = reshard.plan_reshard(spark.createDataFrame(rows, "doc_id long, text string, place string, extra int"), "place", 4)
    got = reshard.with_slots(reshard.assign(made)).collect()
    # the first shard is 75 rows above its capacity of 125 rows; nothing else has to move
    assert sum(r["size"] for r in got if r["shard"] != r["old_shard"]) <= 75 * 100 + 4 * 200
    assert reshard.rewrite(made, str(tmp_path / "out")) == [0, 1, 2, 3]
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 500 and "extra" in back.columns


def test_reshard_edges(spark, edge, empty):
    rows = reshard.with_slots(reshard.assign(reshard.plan_reshard(edge, "place", 16))).collect()
    assert len(rows) == len(EDGE) and sum(r["size"] for r in rows) == sum(len((t[1] or "").encode()) + 1 for t in EDGE)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert reshard.with_slots(reshard.assign(reshard.plan_reshard(empty, "place", 16))).count() == 0


# 2 decontamination


def edit_distance_inside(item: bytes, text: bytes) -> int:
    row = [0] * (len(text) + 1)
    for j, c in enumerate(item, 1):
        last, row = row, [j] + [0] * len(text)
        for i, d in enumerate(text, 1):
            row[i] = min(last[i - 1] + (c != d), last[i] + 1, row[i - 1] + 1)
    return min(row)


def test_leaks_match_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 7)))
    items = [" ".join(word() for _ in range(rng.randint(20, 45))) for _ in range(6)]
    docs = []
    for k in range(60):
        text = [word() for _ in range(rng.randint(0, 80))]
        body = list(rng.choice(items)) if k % 3 else []
        for _ in range(rng.choice((0, 2, 6, 12, 30)) if body else 0):
            at = rng.randrange(len(body))
            rng.choice((lambda: body.pop(at), lambda: body.insert(at, "z"), lambda: body.__setitem__(at, "q")))()
        at = rng.randint(0, len(text))
        docs.append((k, " ".join([*text[:at], "".join(body).upper() if k % 2 else "".join(body), *text[at:]])))
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): min(x["edits"] for x in found if (x["doc_id"], x["item_id"]) == (r["doc_id"], r["item_id"])) for r in found}
    want = {}
    for k, text in docs:
        for i, item in enumerate(items):
            a, b = decontaminate.normal(item), decontaminate.normal(text)
            if (d := edit_distance_inside(a, b)) <= decontaminate.budget(len(a), decontaminate.RATE):
                want[k, i] = d
    assert got == want and len(want) > 15


def test_leaks_in_blocks_and_edges(spark, edge, empty):
    bench = spark.createDataFrame([(1, "Ein langer Satz steht hier, mit vielen Wörtern danach. " * 3), (2, None), (3, ""), (4, "zero"), (4, "zero")], "item_id long, text string")
    one = decontaminate.find_leaks(edge, bench).collect()
    many = decontaminate.find_leaks(edge, bench, index_bytes=20).collect()
    assert sorted(map(tuple, one), key=str) == sorted(map(tuple, many), key=str)
    assert {r["item_id"] for r in one if r["doc_id"] == 5} == {1} and sum(r["doc_id"] == 7 for r in one) == 2
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(edge, bench.limit(0)).count() == 0


# 3 language model


def test_model_matches_plain_kneser_ney(spark, documents):
    held = crc_mod(F.col("doc_id"), 7) == 2
    model = ngram_lm.train(documents, ~held)
    got = {r["doc_id"]: r for r in ngram_lm.score(documents, model, held).collect()}
    split = lambda t: [*(t or "").encode().lower().split(), None]
    rows = documents.select("doc_id", "text").collect()
    learnt = [split(r["text"]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2]
    count = collections.Counter(w for t in learnt for w in t)
    pairs = collections.Counter(p for t in learnt for p in zip([0, *t[:-1]], t, strict=True))
    context, kinds, seen = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0]), collections.Counter()
    for (a, b), n in pairs.items():
        context[a] += n
        kinds[a][min(n, 3) - 1] += 1
        seen[b] += 1
    of = lambda c: [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
    high, low = ngram_lm.discounts(of(pairs)), ngram_lm.discounts(of(seen))
    spare = sum(d * n for d, n in zip(low, (*of(seen)[:2], sum(v >= 3 for v in seen.values())), strict=True)) / len(pairs)
    cut = lambda n, d: max(n - (0, *d)[min(n, 3)], 0)

    def p(a, b):
        one = cut(seen[b], low) / len(pairs) + spare / (len(count) + 1)
        return cut(pairs[a, b], high) / context[a] + sum(d * n for d, n in zip(high, kinds[a], strict=True)) / context[a] * one if context[a] else one

    total = sum(count.values())
    assert math.isclose(sum(p(b"the", w) for w in count) + p(b"the", b"\0unknown"), 1)
    for r in rows:
        t, g = split(r["text"]), got[r["doc_id"]]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(t), sum(w in count for w in t), total)
        assert math.isclose(g["score"], sum(math.log10(p(a, b)) for a, b in zip([0, *t[:-1]], t, strict=True)), rel_tol=1e-9)
        assert math.isclose(g["base_score"], sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in t), rel_tol=1e-9)
    away = [g for g in got.values() if g["held_out"]]
    assert sum(g["score"] for g in away) > sum(g["base_score"] for g in away)


def test_model_edges(spark, edge, empty):
    never = F.lit(False)
    model = ngram_lm.train(edge, ~never)
    got = ngram_lm.score(edge, model, never).collect()
    assert len(got) == len(EDGE) and all(r["score"] < 0 and math.isfinite(r["perplexity"]) for r in got)
    blank = ngram_lm.train(empty, ~never)
    assert all(r["score"] == r["base_score"] == 0 for r in ngram_lm.score(edge, blank, never).collect())
    assert ngram_lm.score(empty, model, never).count() == 0


# 4 line dedup


def plain_line_dedup(rows):
    """First occurrences by (id, position); returns the kept text of each row."""
    places = collections.defaultdict(list)
    for doc, text in rows:
        for n, (a, b, lines) in enumerate(line_dedup.chunks((text or "").encode())):
            body = (text or "").encode()[a:b].rstrip()
            if line_dedup.eligible(body, lines):
                places[body].append((doc, n))
    first = {body: min(at) for body, at in places.items()}
    out = {}
    for doc, text in rows:
        raw = (text or "").encode()
        parts = [(n, raw[a:b]) for n, (a, b, _) in enumerate(line_dedup.chunks(raw))]
        out[doc] = b"".join(p for n, p in parts if first.get(p.rstrip(), (doc, n)) == (doc, n)).decode() if text is not None else None
    return out


def test_line_dedup_matches_brute_force(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents).collect()}
    assert got == plain_line_dedup(rows) and any(got[d] != t for d, t in rows)


def test_chunks_cover_and_resist_shifts():
    rng = random.Random(4)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(4, 9))) + ". "
    passage = "".join(line() for _ in range(30))
    a, b = "".join(line() for _ in range(10)) + passage, passage + "".join(line() for _ in range(12))
    spans = line_dedup.chunks(a.encode())
    assert "".join(a.encode()[x:y].decode() for x, y, _ in spans) == a
    bodies = lambda t: {t.encode()[x:y].strip() for x, y, _ in line_dedup.chunks(t.encode())}
    shared = sum(map(len, bodies(a) & bodies(b)))
    assert shared > 0.6 * len(passage.encode())


def test_line_dedup_copies_and_edges(spark, edge, empty):
    text = " ".join(f"Sentence number {k} has its own words, and so on." for k in range(20))
    rows = spark.createDataFrame([(9, text), (2, text), (5, "Own words come first here. " + text)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(rows).collect()}
    assert got[2]["text"] == text and got[9]["copied"] and got[9]["text"] == "" and got[5]["removed_chunks"] > 0
    made = line_dedup.dedup_lines(edge)
    assert made.count() == len(EDGE) and set(edge.columns) <= set(made.columns)
    kept = {r["doc_id"]: r["text"] for r in made.collect()}
    assert kept[1] is None and kept[2] == "" and kept[4] == "x" * 60_000 and len(kept[5]) < 10_000
    assert line_dedup.dedup_lines(empty).count() == 0


# 5 SimHash


def test_linked_pairs_match_brute_force():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = base[rng.integers(0, 40, 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))
    values = np.unique(np.concatenate((base, near)))
    wide = np.bitwise_count(values[:, None] ^ values[None, :])
    for bits in (0, 1, 2, 3, 5):
        a, b = simhash.linked_pairs(np.zeros(len(values), dtype=np.int64), values, bits)
        got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
        i, j = np.nonzero(np.triu(wide <= bits, 1))
        assert got == {(x, y) for x, y in zip(values[i].tolist(), values[j].tolist(), strict=True)} and len(got) == len(a)
        under = set()
        for mask in simhash.key_masks(bits):
            c, d = simhash.linked_pairs((values & np.uint64(mask)).view(np.int64), values, bits)
            under |= {(min(x, y), max(x, y)) for x, y in zip(c.tolist(), d.tolist(), strict=True)}
        assert under == got


def brute_components(rows):
    own = {}
    for doc, text in rows:
        own.setdefault(simhash.fingerprint(text) & (1 << 64) - 1, []).append(doc)
    prints, root = list(own), {}
    for x in prints:
        root[x] = x

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(prints, 2):
        if (x ^ y).bit_count() <= 2:
            root[find(x)] = find(y)
    least = collections.defaultdict(list)
    for x in prints:
        least[find(x)] += [d for d in own[x] if d is not None]
    return {d: min(least[find(x)]) for x in prints for d in own[x] if d is not None}


@pytest.mark.parametrize("hot_key", [simhash.HOT_KEY, 2])
def test_components_match_brute_force(spark, documents, hot_key, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.BITS, hot_key))
    rng = random.Random(55)
    text = "one two three four five six seven eight nine ten eleven twelve " * 30
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    rows += [(5000 + k, text + " ".join(rng.choices(text.split(), k=k % 7))) for k in range(60)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows)


def test_fingerprint_and_edges(spark, edge, empty):
    from xxhash import xxh64_intdigest

    words = "A b C d a B c".split()
    votes = [0] * 64
    shingles = [" ".join(words[k : k + 3]).lower() for k in range(5)]
    for s in shingles:
        for b in range(64):
            votes[b] += xxh64_intdigest(s, 42) >> b & 1
    assert simhash.fingerprint("A b C d\ta B c") & (1 << 64) - 1 == sum(1 << b for b in range(64) if votes[b] * 2 > 5)
    got = simhash.near_duplicates(edge).collect()
    assert len(got) == len(EDGE) and {r["component_id"] for r in got if r["doc_id"] in (1, 2, 6)} == {1}
    assert simhash.near_duplicates(empty).count() == 0


# 6 and 8 classifiers


@pytest.mark.parametrize(("name", "label"), [("op6_quality", "quality"), ("op8_toxicity", "toxic")])
def test_held_out_accuracy(spark, name, label):
    sf = "/root/testdata/sf0.1"
    made = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r[label] for r in made)
    assert len(made) > 500 and right >= 0.98 * len(made)
    assert all(0 <= r["score"] <= 1 for r in made)


def test_gradient_of_attention():
    rng = np.random.default_rng(6)
    params = [rng.standard_normal(s) * 0.5 for s in ((4, 3), 3, (3, 2), (3, 2), 2, 3, ())]
    x, first = rng.standard_normal((7, 4)), np.array([0, 3, 4])
    slope = rng.standard_normal(3)
    made = quality.backward(params, x, first, quality.forward(params, x, first)[1], slope)
    for k, p in enumerate(params):
        for at in np.ndindex(p.shape):
            moved = [np.array(q, copy=True) for q in params]
            moved[k][at] += 1e-6
            change = (quality.forward(moved, x, first)[0] - quality.forward(params, x, first)[0]) @ slope / 1e-6
            assert math.isclose(change, np.asarray(made[k])[at], rel_tol=1e-3, abs_tol=1e-5)


def test_grammar_composes_scopes():
    words = {b"idiot": 4.0}
    kind = lambda text: toxicity.run_clause(text.encode().split(), words, {b"schur": 3.0})
    assert kind("what an idiot") == {"plain": 4.0}
    assert kind("you are an idiot") == {"targeted": 4.0}
    assert kind("you are not an idiot") == {"negated": 4.0}
    assert kind("someone said you are an idiot") == {"reported": 4.0}
    assert kind("i will kill you") == {"threat": 2.0}
    assert kind("kill the process") == {}
    assert kind("so ein schurke") == {"plain": 3.0}
    assert toxicity.features("He said so. You idiot!", words, {})[1] > 0


def test_classifier_edges(spark, edge, empty, labels):
    everything = F.lit(True)
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        model = module.train(edge, labels, everything, label)
        rows = module.score(edge, model).collect()
        assert len(rows) == len(EDGE) and all(0 <= r["score"] <= 1 for r in rows)
        none = module.train(empty, labels.limit(0), everything, label)
        assert all(0 <= r["score"] <= 1 for r in module.score(edge, none).collect())
        assert module.score(empty, model).count() == 0


# 7 URL filter


def test_cascade_is_exact(spark):
    rng = random.Random(7)
    rows = [(f"k{n}", rng.random() < 0.2) for n in range(3000)] + [("k1", True), (None, True)]
    universe = spark.createDataFrame(rows, "key string, bad boolean")
    want = {k or "" for k, bad in rows if bad}
    for segment_keys in (10_000, 100):
        made = url_filter.build_cascade(universe, "key", "bad", segment_keys)
        assert made.segments == (1 if segment_keys > 1000 else math.ceil(len(want) / 100)) and len(made.levels) > 1
        got = url_filter.in_list(universe, F.col("key"), made, "out").collect()
        assert len(got) == len(rows) and all(r["out"] == ((r["key"] or "") in want) for r in got)


def test_url_rules_and_edges(spark):
    urls = [
        "http://a.org", "http://A.ORG/x", "https://example.org/es/1", "https://sub.example.org/en/12?q#f", "https://notexample.org/es/", "ftp://x.com/fr/", "HTTPS://x.com/de/1", "no scheme", None, "", "http://b.net/p?x", "https://b.net/p#y",
        "https://c.net/p", "http://a.org",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "path", "key", "words", "seg", "listed")})
    got = {r["page_id"]: r for r in url_filter.judge_pages(pages, queries.RULES).collect()}
    rule = {0: None, 1: "org/", 2: "example.org/es/", 3: "example.org/en/1", 4: "org/", 5: "com/fr/", 6: "com/de/", 7: None, 8: None, 9: None, 10: None, 11: None, 12: None, 13: None}
    verdict = dict.fromkeys((0, 2, 3, 6, 10, 11, 13), "block")
    assert {k: r["rule"] for k, r in got.items()} == rule
    assert {k: r["verdict"] for k, r in got.items()} == {k: verdict.get(k, "allow") for k in got}
    assert (got[1]["host"], got[1]["path"], got[3]["path"], got[8]["host"]) == ("a.org", "/x", "/en/12", "")
    assert url_filter.judge_pages(pages.limit(0), queries.RULES).count() == 0


# 9 neighbours


def test_neighbours_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op9_nearest(spark, sf).collect()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float)
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(r["vec_id"])
        assert math.isclose(r["score"], float(x[ids == r["query_id"]][0] @ x[ids == r["vec_id"]][0]), abs_tol=1e-12)
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -s))[:20]].tolist()) & set(got[ids[q]]))
    assert hits >= 0.95 * 20 * (ids % 20 == 0).sum()


@pytest.mark.parametrize("dims,kind", [(128, "one long"), (128, "spread"), (128, "equal"), (768, "one long"), (768, "spread")])
def test_neighbours_recall_of_unequal_norms(spark, tmp_path, dims, kind):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng, n = np.random.default_rng(dims), 8_000
    x = rng.standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "spread":
        x *= np.exp(0.25 * rng.standard_normal(n))[:, None]
    elif kind == "one long":
        x[n - 1] *= 3
    x = x.astype(np.float32)
    lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dims).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": lists}), f"{tmp_path}/v.parquet")
    table = spark.read.parquet(f"{tmp_path}/v.parquet")
    got = {(r["query_id"], r["vec_id"]) for r in ann.nearest(table, table.where("vec_id < 60"), 20).collect()}
    score = x[:60].astype(float) @ x.astype(float).T
    score[np.arange(60), np.arange(60)] = -np.inf
    want = {(q, int(v)) for q in range(60) for v in np.argsort(-score[q])[:20]}
    assert len(got & want) >= 0.95 * len(want)


def test_neighbours_ties_and_edges(spark):
    rows = [(k, [1.0, 0.0, 2.0]) for k in range(60)] + [(60, None), (61, [0.0, 0.0, 0.0]), (62, [1.0, None, 2.0]), (63, [float("nan"), 1.0, 1.0]), (64, [float("inf"), 1.0, 1.0]), (65, [1.0]), (66, []), (67, [3.0, 0.0, 9.0]), (None, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("vector", "b", "g", "score", "rank", "query_id")})
    got = ann.nearest(table, table.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got if r["query_id"] == 0] == [67, *range(1, 20)]
    assert [r["vec_id"] for r in got if r["query_id"] == 40] == [67, *range(19)]
    assert {r["query_id"] for r in got} == {0, 20, 40}
    few = table.where("vec_id < 3")
    assert ann.nearest(few, few.where("vec_id = 0"), 20).count() == 2
    assert ann.nearest(table.limit(0), table.limit(0), 20).count() == 0


# 10 packing


def test_packing_round_trip(spark, edge, empty, documents):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.vocabulary())
    plain.encode_special_tokens = True
    special = spark.createDataFrame([(90, "<|endoftext|> is ordinary text " * 3, None, None, 0)], DOCS)
    for docs in (documents, edge.select(*documents.columns).where("doc_id <> 3").union(special)):
        texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        rows = packing.pack(docs, queries.vocabulary()).collect()
        pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
        for r in rows:
            pieces[r["doc_id"]].append(r)
            sequences[r["sequence_id"]].append(r)
        assert set(pieces) == set(texts)
        for doc, own in pieces.items():
            ids = [*plain.encode(texts[doc], add_special_tokens=False).ids, 0]
            own.sort(key=lambda r: r["start"])
            assert [r["start"] for r in own] == [0, *itertools.accumulate(r["length"] for r in own)][:-1] and sum(r["length"] for r in own) == len(ids)
            for r in own:
                assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())
        for own in sequences.values():
            own.sort(key=lambda r: r["offset"])
            size = sum(r["length"] for r in own)
            assert [r["offset"] for r in own] == [0, *itertools.accumulate(r["length"] for r in own)][:-1]
            assert size == own[0]["sequence_length"] and (size == 1024 or size & (size - 1) == 0 and size < 1024)
    assert packing.pack(empty, queries.vocabulary()).count() == 0
    assert packing.pack(edge, queries.vocabulary()).where("doc_id = 3 AND start = 0").count() == 2


def test_packing_marker_ids_of_plain_call(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.vocabulary())
    rng = random.Random(11)
    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "a", " word", "it's", "é", "12", "\0"]
    texts = ["a <|endoftext|> b", "<|endoftext|>" * 3, *["".join(rng.choices(parts, k=12)) for _ in range(300)]]
    for limit in (packing.LONG_TEXT, 0):  # the fast and the slow encoder
        monkeypatch.setattr(packing, "LONG_TEXT", limit)
        encode = packing.Encoder(queries.vocabulary(), markers=True)
        assert all(encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids for t in texts)
    monkeypatch.undo()
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts[:20])], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for made in (queries.op10_pack(spark, str(tmp_path)), corpus_pipeline.pack_stage(spark, docs, str(tmp_path))):
        tokens = {r["doc_id"]: r["doc_tokens"] for r in made.collect()}
        assert tokens == {k: len(plain.encode(t, add_special_tokens=False).ids) + 1 for k, t in enumerate(texts[:20])}


def test_balance_takes_lowest_cost_in_descending_order():
    rng = random.Random(10)
    for n in (0, 1, 7, 300):
        sizes = [rng.randint(1, 1023) for _ in range(n)]
        made = packing.balance(sizes, 1024)
        room = packing.capacities(sum(sizes), 1024)
        cost, want = [0] * len(room), [[] for _ in room]
        todo = [(-s, k, 0) for k, s in enumerate(sizes)]
        while todo:
            todo.sort()
            size, piece, start = todo.pop(0)
            k = min((c, k) for k, c in enumerate(cost) if sum(p[2] for p in want[k]) < room[k])[1]
            used = sum(p[2] for p in want[k])
            part = min(-size, room[k] - used)
            want[k].append((piece, start, part, used))
            cost[k] += part + part * part
            if part < -size:
                todo.append((size + part, piece, start + part))
        assert made == want and sum(room) == sum(sizes)


# long, repeated and clashing input


def test_law_holds_with_repeated_rows(spark):
    """A third of the rows are copies of one row: shard sizes stay within 1 % of the mean, slots have no gaps."""
    rows = [(k, "t" * (k % 61)) for k in range(12_000)] + [(7, "the same row again")] * 6000
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.concat(F.lit("f"), F.spark_partition_id()))
    made = reshard.with_slots(reshard.assign(reshard.plan_reshard(docs, "place", 8))).groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    mean = sum(r["bytes"] for r in made) / 8
    assert len(made) == 8 and all(abs(r["bytes"] - mean) <= 0.01 * mean and r["n"] == r["slots"] == r["last"] + 1 for r in made)


def test_flow_of_many_shards_runs_through_the_solver():
    sizes, room = [100, 3, 40, 0, 57], reshard.equal_capacities(200, 4)
    flow = reshard.solve_transfers(sizes, room)
    assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(5)] == sizes
    assert [sum(v for (_, j), v in flow.items() if j == k) for k in range(4)] == room
    assert sum(v for (i, j), v in flow.items() if i != j) == 200 - sum(min(a, b) for a, b in zip(sizes, room, strict=False))


def test_line_dedup_replaces_its_own_names(spark, documents):
    clash = documents.withColumns({c: F.lit("own") for c in line_dedup.OWN})
    plain = line_dedup.dedup_lines(documents).select("doc_id", "text", *line_dedup.OWN)
    assert sorted(map(tuple, line_dedup.dedup_lines(clash).select("doc_id", "text", *line_dedup.OWN).collect())) == sorted(map(tuple, plain.collect()))
    kept = line_dedup.dedup_lines(clash, prefix="new_")
    assert {r["copied"] for r in kept.collect()} == {"own"} and kept.schema["new_copied"].dataType.simpleString() == "boolean"


def test_neighbours_compare_doubles(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0 + 2.0**-40, 0.0]), (2, [1.0, 0.0]), (3, [1.0 + 2.0**-30, 0.0])]
    made = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>"), 3).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in made] == [(3, 1.0 + 2.0**-30), (1, 1.0 + 2.0**-40), (2, 1.0)]


def test_composed_grammar_equals_its_definition():
    """Every clause of a small alphabet, read by the machine and by the scopes' definition."""
    words = {b"bad": 3.0}
    symbols = [b"bad", b"kill", b"you", b"not", b"said", b"x"]
    rng = random.Random(8)
    clauses = [list(c) for n in range(1, 6) for c in itertools.product(symbols, repeat=n)] + [rng.choices(symbols, k=14) for _ in range(2000)]
    for clause in clauses:
        expected = {}
        for k, word in enumerate(clause):
            if word in (b"bad", b"kill"):
                near = any(clause[t] == b"you" and abs(k - t) <= toxicity.SCOPE for t in range(len(clause)))
                if b"said" in clause[:k]:
                    kind = "reported"
                elif b"not" in clause[max(0, k - toxicity.SCOPE) : k]:
                    kind = "negated"
                elif word == b"bad":
                    kind = "targeted" if near else "plain"
                else:
                    kind = "threat" if near else None
                if kind:
                    weight = 3.0 if word == b"bad" else 2.0 if kind == "threat" else 1.0
                    expected[kind] = max(expected.get(kind, 0.0), weight)
        assert toxicity.run_clause(clause, words, {}) == expected


def test_composition_is_application_in_turn():
    rng = random.Random(9)
    one, two = (transducers.machine(n, lambda s, x, n=n: ((s * 5 + x) % n, (x * 7 + s) % transducers.SYMBOLS)) for n in (3, 4))
    both = transducers.compose(one, two)
    for _ in range(50):
        said = [rng.randrange(transducers.SYMBOLS) for _ in range(30)]
        assert transducers.run(both, said) == transducers.run(two, transducers.run(one, said))
    assert len(both.arcs) <= 12


def test_a_clause_of_many_words_is_read_in_linear_time():
    clause = "you bad x said ".split() * 250_000
    began = time.time()
    assert toxicity.features(" ".join(clause), {b"bad": 3.0}, {})[3] > 0
    assert time.time() - began < 30


def test_repetitive_and_long_texts_are_scanned_whole(monkeypatch):
    item = "a" * 400
    index = decontaminate.build_index([(1, item), (2, "some words that a benchmark asks about in one line"), (3, "some words that a benchmark asks about in one line")])
    whole = "a" * 3000 + " x " + "some words that a benchmark asks about in one line" + " y" * 4000
    batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([whole])], names=["doc_id", "text"])
    find = lambda: [r for b in decontaminate.scan_batches(iter([batch]), index, pa.int64()) for r in b.to_pylist()]
    expected = find()
    assert sum(r["item_id"] == 1 and r["edits"] == 0 for r in expected) >= 5 and {r["item_id"] for r in expected} == {1, 2, 3}
    monkeypatch.setattr(decontaminate, "PAIRS", 1000)
    assert find() == expected
    monkeypatch.setattr(decontaminate, "SCAN_BYTES", 700)
    assert {(r["item_id"], r["start"]) for r in find() if r["item_id"] > 1} == {(r["item_id"], r["start"]) for r in expected if r["item_id"] > 1}


def test_repetitive_text_needs_bounded_memory():
    index = decontaminate.build_index([(1, "a" * 2000)])
    tracemalloc.start()
    decontaminate.scan(index, b"a" * 300_000, np.zeros(1, dtype=np.int64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6
