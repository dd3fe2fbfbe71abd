"""Winnowing, the conversation trie and phrase mining against brute force and edge tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from veilscan.llm import collocations, prefix_trie, queries, winnowing

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


# 11 winnowing


def slow_marks(text, k, w):
    points = [ord(c) + 1 for c in text]
    if not points:
        return []
    k, hashes = min(k, len(points)), []
    for i in range(len(points) - k + 1):
        h = 0
        for p in points[i : i + k]:
            h = (h * int(winnowing.BASE) + p) & MASK
        h = ((h ^ (h >> 31)) * int(winnowing.SPREAD)) & MASK
        hashes.append(h ^ (h >> 29))
    w, out = min(w, len(hashes)), []
    for i in range(len(hashes) - w + 1):
        least = min(hashes[i : i + w])
        at = max(j for j in range(i, i + w) if hashes[j] == least)
        if not out or out[-1][1] != at:
            out.append((hashes[at], at))
    return out


def test_marks_equal_the_definition():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab é\U0001f600\n") for _ in range(rng.randint(0, 50)))
        k, w = rng.randint(1, 9), rng.randint(1, 9)
        made = winnowing.marks(text, k, w)
        assert list(zip(made[0].tolist(), made[1].tolist(), strict=True)) == slow_marks(text, k, w)


def test_shared_pieces_share_a_mark_at_its_place():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for _ in range(200):
        piece = word(winnowing.K + winnowing.W - 1)
        a, b = word(rng.randint(0, 40)), word(rng.randint(0, 40))
        left, right = ({(int(h), int(p) - len(head)) for h, p in zip(*winnowing.marks(head + piece + word(30)), strict=True)} for head in (a, b))
        assert any(0 <= p <= winnowing.W - 1 for _, p in left & right)


def slow_neighbours(rows):
    """rows: (doc_id, text) in the order of the operator."""
    out = []
    k, w = winnowing.K, winnowing.W
    name = lambda m: hashlib.sha256(b"".join(h.to_bytes(8, "little") for h, _ in m) + b"".join(p.to_bytes(8, "little") for _, p in m)).hexdigest()

    def like(a, b):
        a, b = Counter(h for h, _ in a), Counter(h for h, _ in b)
        either = sum((a | b).values())
        return sum((a & b).values()) / either if either else 1.0

    for n, (one, text) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        third = len(text) // 3
        other = text[: len(text) - third] + after[:third]
        own, made, there = slow_marks(text, k, w), slow_marks(other, k, w), slow_marks(after, k, w)
        out.append((one, len(text), hashlib.sha256(other.encode()).hexdigest(), name(own), name(made), like(own, made), like(own, there)))
    return out


def plain(made):
    return sorted((tuple(r)[:7] for r in made.collect()), key=repr)


def test_winnow_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert plain(queries.QUERIES["op11_winnow"](spark, SF)) == sorted(slow_neighbours(sorted(rows, reverse=True)), key=repr)


def test_winnow_edge_rows(spark):
    kind = "doc_id long, text string, pid string, edge string, body string, tie string, spread string, n_chars string"
    clash = ("x",) * 6
    assert winnowing.neighbours(spark.createDataFrame([], kind)).count() == 0
    lone = plain(winnowing.neighbours(spark.createDataFrame([(1, "one lone text here", *clash)], kind)))
    assert lone == slow_neighbours([(1, "one lone text here")])
    hot = [(7, "the same row again and again")] * 400
    rows = [(9, "x" * 30_000), (8, None), *hot, (3, ""), (2, "a b"), (None, "no id")]
    made = plain(winnowing.neighbours(spark.createDataFrame([(*r, *clash) for r in rows], kind)))
    assert made == sorted(slow_neighbours([(a, b or "") for a, b in rows]), key=repr)
    marks = {r["doc_id"]: [(x["hash"] & MASK, x["position"]) for x in r["marks"]] for r in winnowing.fingerprints(spark.createDataFrame([(2, "some text, some text", *clash), (1, None, *clash)], kind)).collect()}
    assert marks == {2: slow_marks("some text, some text", winnowing.K, winnowing.W), 1: []}


# 12 prefix trie


def slow_trie(rows):
    """rows: (conv_id, turn, role, text), turns of a conversation in order."""
    own = {}
    for conv, _, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((role or "", text or ""))
    built = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        built[conv] = tuple(own.get(conv - conv % 5, [])[:h] + turns[h:])
    nodes = {}
    for conv, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(conv)
    children = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for path, members in nodes.items():
        worth = (len(members) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += worth
    ends = lambda path: hashlib.sha256(",".join(str(c) for c in sorted(nodes[path]) if len(built[c]) == len(path)).encode()).hexdigest()
    return sorted(
        ((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], ends(p)) for p, m in nodes.items()),
        key=repr,
    )


TURNS = "conv_id long, turn long, role string, text string"


def trie(spark, rows, slices=None):
    clash = {c: F.lit("x") for c in ("conv", "depth", "fp", "up", "v", "u", "pid", "idx", "spread", "h", "h1", "h2", "bytes")}
    return sorted((tuple(r) for r in prefix_trie.build_trie(spark.createDataFrame(rows, TURNS).withColumns(clash)).collect()), key=repr)


def test_trie_equals_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(60):
        rows += [(conv, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "é é"])) for t in range(rng.randint(1, 12))]
    rows = [r for r in rows if r[0] not in (10, 11, 20)]  # a base that is absent, and a member
    assert trie(spark, rows) == slow_trie(rows)


def test_trie_edge_rows(spark):
    assert trie(spark, []) == []
    odd = [(0, None, None, None), (0, 1, "user", ""), (1, 5, "user", "x" * 50_000), (None, 1, "user", "no conversation"), (3, 1, None, None), (12, 2, "user", "base absent"), (7, 1, "ab", "c"), (8, 1, "a", "bc")]
    assert trie(spark, odd) == slow_trie(odd)


def test_trie_of_a_hot_conversation(spark):
    """One conversation longer than a slice, twins of it, and a chain in which each hangs on the one before."""
    long = [(5, t, "user", f"turn {t % 7}") for t in range(900)] + [(c, t, "user", f"turn {t % 7}") for c in (105, 110) for t in range(900)]
    chain = [(1000 + 5 * c, t, "user", "same" if t < c else f"own {c}") for c in range(12) for t in range(c + 1)]
    assert trie(spark, long + chain) == slow_trie(long + chain)


def test_trie_survives_hash_collisions(spark, monkeypatch):
    """Under the first seed all turns have one hash: found out and built again."""
    true_hash = prefix_trie.hashed_turns
    monkeypatch.setattr(prefix_trie, "hashed_turns", lambda c, seed: true_hash(c, seed) if seed else true_hash(c, seed).withColumns({"h1": F.lit(1).cast("long"), "h2": F.lit(2).cast("long")}))
    rows = [(c, t, "user", f"{c % 2} {t}") for c in range(6) for t in range(3)]
    assert trie(spark, rows) == slow_trie(rows)


# 13 phrases


def slow_phrases(rows, support, top):
    """rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    out = []
    found = {key: a for key, a in f.items() if a >= support and len(key[1]) > 1}
    for (lang, p), a in found.items():
        inside = lambda long, p=p: any(long[i : i + len(p)] == p for i in range(len(long) - len(p) + 1))
        if any(x == lang and len(q) > len(p) and 100 * b >= 80 * a and inside(q) for (x, q), b in found.items()):
            continue
        cut = lambda k, p=p, lang=lang: (f[lang, p[:k]], f[lang, p[k:]])
        worst, k = min((2_000_000 * a // sum(cut(k)), k) for k in range(1, len(p)))
        out.append((lang, -worst, -a, " ".join(p).encode(), *cut(k)))
    made, rank = [], Counter()
    for lang, worst, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            made.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -worst))
    return sorted(made)


def phrases(spark, rows, support=30, top=2000):
    kind = "doc_id long, lang string, text string, shard string, phrase string, f string, n string, rank string"
    table = spark.createDataFrame([(k % 7 or None, *r, *("x",) * 5) for k, r in enumerate(rows)], kind)
    return sorted(tuple(r) for r in collocations.collocations(table, support, top).collect())


def test_phrases_equal_brute_force(spark):
    rng = random.Random(6)
    words = ["new", "York", "york", "é", "of", "the", "a b", "stock", "x1"]
    rows = [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice([" ", " ", "\t ", "  ", ". ", ",", "\n"]) for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    rows += [("en", None), ("fr", ""), ("en", rows[0][1])] * 3
    for support, top in ((30, 2000), (8, 20), (1, 100)):
        assert phrases(spark, rows, support, top) == slow_phrases(rows, support, top)


def test_phrases_of_long_and_hot_texts(spark, monkeypatch):
    """Blocks of a few bytes: words and phrases that lie across block ends count once."""
    monkeypatch.setattr(collocations, "BLOCK", 64)
    rng = random.Random(7)
    long = " ".join(rng.choice(["aa", "b", "cc,", "averyveryverylongwordthatislongerthanablockofsixtyfourbytesinthistest"]) for _ in range(3000))
    texts = [long.encode(), b"", b" ", b"x" * 500, b"a b c d"]
    for raw in texts:
        parts = list(collocations.cut_text(raw))
        assert b"".join(t[:own] for t, own in parts) == raw
    count = Counter()
    for text, own in collocations.cut_text(long.encode()):
        words = collocations.Words(text, own, 1)
        for n in range(1, 5):
            for at in words.windows(n).tolist():
                count[tuple(words.text[words.start[at + k] : words.end[at + k]].decode() for k in range(n))] += 1
    expected = Counter()
    for piece in long.split(","):
        words = piece.split()
        expected.update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    assert count == expected
    rows = [("en", "the same row of many")] * 300
    assert phrases(spark, rows) == slow_phrases(rows, 30, 2000)
    assert phrases(spark, []) == []


def test_filters_hold_every_key(spark):
    keys = [(i * 0x9E3779B97F4A7C15) & ((1 << 60) - 1) for i in range(1, 5000)]
    made = collocations.build_filter(spark.createDataFrame([(k,) for k in keys], "h long"))
    assert made.has(np.array(keys, dtype=np.uint64)).all()
    other = np.random.default_rng(1).integers(0, 1 << 60, 20_000).astype(np.uint64)
    assert made.has(other).mean() < 0.05
