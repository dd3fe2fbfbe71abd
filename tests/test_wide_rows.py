"""Rows with many hits or tools: the same answer as the pairwise definition, in linear time."""
import json
import random
import time
from collections import Counter

from pyspark.sql import functions as F

from veilscan.functions.containment import uncontained
from veilscan.functions.rules import ALL_RULES, RULE_ORD
from veilscan.operators import pins as PN
from veilscan.operators import scan as S
from veilscan.operators import tooldocs as TD


def pairwise(matches, ranks):
    return [k for k, (m, r) in enumerate(zip(matches, ranks)) if not any(q >= r and len(o) > len(m) and m in o for o, q in zip(matches, ranks))]


def test_automaton_equals_all_pairs():
    rng = random.Random(1)
    for size in (0, 1, 2, 20, 200):
        for letters in ("ab", "abcdé😀"):
            matches = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(size)]
            ranks = [rng.randint(1, 4) for _ in matches]
            assert uncontained(matches, ranks) == pairwise(matches, ranks)


def hit_rows(spark, counts):
    """One row of hits for each count: addresses, some inside longer matches."""
    email, link = RULE_ORD["email_address"], RULE_ORD["db_connection_string"]
    rows = []
    for d, count in enumerate(counts):
        hits = [(email, k, k + 1, f"user{k}@host{k % 7}.example") for k in range(count - count // 8)]
        hits += [(link, k, k + 1, f"db://user{k * 3}@host{k * 3 % 7}.example/x") for k in range(count // 8)]
        rows.append((d, hits))
    return spark.createDataFrame(rows, f"doc_id BIGINT, _hits {S.HIT_TYPE}")


def test_contained_hits_of_wide_rows(spark, monkeypatch):
    few = hit_rows(spark, [0, 1, 40, 300])
    got = {r.doc_id: [tuple(h) for h in r["_hits"]] for r in S.drop_contained(few).collect()}
    plain = {r.doc_id: [tuple(h) for h in r["x"]] for r in few.select("doc_id", F.expr(S.contained_sql("_hits")).alias("x")).collect()}
    assert got == plain and len(got[3]) < 300
    untouched = S.drop_contained(few, where=F.col("doc_id") < 3).where("doc_id = 3").first()
    assert len(untouched["_hits"]) == 300
    ranks = [r.rank for r in ALL_RULES]
    spent = []
    for count in (8_000, 16_000):
        hits = hit_rows(spark, [count]).first()["_hits"]
        best = min(timed(lambda: uncontained([h.m for h in hits], [ranks[h.rule_ord] for h in hits])) for _ in range(3))
        spent.append(best)
    assert spent[1] < 3 * spent[0] and spent[1] < 1


def timed(work):
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def tool_doc(spark, count):
    names = [f"tool{k % (count // 2)}" if k % 5 else "same" for k in range(count)]
    raw = json.dumps({"mcpServers": {"s": {"tools": [{"name": n, "description": str(k)} for k, n in enumerate(names)]}}})
    docs = spark.createDataFrame([("p", 1, raw), ("q", 2, "{}"), ("r", 3, '{"tools": [{"name": 5}, {}, {"name": "x"}]}')], "config_path STRING, doc_id BIGINT, raw STRING")
    return names, TD.parse_documents(docs)


def test_wide_tool_documents(spark):
    names, docs = tool_doc(spark, 8_000)
    pins = {r.description: r.key for r in PN.collect_tools(docs).where("config_path = 'p'").collect()}
    seen = Counter()
    for k, n in enumerate(names):
        assert pins[str(k)] == f"s/{n}" + (f"#{seen[n]}" if seen[n] else "")
        seen[n] += 1
    assert sorted(r.key for r in PN.collect_tools(docs).where("config_path = 'r'").collect()) == ["(root)/(unnamed)", "(root)/(unnamed)#1", "(root)/x"]
    shadow = {r.title.split('"')[1]: r for r in TD.shadowing_findings(docs).collect()}
    assert set(shadow) == {n for n, c in seen.items() if c > 1}
    same = shadow["same"]
    assert same.location == ", ".join(f"s.tools[{k}]" for k, n in enumerate(names) if n == "same") and str(seen["same"]) in same.evidence
