from pyspark.sql import functions as F

from veilscan.operators import scan as S
from veilscan.plans.fixtures import fixture_rows


def _texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING")


def _hits(spark, text):
    rows = S.scan_text(_texts(spark, [(1, text)])).select("rule_id", "start", "end", "matched").collect()
    return [(r.rule_id, r.matched) for r in rows], rows


def test_offsets_match_substrings(spark):
    rows = fixture_rows()
    got = S.scan_text(_texts(spark, rows)).select("doc_id", "start", "end", "matched").collect()
    texts = dict(rows)
    assert got
    for r in got:
        assert texts[r.doc_id][r.start:r.end] == r.matched


def test_every_rule_fires_on_fixtures(spark):
    from veilscan.functions.rules import ALL_RULES
    ids = {r.rule_id for r in S.scan_text(_texts(spark, fixture_rows())).select("rule_id").distinct().collect()}
    assert ids == {r.id for r in ALL_RULES}


def test_upi_and_email_are_exclusive(spark):
    hits, _ = _hits(spark, "mail " + "alice" + "@example.com and pay " + "alice" + "@paytm now")
    assert ("email_address", "alice@example.com") in hits
    assert ("india_upi_id", "alice@paytm") in hits
    assert ("india_upi_id", "alice@example") not in hits


def test_reserved_ssn_and_snowflake_rejected(spark):
    hits, _ = _hits(spark, "ssn 000-12-3456 id 2060000000000000001 and 1234 5678 9012 3456")
    assert not [h for h in hits if h[0] in ("us_ssn", "credit_card")]


def test_ascii_word_boundary_and_nbsp(spark):
    # the card match keeps its trailing space: a word follows, so the boundary sits after it
    hits, _ = _hits(spark, "é4785380592391139 call 415\u00a0555\u00a00199")
    assert ("credit_card", "4785380592391139 ") in hits
    assert ("us_phone_number", "415\u00a0555\u00a00199") in hits


def test_card_match_may_end_in_separator(spark):
    hits, rows = _hits(spark, "card 4242 4242 4242 4242 now")
    assert ("credit_card", "4242 4242 4242 4242 ") in hits


def test_redact_and_null_text(spark):
    df = _texts(spark, [(1, "x " + "bob" + "@example.org y"), (2, None), (3, "")])
    out = {r.doc_id: r.redacted for r in S.redact(df).collect()}
    assert out[1] == "x [REDACTED:email_address] y"
    assert out[2] is None and out[3] == ""


def test_dedupe_contained_drops_email_inside_connection_string(spark):
    text = "mongodb+srv://" + "user:" + "secretpw" + "@host.example.com/db"
    df = _texts(spark, [(1, text)])
    raw = {r.rule_id for r in S.scan_text(df).collect()}
    ded = {r.rule_id for r in S.scan_text_deduped(df).collect()}
    assert "db_connection_string" in ded
    assert ded <= raw


def test_gate_threshold(spark):
    df = _texts(spark, [(1, "mail a" + "@example.com"), (2, "card 4242" + " 4242 4242 4242"), (3, "nothing")])
    g = {r.doc_id: (r.worst_rank, r.gate_failed) for r in S.gate(df, threshold="high").collect()}
    assert g[1] == (2, False) and g[2] == (4, True) and g[3] == (0, False)
