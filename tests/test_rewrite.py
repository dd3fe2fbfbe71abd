from pyspark.sql import functions as F

from veilscan.operators import rewrite as RW
from veilscan.plans.fixtures import PROMPT_FIXTURES

WORDY = dict(PROMPT_FIXTURES)[-1]


def _df(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, text STRING")


def test_levels_nest_and_save(spark):
    toks = {}
    for lv in RW.LEVELS:
        r = RW.compress_prompt(_df(spark, [WORDY]), level=lv).collect()[0]
        toks[lv] = r.compressed_tokens
        if lv == "aggressive":
            assert 10 < r.percent_saved < 60
    assert toks["light"] >= toks["medium"] >= toks["aggressive"] >= toks["caveman"]


def test_code_fences_untouched(spark):
    text = dict(PROMPT_FIXTURES)[-3]
    for lv in ("light", "medium", "aggressive"):
        r = RW.compress_prompt(_df(spark, [text]), level=lv).collect()[0]
        assert "could you please keep this comment" in r.compressed_text
        assert r.preserved_code_blocks == 1


def test_soft_opener_removed_and_recapitalised(spark):
    r = RW.compress_prompt(_df(spark, [dict(PROMPT_FIXTURES)[-2]]), level="medium").collect()[0]
    assert r.compressed_text == "Draft a short table of the hotels that lie near the harbour"


def test_caveman_drops_articles(spark):
    r = RW.compress_prompt(_df(spark, ["Show me the file the user opened on the desktop."]), level="caveman").collect()[0]
    assert " the " not in f" {r.compressed_text.lower()} "


def test_flags(spark):
    df = _df(spark, ["pg tighten this please", "pg! Show me the file", "pg ", "pgadmin is down"])
    out = RW.compress_for_send(df).orderBy("id").collect()
    assert out[0].flag.level == "medium" and out[0].outcome is not None
    assert out[1].flag.level == "caveman"
    assert out[2].outcome is None
    assert out[3].flag is None


def test_optimize_short_and_concise(spark):
    o = RW.optimize_prompt(_df(spark, ["hi", "Write Python function for prime numbers and return a list."])).orderBy("id").collect()
    assert o[0].reason == RW.REASON_SHORT and o[0].tokens_saved == 0
    assert o[1].should_suggest is False
