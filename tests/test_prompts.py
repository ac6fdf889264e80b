"""Plans of the golden prompts, and the rule tables."""

import pytest
from pyspark.sql import functions as F

from tonelake.plans.prompt import SIGNALS, plan_prompts, prompt_table, valid_limit, with_weights
from tonelake.rules import RULE_TABLES, default_rulebook

# prompt, clean, negated, keywords, genres, features, (emotion, acoustic) boost,
# weights without and with the audio signal
GOLDEN = [
    ("happy but not energetic", "happy", ["energetic"], "happy, joyful, positive", "", 8, (1.4, 0.7), (.3813, 0, .3033, 0, .3154), (.2207, .4213, .1755, 0, .1825)),
    ("sad rainy day", "sad rainy day", [], "sad rainy day, sad, melancholy, calm", "", 11, (1, 1), (.3667, 0, .4167, 0, .2167), (.2444, .3333, .2778, 0, .1444)),
    ("chill lofi", "chill lofi", [], "chill lofi, calm, chill, relaxing, study", "lofi, chill", 7, (.7, 1.4), (.2891, 0, .4599, .1314, .1196), (.2266, .2163, .3605, .1030, .0937)),
    ("hype workout", "hype workout", [], "hype workout, workout, energetic, hype", "", 4, (1, 1), (.4681, 0, .5319, 0, 0), (.2857, .3896, .3247, 0, 0)),
    ("romantic evening", "romantic evening", [], "romantic evening, relaxing, chill, calm", "", 7, (.7, 1.4), (.3328, 0, .5295, 0, .1377), (.2526, .2411, .4018, 0, .1045)),
    ("peaceful breeze", "peaceful breeze", [], "peaceful breeze", "", 0, (1, 1), (1, 0, 0, 0, 0), (.4231, .5769, 0, 0, 0)),
    ("chill but not sleepy", "chill", ["sleepy"], "chill, calm, relaxing", "chill", 7, (.7, 1.4), (.2891, 0, .4599, .1314, .1196), (.2266, .2163, .3605, .1030, .0937)),
    ("Epic orchestral music", "epic orchestral music", [], "epic orchestral music, anthemic, dramatic", "classical", 7, (.7, 1.4), (.3284, 0, .5224, .1493, 0), (.2500, .2386, .3977, .1136, 0)),
    ("r&b soul", "r&b soul", [], "r&b soul", "hip hop, r&b", 0, (1, 1), (.6875, 0, 0, .3125, 0), (.3548, .4839, 0, .1613, 0)),
    ("joyful", "joyful", [], "joyful", "", 8, (1, 1), (.3667, 0, .4167, 0, .2167), (.2444, .3333, .2778, 0, .1444)),
    ("joyful music", "joyful music", [], "joyful music", "", 0, (1, 1), (1, 0, 0, 0, 0), (.4231, .5769, 0, 0, 0)),
    ("not sad", "", ["sad"], "", "", 0, (1, 1), (1, 0, 0, 0, 0), (.4231, .5769, 0, 0, 0)),
    ("gaming", "gaming", [], "gaming, energetic, intense, hype", "", 4, (.7, 1.4), (.3328, 0, .5295, 0, .1377), (.2526, .2411, .4018, 0, .1045)),
]


@pytest.fixture(scope="module")
def plans(spark):
    rules = default_rulebook()
    df = plan_prompts(prompt_table(spark, [g[0] for g in GOLDEN]))
    count = sum(F.col(f"profile.{f}").isNotNull().cast("int") for f in rules.features)
    df = df.withColumn("n_features", count)
    plain = {r.query_id: r for r in with_weights(df, "false").collect()}
    clap = {r.query_id: r for r in with_weights(df, "true").collect()}
    return plain, clap


@pytest.mark.parametrize("i", range(len(GOLDEN)), ids=[g[0] for g in GOLDEN])
def test_golden_plan(plans, i):
    _, clean, negated, keywords, genres, features, boost, plain, clap = GOLDEN[i]
    row = plans[0][i]
    assert row.clean_query == clean
    assert row.negated == negated
    assert ", ".join(row.keywords) == keywords
    assert ", ".join(row.genres) == genres
    assert row.n_features == features
    assert (row.emotion_boost, row.acoustic_boost) == boost
    assert [round(row.weights[s], 4) for s in SIGNALS] == pytest.approx(list(plain), abs=1e-4)
    assert [round(plans[1][i].weights[s], 4) for s in SIGNALS] == pytest.approx(list(clap), abs=1e-4)


def test_merged_profile_keeps_first_of_equal_weights(plans):
    p = plans[0][0].profile
    assert (p.bpm.target, p.bpm.weight) == (122.0, 0.5)
    assert (p.arousal.target, p.brightness.target, p.mfcc1.target) == (0.72, 3700.0, 107.0)
    e = plans[0][0].emotions
    assert (e.joy, e.surprise, e.neutral, e.anger) == (1.0, 0.3, 0.3, None)


def test_rule_table_sizes(spark):
    rules = default_rulebook()
    rows = {t: len(rules.rows(t)[0]) for t in RULE_TABLES}
    assert rows["synonyms"] == 285 and len(rules.synonyms) == 99
    assert rows["genre_keywords"] == 81 and len(rules.genres) == 20
    assert rows["profiles"] == 227 and len(rules.profiles) == 44
    assert rows["emotion_targets"] == 66 and len(rules.emotion_targets) == 30
    assert rows["negation_words"] == 15 and rows["key_profiles"] == 288
    assert rules.frame(spark, "synonyms").filter("term = 'gaming'").orderBy("kw_ord").first().keyword == "energetic"


def test_edge_prompts(spark):
    rows = plan_prompts(prompt_table(spark, ["but", "", "rock, not metal", "Night Drive NOT chill no sad", "lo-fi"])).collect()
    got = {r.query_id: r for r in rows}
    assert (got[0].clean_query, got[0].negated) == ("", [])
    assert (got[1].clean_query, got[1].keywords) == ("", [""])
    assert (got[2].clean_query, got[2].genres, got[2].negated) == ("rock,", ["rock"], ["metal"])
    assert got[3].clean_query == "night drive" and got[3].negated == ["chill", "sad"]
    assert got[3].keywords == ["night drive", "chill", "calm", "melancholy", "driving_night"]
    assert got[4].keywords == ["lo-fi"] and got[4].genres == []


def test_limits(spark):
    df = spark.createDataFrame([(None,), (0,), (7,)], "n int").select(valid_limit(F.col("n")).alias("n"))
    assert [r.n for r in df.collect()] == [20, 20, 7]
    with pytest.raises(Exception, match="negative"):
        spark.createDataFrame([(-1,)], "n int").select(valid_limit(F.col("n")).alias("n")).collect()


def test_planning_is_narrow(spark):
    plan = plan_prompts(prompt_table(spark, ["sad"])).repartition(2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
