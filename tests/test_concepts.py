import string

from hypothesis import HealthCheck, given, settings, strategies as st

from covermap import (
    available_concepts, concept_rules, list_columns, map_concepts, match_rules, profile_table, Source, suggest,
    unmatched_columns)
from covermap import fixed_values as fixed


def columns(spark, *names):
    return spark.createDataFrame([(name,) for name in names], "column string")


def matched(spark, names, rules=fixed.CONCEPT_RULES):
    found = match_rules(columns(spark, *names), concept_rules(spark, rules)).collect()
    return {row["column"]: row["concept"] for row in found}


def lowest_hits(names, rules):
    """Of all (rule number, name) pairs in which the name holds one of the rule's keywords, each name's lowest."""
    listing = [(number, name) for number, words in enumerate(rules.values()) for word in words
               for name in names if word.casefold() in name.casefold()]
    concepts = list(rules)
    return {name: concepts[min(n for n, other in listing if other == name)] for _, name in listing}


def test_every_builtin_keyword_finds_its_first_concept(spark):
    words = [word for keywords in fixed.CONCEPT_RULES.values() for word in keywords]
    names = words + [f"x_{word.upper()}_y" for word in words] + ["nothing", ""]
    assert matched(spark, names) == lowest_hits(names, fixed.CONCEPT_RULES)


def test_rule_order_decides_not_keyword_length(spark):
    assert matched(spark, ["customer_id_region", "DISCOUNT_AMOUNT", "region_delay"]) == {
        "customer_id_region": "customer_id", "DISCOUNT_AMOUNT": "order_amount", "region_delay": "shipping_delay"}


def test_one_keyword_in_two_rules(spark):
    assert matched(spark, ["abc"], {"late": ["zz"], "first": ["b"], "second": ["B", "abc"]}) == {"abc": "first"}


def test_empty_keyword_matches_everything(spark):
    assert matched(spark, ["abc", ""], {"any": [""]}) == {"abc": "any", "": "any"}


def test_no_rules(spark):
    assert matched(spark, ["abc"], {}) == {}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(names=st.lists(st.text(alphabet="abAB_주문", max_size=9), min_size=1, max_size=12, unique=True),
       words=st.lists(st.lists(st.text(alphabet="abB_주", min_size=1, max_size=3), max_size=3), max_size=5))
def test_matches_the_definition(spark, names, words):
    rules = {string.ascii_lowercase[i]: keywords for i, keywords in enumerate(words)}
    assert matched(spark, names, rules) == lowest_hits(names, rules)


def test_suggestions_fill_only_what_rules_leave(spark):
    offered = spark.createDataFrame(
        [("region", "other"), ("ts", "  last_login_at "), ("blank", "   "), ("none", None), ("twice", "b"),
         ("twice", "a"), ("twice", ""), ("odd", "made_up")], "column string, concept string")
    names = columns(spark, "region", "ts", "blank", "none", "twice", "odd", "silent")
    result = {row["column"]: (row.business_concept, row.matched_by)
              for row in map_concepts(names, concept_rules(spark), offered).collect()}
    assert result == {
        "region": ("region", "rule"), "ts": ("last_login_at", "suggested"), "blank": (None, "unmatched"),
        "none": (None, "unmatched"), "twice": ("a", "suggested"), "odd": ("made_up", "suggested"),
        "silent": (None, "unmatched")}
    strict = {row["column"]: row.matched_by
              for row in map_concepts(names, concept_rules(spark), offered, restrict_to_vocabulary=True).collect()}
    assert strict["ts"] == "suggested" and strict["odd"] == "unmatched"


def test_map_keeps_every_row_and_column(spark):
    profile = profile_table(spark.createDataFrame([(1, 2)], "customer_id int, customer_id2 int"), "s", "t", "t")
    twice = profile.unionByName(profile)
    mapped = map_concepts(twice, concept_rules(spark))
    assert mapped.columns == profile.columns + ["business_concept", "matched_by"]
    assert [row.business_concept for row in mapped.collect()] == ["customer_id"] * 4


def test_suggest_asks_once_per_name_and_only_for_the_unmatched(spark):
    df = spark.createDataFrame([("x", 1, 2)], "mystery string, region int, other int")
    profile = profile_table(df, "a", "t", "t").unionByName(profile_table(df, "b", "t", "t"))
    mapped = map_concepts(profile, concept_rules(spark))
    asked = suggest(unmatched_columns(mapped), lambda name, samples: f"{name}:{','.join(samples)}", parallelism=2)
    assert sorted(map(tuple, asked.collect())) == [("mystery", "mystery:x"), ("other", "other:2")]
    filled = map_concepts(profile, concept_rules(spark), asked)
    assert filled.where("matched_by = 'suggested'").count() == 4


def test_suggest_may_decline(spark):
    profile = profile_table(spark.createDataFrame([(1,)], "mystery int"), "a", "t", "t")
    asked = suggest(profile, lambda name, samples: None)
    assert [tuple(row) for row in asked.collect()] == [("mystery", None)]
    assert map_concepts(profile, concept_rules(spark), asked).first().matched_by == "unmatched"


def test_available_concepts_with_evidence(spark):
    mapped = spark.createDataFrame(
        [("a", "x", 0.5), ("a", "x", 0.25), ("b", "x", 1.0), ("b", None, 0.0)],
        "source_name string, business_concept string, null_ratio double")
    assert [tuple(r) for r in available_concepts(mapped).collect()] == [("x", 3, 0.25)]
    per_source = available_concepts(mapped, "source_name").collect()
    assert sorted(map(tuple, per_source)) == [("a", "x", 2, 0.25), ("b", "x", 1, 1.0)]


def test_schema_alone_is_enough_to_map(spark, plan_of):
    """Without a profile no table is read: the listing is a local relation."""
    sources = [Source("customer", "parquet", "customer", spark.read.parquet("/root/testdata/sf0.001/customer.parquet"))]
    mapped = map_concepts(list_columns(sources), concept_rules(spark, {"customer_id": ["custkey"]}))
    assert "FileScan" not in plan_of(mapped)
    assert [tuple(r) for r in available_concepts(mapped).collect()] == [("customer_id", 1)]
