import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from covermap import (
    advise, available_concepts, concept_rules, gap_report, match_needs, needed_concepts, rank_scenarios,
    scenario_cards, scenario_templates, scopes_without, score_templates, synthetic_fallbacks)


@pytest.fixture(scope="module")
def stand_in_advice(spark):
    return advise([make() for make in synthetic_fallbacks(spark).values()])


def concepts(spark, *names):
    return spark.createDataFrame([(name,) for name in names], "concept string")


def score(spark, template, *names):
    templates = scenario_templates(spark, [("t", "d", *template)])
    return score_templates(templates, concepts(spark, *names)).first()


# ---- fixed values: the published sentences and results of the demo tables ----
GOLDEN_GAPS = [
    "[수요 예측] 필요한 핵심 데이터가 모두 확보되어 있습니다.",
    "[고객 이탈 예측] 필요한 핵심 데이터가 모두 확보되어 있습니다.",
    "[배송 지연 예측] 필요한 핵심 데이터가 모두 확보되어 있습니다.",
    "[이상 거래 탐지] 'transaction_id' 데이터가 추가로 필요합니다.",
    "[재고 최적화] 필요한 핵심 데이터가 모두 확보되어 있습니다.",
    "[고객 세그멘테이션] 필요한 핵심 데이터가 모두 확보되어 있습니다.",
]


def test_golden_ranking(stand_in_advice):
    rows = stand_in_advice.ranking.collect()
    assert [(r.name, r.coverage_pct, r.readiness, r.missing_required) for r in rows] == [
        ("수요 예측", 100.0, "ready", []), ("고객 이탈 예측", 100.0, "ready", []),
        ("배송 지연 예측", 100.0, "ready", []), ("재고 최적화", 100.0, "ready", []),
        ("고객 세그멘테이션", 100.0, "ready", []), ("이상 거래 탐지", 66.7, "partial", ["transaction_id"])]


def test_golden_gap_texts(stand_in_advice):
    assert sorted(r.gap for r in stand_in_advice.gaps.collect()) == sorted(GOLDEN_GAPS)


def test_golden_concepts(stand_in_advice):
    found = {r.concept for r in stand_in_advice.available.collect()}
    assert found == {"customer_id", "order_date", "order_amount", "shipping_delay", "product_category", "signup_date",
                     "last_login_at", "total_spend", "region", "stock_qty", "reorder_point", "email"}
    unmatched = stand_in_advice.concept_map.where("matched_by = 'unmatched'").collect()
    assert {r["column"] for r in unmatched} == {"order_id", "sku", "warehouse_id", "unit_cost"}


def test_golden_nice_to_have(stand_in_advice):
    nice = {r.name: r.matched_nice for r in stand_in_advice.scored.collect()}
    assert nice == {"수요 예측": ["region"], "고객 이탈 예측": [], "배송 지연 예측": ["product_category"],
                    "이상 거래 탐지": [], "재고 최적화": ["order_date"], "고객 세그멘테이션": ["signup_date"]}


def test_cards(stand_in_advice):
    card = stand_in_advice.cards.where("name = '이상 거래 탐지'").first()
    assert (card.coverage_pct, card.readiness, card.description, card.gap) == (
        66.7, "데이터 보강 시 가능", "비정상적인 결제/거래 패턴 탐지", GOLDEN_GAPS[3])


@pytest.mark.parametrize("required, at_hand, coverage, readiness", [
    ([], [], 100.0, "ready"),
    (["a", "b"], ["a"], 50.0, "partial"),
    (["a", "b", "c"], ["a"], 33.3, "insufficient"),
    (["a", "a"], ["a"], 100.0, "ready"),
    (["a", "a", "b"], ["b"], 50.0, "partial"),
    (["a"], [], 0.0, "insufficient"),
    # 1999 of 4000 shows as 50.0 but is below one half.
    ([f"c{i}" for i in range(4000)], [f"c{i}" for i in range(1999)], 50.0, "insufficient"),
])
def test_coverage_and_readiness(spark, required, at_hand, coverage, readiness):
    row = score(spark, (required, []), *at_hand)
    assert (row.coverage_pct, row.readiness) == (coverage, readiness)


def test_a_concept_both_required_and_nice(spark):
    row = score(spark, (["a"], ["a", "b"]), "a", "b")
    assert (row.matched_required, row.matched_nice) == (["a"], ["a", "b"])


def test_null_template_lists_need_nothing(spark):
    row = score(spark, (None, None), "a")
    assert (row.coverage_pct, row.matched_required, row.missing_required, row.matched_nice) == (100.0, [], [], [])


def test_lists_are_sorted(spark):
    row = score(spark, (["z", "a", "M", "가"], ["n", "b"]), "z", "가", "M", "n", "b")
    assert (row.matched_required, row.missing_required, row.matched_nice) == (["M", "z", "가"], ["a"], ["b", "n"])


def test_gap_lists_all_that_is_missing(spark):
    scored = score_templates(scenario_templates(spark, [("t", "d", ["b", "a", "c"], [])]), concepts(spark, "c"))
    assert gap_report(scored).first().gap == "[t] 'a, b' 데이터가 추가로 필요합니다."


def test_names_with_percent_signs(spark):
    scored = score_templates(scenario_templates(spark, [("50%s", "d", ["%d"], [])]), concepts(spark))
    assert gap_report(scored).first().gap == "[50%s] '%d' 데이터가 추가로 필요합니다."


def test_needs(spark):
    templates = scenario_templates(spark, [("t", "d", ["a", "a"], ["b"]), ("u", "d", [], [])])
    rows = needed_concepts(templates).select("name", "concept", "required").collect()
    assert sorted(map(tuple, rows), key=str) == [("t", "a", True), ("t", "b", False), ("u", None, None)]
    have = match_needs(templates, concepts(spark, "a")).select("concept", "have").collect()
    assert sorted(map(tuple, have), key=str) == [("a", True), ("b", False), (None, False)]


def test_scopes_are_scored_apart_and_none_is_lost(spark):
    mapped = spark.createDataFrame(
        [("x", "a", 0.1), ("x", "b", 0.2), ("y", "b", 0.3), ("z", None, 0.0)],
        "tenant string, business_concept string, null_ratio double")
    templates = scenario_templates(spark, [("t", "d", ["a", "b"], []), ("u", "d", [], ["b"])])
    available = available_concepts(mapped, "tenant")
    scored = score_templates(templates, available, "tenant")
    found = {(r.tenant, r.name): (r.coverage_pct, r.missing_required, r.matched_nice, r.required_null_ratio)
             for r in scored.collect()}
    assert found == {
        ("x", "t"): (100.0, [], [], 0.2), ("x", "u"): (100.0, [], ["b"], None),
        ("y", "t"): (50.0, ["a"], [], 0.3), ("y", "u"): (100.0, [], ["b"], None)}
    # z supplies nothing, and is counted with each template.
    rest = scopes_without(templates, available, mapped, "tenant").orderBy("template_order")
    assert [tuple(r) for r in rest.collect()] == [(0, "t", 1, 0.0), (1, "u", 1, 100.0)]
    assert scenario_cards(scored).columns[0] == "tenant"


def test_a_null_scope_is_a_scope(spark):
    mapped = spark.createDataFrame([(None, "a", 0.1), ("x", "b", 0.2)], "tenant string, business_concept string, null_ratio double")
    templates = scenario_templates(spark, [("t", "d", ["a"], []), ("u", "d", ["a", "b"], [])])
    scored = score_templates(templates, available_concepts(mapped, "tenant"), "tenant")
    ranked = [(r.tenant, r.name, r.coverage_pct) for r in rank_scenarios(scored).collect()]
    assert ranked == [(None, "t", 100.0), (None, "u", 50.0), ("x", "u", 50.0)]


def test_a_null_is_no_concept(spark):
    scored = score_templates(scenario_templates(spark, [("t", "d", ["a", None], [None])]), concepts(spark, "a"))
    row = gap_report(scored).first()
    assert (row.coverage_pct, row.missing_required, row.gap) == (100.0, [], "[t] 필요한 핵심 데이터가 모두 확보되어 있습니다.")


def test_ranking_breaks_ties_by_template_order(spark):
    templates = scenario_templates(spark, [("low", "d", ["a"], []), ("one", "d", ["b"], []), ("two", "d", [], [])])
    ranked = rank_scenarios(score_templates(templates, concepts(spark, "b")))
    assert [r.name for r in ranked.collect()] == ["one", "two", "low"]


_concepts = st.lists(st.sampled_from("abcdef"), max_size=6)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(templates=st.lists(st.tuples(_concepts, _concepts), min_size=1, max_size=4), at_hand=_concepts)
def test_matches_the_definition(spark, templates, at_hand):
    library = scenario_templates(spark, [(f"t{i}", "d", *lists) for i, lists in enumerate(templates)])
    rows = score_templates(library, concepts(spark, *set(at_hand))).collect()
    assert len(rows) == len(templates)
    for row in rows:
        required, nice = map(set, templates[row.template_order])
        have, lack = required & set(at_hand), required - set(at_hand)
        assert (row.matched_required, row.missing_required, row.matched_nice) == (
            sorted(have), sorted(lack), sorted(nice & set(at_hand)))
        # In whole numbers: tenths of a percent times the number of needs, against a thousand times the finds.
        tenths = round(row.coverage_pct * 10)
        assert 2 * abs(tenths * len(required) - 1000 * len(have)) <= len(required)
        assert (row.readiness == "ready") == (not lack)
        assert (row.readiness == "insufficient") == (len(have) < len(lack))


def test_more_concepts_never_lower_coverage(spark):
    templates = scenario_templates(spark)
    names = ["order_date", "region", "customer_id", "stock_qty", "unrelated", "total_spend"]
    last = {}
    for count in range(len(names) + 1):
        now = {r.name: r.coverage_pct for r in score_templates(templates, concepts(spark, *names[:count])).collect()}
        assert all(now[name] >= last.get(name, 0.0) for name in now)
        last = now


def test_own_rules_and_templates(spark):
    from covermap import Source
    source = Source("s", "t", "t", spark.createDataFrame([(1, 2)], "plant int, yield int"))
    advice = advise([source], concept_rules(spark, {"output": ["yield"]}),
                    scenario_templates(spark, [("forecast", "d", ["output", "weather"], [])]), samples=False)
    assert [tuple(r) for r in advice.ranking.collect()] == [("forecast", 50.0, "partial", ["weather"])]
