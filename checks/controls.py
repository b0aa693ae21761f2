"""Control tables of the checks: rules that fit the given tables' names, and suggestions."""

from __future__ import annotations

from covermap import fixed_values as fixed

ALIGNED_RULES = {
    "customer_id": ["custkey", "user_id"],
    "order_date": ["orderdate"],
    "order_amount": ["totalprice", "extendedprice"],
    "product_category": ["p_type", "category"],
    "total_spend": ["acctbal"],
    "region": ["region"],
    "transaction_id": ["event_id"],
    "stock_qty": ["quantity"],
}
TEMPLATES = fixed.SCENARIO_TEMPLATES
# A trimmed one, one that loses to a rule, a blank one, one given twice, one outside the vocabulary.
SUGGESTIONS = [
    ("ts", "  last_login_at "),
    ("o_custkey", "total_spend"),
    ("lang", "   "),
    ("l_shipdate", "shipping_delay"),
    ("l_shipdate", "order_date"),
    ("html", "page_markup"),
]
