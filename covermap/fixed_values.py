"""Fixed values.

Everything in this module is a value that results depend on: name patterns, concept keywords,
scenario templates, message texts, setting names and the ranges of the stand-in tables. They are
stated as they must be, in their natural order; no logic lives here.
"""

# ---- fixed values: name patterns, searched in a column name without regard to case ----
PII_NAME = r"(email|e-mail|phone|tel|ssn|rrn|주민|address|주소|name|이름)"
TIME_NAME = r"(date|time|_at$|_dt$|일시|일자|날짜)"
ID_NAME = r"(_id$|^id$|_no$|_key$|번호)"

# ---- fixed values: thresholds and sizes ----
ID_CARDINALITY = 0.95      # a column above this share of distinct values ...
ID_DISTINCT = 20           # ... and above this many of them is taken for an identifier
SAMPLE_VALUES = 3
RATIO_DIGITS = 3
COVERAGE_DIGITS = 1
READY_AT = 100
PARTIAL_AT = 50
CONNECT_TIMEOUT_SECONDS = 10

# ---- fixed values: business concepts and their keywords; the order decides ties ----
CONCEPT_RULES = {
    "customer_id": ["customer_id", "cust_id", "고객id", "고객번호"],
    "order_date": ["order_date", "주문일", "주문일자"],
    "order_amount": ["order_amount", "amount", "금액", "매출"],
    "shipping_delay": ["shipping_delay", "delay", "배송지연"],
    "product_category": ["product_category", "category", "카테고리", "상품군"],
    "signup_date": ["signup_date", "가입일"],
    "last_login_at": ["last_login", "last_login_at", "최근로그인"],
    "customer_support_history": ["support", "ticket", "문의", "상담"],
    "total_spend": ["total_spend", "누적", "총구매", "ltv"],
    "region": ["region", "지역"],
    "stock_qty": ["stock_qty", "재고", "inventory_qty"],
    "reorder_point": ["reorder_point", "재주문", "안전재고"],
    "transaction_id": ["transaction_id", "거래id", "결제id"],
    "email": ["email", "이메일"],
}

# ---- fixed values: scenario templates (name, description, required concepts, nice-to-have concepts) ----
SCENARIO_TEMPLATES = [
    ("수요 예측", "과거 주문 추이로 향후 수요를 예측",
     ["order_date", "order_amount", "product_category"], ["region"]),
    ("고객 이탈 예측", "이탈 가능성이 높은 고객을 사전에 식별",
     ["customer_id", "last_login_at", "total_spend"], ["customer_support_history"]),
    ("배송 지연 예측", "주문 데이터로 배송 지연 가능성을 사전에 예측",
     ["order_date", "shipping_delay", "region"], ["product_category"]),
    ("이상 거래 탐지", "비정상적인 결제/거래 패턴 탐지",
     ["transaction_id", "order_amount", "customer_id"], []),
    ("재고 최적화", "재고 수준과 재주문 시점을 최적화",
     ["stock_qty", "reorder_point"], ["order_date"]),
    ("고객 세그멘테이션", "구매 패턴 기반 고객 그룹화 및 맞춤 마케팅",
     ["customer_id", "total_spend", "region"], ["signup_date"]),
]

# ---- fixed values: readiness labels and checklist texts ----
READINESS = {
    "ready": "즉시 구현 가능",
    "partial": "데이터 보강 시 가능",
    "insufficient": "데이터 대폭 보강 필요",
}
GAP_NONE = "[%s] 필요한 핵심 데이터가 모두 확보되어 있습니다."
GAP_MISSING = "[%s] '%s' 데이터가 추가로 필요합니다."

# ---- fixed values: settings read from the environment ----
RUNTIME_SETTING, RUNTIME_DEFAULT, LAKEHOUSE_RUNTIME = "RUNTIME_ENV", "local", "fabric"
SYSTEM_SETTINGS = {
    "postgres": {"host": "PG_HOST", "port": "PG_PORT", "database": "PG_DBNAME", "user": "PG_USER",
                 "password": "PG_DIAGNOSE_PASSWORD"},
    "mysql": {"host": "MYSQL_HOST", "port": "MYSQL_PORT", "database": "MYSQL_DATABASE", "user": "MYSQL_USER",
              "password": "MYSQL_DIAGNOSE_PASSWORD"},
    "mssql": {"host": "MSSQL_HOST", "port": "MSSQL_PORT", "database": "MSSQL_DATABASE", "user": "MSSQL_USER",
              "password": "MSSQL_DIAGNOSE_PASSWORD"},
    "hana": {"host": "HANA_HOST", "port": "HANA_PORT", "user": "HANA_USER", "userkey": "HANA_USERKEY",
             "password": "HANA_DIAGNOSE_PASSWORD"},
    "onelake": {"path": "ONELAKE_LAKEHOUSE_PATH"},
    "databricks": {"host": "DATABRICKS_HOST", "http_path": "DATABRICKS_HTTP_PATH", "password": "DATABRICKS_TOKEN"},
}
SETTING_DEFAULTS = {
    "PG_PORT": "5432",
    "PG_DBNAME": "postgres",
    "MYSQL_PORT": "3306",
    "MSSQL_PORT": "1433",
    "HANA_PORT": "30015",
}

# ---- fixed values: which system is tried first for each logical table, and the table read there ----
SOURCE_PRIORITY = {
    "orders": [("postgres", "orders"), ("mysql", "orders"), ("mssql", "orders"), ("onelake", "orders")],
    "customers": [("postgres", "customers"), ("onelake", "customers")],
    "inventory": [("hana", "INVENTORY"), ("databricks", "inventory")],
}

# ---- fixed values: stand-in tables ----
SYNTHETIC_LABELS = {"orders": "onelake", "customers": "onelake", "inventory": "databricks"}
SYNTHETIC_ROWS = {"orders": 500, "customers": 1200, "inventory": 300}
SYNTHETIC_SEEDS = {"orders": 42, "customers": 7, "inventory": 21}
SYNTHETIC_BASE_DAY = "2026-01-01"
# Whole numbers lie from the first up to but without the second; normal ones are given by mean and deviation.
ORDER_CUSTOMERS, ORDER_DAYS, ORDER_AMOUNT, ORDER_DELAYS = (1000, 1200), (0, 240), (85000, 30000), (0, 10)
FIRST_CUSTOMER, SIGNUP_DAYS_AGO, LOGIN_DAYS_AGO, CUSTOMER_SPEND = 1000, (30, 900), (0, 200), (500000, 150000)
WAREHOUSES, STOCK, REORDER_POINTS, UNIT_COST = (1, 6), (0, 500), (20, 100), (12000, 4000)
PRODUCT_CATEGORIES = ["전자", "의류", "식품", "생활용품"]
REGIONS = ["서울", "부산", "대구", "경기"]
