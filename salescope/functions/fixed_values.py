"""Fixed values.

Word lists, lookup tables, prices and limits that decide results. They are data,
not logic: changing one changes what the operators return.
"""

# Standard sales columns and the names each is recognised by.
STANDARD_COLUMNS = {
    "date": ["date", "day", "transaction_date", "sale_date", "created_at", "order_date", "invoice_date", "timestamp"],
    "customer": ["customer", "client", "account", "id", "buyer", "user", "user_id", "customer_id", "account_id"],
    "product": ["product", "plan", "item", "sku", "product_id", "service", "subscription"],
    "region": ["region", "market", "geo", "country", "city", "state", "territory", "area", "zone"],
    "revenue": ["revenue", "rev", "sales", "income", "turnover", "amount", "price", "value", "total", "sum"],
    "cost": ["cost", "expense", "cogs", "spend", "expenditure", "expenses", "costs", "fee"],
    "currency": ["currency", "curr", "currency_code", "currency_symbol"],
    "quantity": ["quantity", "qty", "units", "count", "volume", "number", "amount_units"],
    "payment_status": ["payment_status", "status", "payment", "pay_status", "order_status", "transaction_status"],
    "notes": ["notes", "comment", "remarks", "note", "comments", "description", "details", "additional_info"],
    "profit": ["profit", "gross_profit", "net_profit", "earnings", "income_after_costs"],
}
FUZZY_CUTOFF = 0.8

# Name fragments that stand for revenue and cost in an unmapped table.
REVENUE_NAME_HINTS = ["revenue", "sales", "rev", "income", "turnover", "amount"]
COST_NAME_HINTS = ["cost", "expense", "cogs", "spend", "expenditure", "expenses"]
ASSUMED_COST_SHARE = 0.6
ASSUMED_MARGIN = 0.4

# Currency symbols, known codes, and rates to USD.
CURRENCY_SYMBOLS = {
    "$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "₽": "RUB", "₩": "KRW", "₺": "TRY",
}
RATES_TO_USD = {
    "USD": 1.0, "EUR": 1.18, "GBP": 1.38, "JPY": 0.0091, "CAD": 0.79, "AUD": 0.72, "CHF": 1.12,
    "CNY": 0.15, "INR": 0.012, "HKD": 0.13, "SGD": 0.74, "NZD": 0.68, "KRW": 0.00076, "MXN": 0.058,
    "BRL": 0.19, "RUB": 0.011, "ZAR": 0.054, "TRY": 0.031, "SEK": 0.096, "NOK": 0.095, "DKK": 0.16,
    "PLN": 0.25, "CZK": 0.044, "HUF": 0.0028, "ILS": 0.27, "SAR": 0.27, "AED": 0.27,
}
# Code, prefix, words inside the text.
CURRENCY_WORDS = [
    ("USD", "US", ["DOLLAR"]),
    ("EUR", "EU", ["EURO"]),
    ("GBP", "GB", ["POUND", "STERLING"]),
    ("JPY", "JP", ["YEN"]),
    ("INR", "IN", ["RUPEE"]),
]

# Input limits.
MIN_ROWS = 5
MAX_TEXT_LENGTH = 10_000
MAX_COLUMNS = 1_000
MAX_UNMAPPED_SHARE = 0.3

# Date forms beyond ISO: what they look like and how they are read.
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
]
NAMED_DATE_FORMAT = {r"^\d{1,2} [A-Z][a-z]{2} \d{4}$": "d MMM yyyy"}
NUMERIC_DATE_FORMATS = {
    r"^\d{4}/\d{1,2}/\d{1,2}$": "yyyy/M/d",
    r"^\d{8}$": "yyyyMMdd",
}
# Numeric dates whose order of day and month is a matter of convention: (month first, day first).
AMBIGUOUS_DATE_FORMATS = {
    r"^\d{1,2}/\d{1,2}/\d{4}$": ("M/d/yyyy", "d/M/yyyy"),
}

# Months of history a model needs.
MIN_MONTHS_FORECAST = 12
MIN_MONTHS_SEASONAL = 24
MIN_MONTHS_PRODUCT = 3
SEASONAL_STRENGTH_MARK = 0.3

# Price per 1,000 tokens: input, output.
TOKEN_PRICES = {
    "gpt-4o-mini": (0.00015, 0.0006),
    "gpt-4o": (0.005, 0.015),
    "gpt-3.5-turbo": (0.0005, 0.0015),
    "gpt-4-turbo": (0.01, 0.03),
    "o1-mini": (0.003, 0.012),
    "o1-preview": (0.015, 0.06),
    "claude-3-opus": (0.015, 0.075),
    "claude-3-sonnet": (0.003, 0.015),
    "claude-3-haiku": (0.00025, 0.00125),
    "gemini-pro": (0.0005, 0.0015),
}
DEFAULT_PRICED_MODEL = "gpt-4o-mini"
# Flat price per 1,000 tokens used for call statistics.
FLAT_TOKEN_PRICES = {
    "gpt-4o-mini": 0.00015,
    "gpt-4o": 0.005,
    "gpt-3.5-turbo": 0.0005,
    "o1-mini": 0.003,
    "o1-preview": 0.015,
}

# Operation marks.
SLOW_SECONDS = 5.0
HIGH_ERROR_RATE = 0.1

# Keys whose values are hidden in audit details.
SENSITIVE_KEYS = ["password", "token", "api_key", "secret", "key", "authorization", "auth", "credential", "private"]
REDACTED = "[REDACTED]"
GENESIS_HASH = "0" * 64

# Failure handling.
SIMILAR_MESSAGE_CHARS = 100
SHOWN_COLUMNS = 10
SUMMARY_CHARS = 200
SIMILAR_HOURS = 24
MIN_SIMILAR_FAILURES = 3
AUTO_APPLY_CONFIDENCE = 0.85
AUTO_APPLY_COUNT = 5
# Smallest group an A/B percentile is given for.
AB_P95_MIN_ROWS = 20

# Advice per error type; %s is the name quoted in the message, then further details.
FIX_TEXTS = {
    "KeyError": "Check if column '%s' exists. Use df.columns to list available columns.",
    "KeyError, up to 10 columns": "Column '%s' not found. Available columns: %s. Check column name spelling.",
    "KeyError, more columns": "Column '%s' not found. Available columns (first 10): %s...",
    "ValueError, date": "Invalid date format. Use pd.to_datetime() with errors='coerce' to handle invalid dates.",
    "ValueError, number": "Invalid numeric value. Use pd.to_numeric() with errors='coerce' to convert or handle non-numeric values.",
    "ValueError": "Validate input data types and formats. Use try/except to handle expected edge cases.",
    "TypeError, none": "Encountered None value. Add null checks before processing. Use .fillna() or handle None cases.",
    "TypeError": "Check data types. Use pd.to_numeric() for numbers, astype() for type conversion, or verify input types.",
    "AttributeError, known type": "'%s' not found on %s. Check available attributes with dir(object).",
    "AttributeError": "Check if object has '%s' attribute. Verify data structure and object type.",
    "IndexError": "List/array index out of range. Check length before accessing by index, or use slicing with bounds checking.",
    "ZeroDivisionError": "Division by zero detected. Add check for zero denominator: if denominator == 0: return 0 or handle appropriately.",
    "FileNotFoundError": "File not found. Verify file path exists, check working directory with os.getcwd(), and ensure file permissions.",
    "PermissionError": "Permission denied. Check file/directory permissions, close any open handles, or run with appropriate privileges.",
    "ImportError": "Missing module '%s'. Install with: pip install %s",
    "MemoryError": "Out of memory. Consider processing data in chunks, using more efficient data types, or increasing available memory.",
    "TimeoutError": "Operation timed out. Consider increasing timeout, optimizing the operation, or implementing retry logic.",
    "ConnectionError": "Connection error. Check network connectivity, verify service is running, and implement retry with backoff.",
}
DATE_ERROR_WORDS = ["date"]
NUMBER_ERROR_WORDS = ["numeric", "float", "int"]
NONE_ERROR_WORDS = ["nonetype"]

# Stored key figures and the category each belongs to.
KPI_CATEGORIES = {
    "total_revenue": "revenue",
    "total_profit": "profit",
    "profit_margin": "margin",
    "avg_order_value": "revenue",
    "total_transactions": "count",
    "total_customers": "count",
}
INSIGHT_CONFIDENCE = {"answer": 0.9, "summary": 0.85, "anomaly": 0.7, "recommendation": 0.75}
DEFAULT_ANSWER = "Analysis complete."

# Question types in order of priority, and the words that speak for each.
QUESTION_WORDS = {
    "forecast": [
        "forecast", "predict", "future", "will be", "will look", "projection", "estimate", "expected", "anticipate",
        "next year", "coming year", "2025", "2026", "2027", "q1", "q2", "q3", "q4", "quarter", "first quarter",
        "second quarter", "third quarter", "fourth quarter", "most likely", "likely to be", "projected", "outlook",
    ],
    "risk": [
        "risk", "risks", "concern", "threat", "vulnerability", "danger", "issue", "problem", "challenge", "exposure",
        "downside", "warning", "alert", "red flag", "critical", "urgent", "at risk", "vulnerable", "anomaly",
        "anomalies", "outlier", "outliers", "unusual", "strange", "weird",
    ],
    "performance": [
        "performance", "overview", "dashboard", "summary", "how is", "how are", "doing", "health", "status",
        "business performance", "company performance", "metrics", "kpi", "kpis", "scorecard", "health check", "snapshot",
    ],
    "revenue_analysis": [
        "revenue", "sales", "profit", "income", "earnings", "product", "customer", "region", "top", "best", "worst",
        "ranking", "rank", "trend", "growth", "decline", "revenue breakdown", "revenue by", "sales by", "total revenue",
        "average revenue", "revenue growth", "show", "tell", "what is", "how much", "calculate", "sum", "total",
        "average", "count",
    ],
    "customer_analysis": [
        "customer", "client", "buyer", "account", "customer behavior", "purchase pattern", "retention", "churn",
        "lifetime value", "ltv", "acquisition", "customer segment", "customer group",
    ],
    "product_analysis": [
        "product", "item", "sku", "inventory", "stock", "product performance", "product success", "product health",
        "product category", "product line",
    ],
}
CONTEXT_WORDS = [
    "revenue", "sales", "profit", "customer", "product", "region", "trend", "growth", "decline", "forecast", "predict",
    "anomaly", "kpi", "metric", "performance", "show", "tell", "what", "how", "which", "when", "where", "total",
    "average", "sum", "count", "calculate", "compute",
]
FORECAST_INTENT = ["forecast", "predict", "future", "will be", "project", "estimate", "expected", "anticipate", "outlook"]
RISK_INTENT = [
    "risk", "concern", "threat", "danger", "issue", "problem", "challenge", "warning", "alert", "anomaly", "outlier",
    "unusual", "strange",
]

# Time periods, specific before general; {n} is the n-th captured group.
QUARTER_NUMBERS = {"first": "Q1", "second": "Q2", "third": "Q3", "fourth": "Q4"}
PERIODS = [
    (r"Q([1-4])\s*(\d{4})", "Q{1} {2}"),
    (r"(first|second|third|fourth)\s+quarter\s+of\s+(\d{4})", "{quarter} {2}"),
    (r"first\s+half\s+of\s+(\d{4})", "H1 {1}"),
    (r"second\s+half\s+of\s+(\d{4})", "H2 {1}"),
    (r"(\d{4})\s*-\s*(\d{4})", "{1}-{2}"),
    (r"(\d{4})\s+to\s+(\d{4})", "{1}-{2}"),
    (r"\b(20\d{2})\b", "{1}"),
    (r"next\s+(\d+)\s+months?", "next {1} months"),
    (r"next\s+(\d+)\s+quarters?", "next {1} quarters"),
    (r"next\s+quarter", "next_quarter"),
    (r"this\s+year", "this_year"),
    (r"this\s+quarter", "this_quarter"),
    (r"current\s+year", "this_year"),
    (r"current\s+quarter", "this_quarter"),
    (r"next\s+year", "next_year"),
    (r"the\s+coming\s+year", "next_year"),
    (r"next\s+month", "next_month"),
    (r"last\s+month", "last_month"),
    (r"last\s+quarter", "last_quarter"),
    (r"last\s+year", "last_year"),
    (r"previous\s+quarter", "last_quarter"),
    (r"previous\s+year", "last_year"),
]

# What makes a question a link, noise, small talk or business.
LINK_PATTERNS = [
    r"https?://", r"www\.", r"\.com\b", r"\.ie\b", r"\.net\b", r"\.org\b", r"\.io\b", r"google\.com",
    r"docs\.google\.com", r"spreadsheets/d/", r"edit\?gid=", r"/d/e/", r"github\.com", r"bit\.ly", r"tinyurl\.com",
    r"cloudflare\.com", r"amazonaws\.com",
]
NOISE_PATTERNS = [
    r"^[a-z]{10,}$", r"^[0-9]{8,}$", r"^[a-z0-9]{12,}$", r"^[^\p{L}\p{N}_\s]{4,}", r"^[a-z]{1,3}$", r"^[0-9]+$",
]
SMALL_TALK = [
    "how are you", "how are you doing", "how are things", "how is it going", "what's up", "whats up", "hello",
    "hi there", "hey there", "good morning", "good afternoon", "good evening", "nice to meet you", "thank you",
    "thanks", "appreciate it", "you're welcome", "how was your day", "have a good day", "take care", "see you later",
]
BUSINESS_WORDS = [
    "revenue", "sales", "profit", "income", "earnings", "turnover", "cost", "expense", "margin", "price", "value",
    "amount", "total", "sum", "average", "mean", "median", "kpi", "metric", "customer", "client", "buyer", "account",
    "user", "subscription", "retention", "churn", "acquisition", "lifetime", "ltv", "product", "item", "service",
    "plan", "sku", "category", "inventory", "stock", "demand", "popular", "best", "top", "worst", "ranking", "rank",
    "trend", "growth", "decline", "increase", "decrease", "change", "month", "year", "quarter", "weekly", "daily",
    "time", "period", "seasonal", "forecast", "predict", "future", "projection", "region", "market", "geo",
    "location", "country", "city", "area", "territory", "zone", "performance", "efficiency", "conversion", "rate",
    "ratio", "percentage", "share", "market share", "health", "risk", "danger", "threat", "issue", "problem",
    "concern", "warning", "alert", "vulnerability", "anomaly", "outlier", "paid", "pending", "overdue", "refunded",
    "status", "payment", "order", "transaction", "invoice", "failed", "improve", "improving", "declining", "stable",
    "volatile", "outlook", "overview", "summary", "dashboard",
]
BUSINESS_PHRASES = [
    r"how\s+is\s+the\s+business", r"how\s+are\s+we\s+doing", r"business\s+performance", r"company\s+performance",
    r"overall\s+performance", r"what's\s+the\s+state\s+of\s+the\s+business", r"give\s+me\s+an\s+overview",
    r"show\s+me\s+the\s+business\s+health", r"is\s+the\s+business\s+doing\s+well", r"are\s+there\s+any\s+risks",
    r"what\s+are\s+the\s+risks", r"business\s+risks",
]

# Routing of a question by words, first match wins; the last needs a long question.
ROUTING_WORDS = {
    "forecast": ["forecast", "predict", "future", "will be", "project", "estimate"],
    "anomaly": ["anomaly", "spike", "unusual", "outlier", "abnormal", "sudden"],
    "product_analysis": ["product", "item", "sku", "best selling", "top product"],
    "customer_analysis": ["customer", "client", "top customer", "buyer"],
    "summary": ["overview", "summary", "overall", "dashboard", "health"],
    "complex": ["compare", "versus", "vs", "why", "how", "analysis of"],
}
COMPLEX_MIN_LENGTH = 100

# Tools: months of data needed, words that ask for them.
TOOLS = {
    "compute_kpis": (0, ["kpi", "overall", "total", "revenue", "profit", "margin"]),
    "revenue_by_customer": (0, ["customer", "client", "top customer", "spending"]),
    "revenue_by_product": (0, ["product", "item", "sku", "best selling", "top product"]),
    "monthly_growth": (3, ["growth", "month over month", "increase", "decrease", "trend"]),
    "monthly_profit": (3, ["monthly profit", "profit by month"]),
    "detect_revenue_spikes": (3, ["spike", "anomaly", "unusual", "sudden", "detect"]),
    "forecast_revenue": (12, ["forecast", "predict", "future", "will be", "project"]),
    "forecast_revenue_with_explanation": (12, ["forecast", "predict", "explanation", "explain", "will be"]),
    "forecast_with_confidence": (12, ["confidence", "likely", "probability", "range", "interval"]),
    "forecast_ensemble": (12, ["ensemble", "compare", "multiple methods", "best forecast"]),
    "detect_seasonality": (24, ["seasonal", "pattern", "cycle", "yearly", "annual", "quarterly"]),
    "visualization": (0, ["chart", "graph", "plot", "visualize", "see"]),
    "monthly_revenue_by_customer": (3, ["customer trend", "customer monthly", "by customer over time"]),
    "monthly_revenue_by_product": (3, ["product trend", "product monthly", "by product over time"]),
    "forecast_revenue_by_product": (12, ["product forecast", "forecast by product", "each product", "product future"]),
}
BASE_TOOLS = ["compute_kpis", "visualization"]
TOOLS_BY_TYPE = {
    "forecast": ["monthly_revenue_by_product", "monthly_growth", "revenue_by_product", "forecast_revenue_by_product"],
    "risk": ["detect_revenue_spikes", "revenue_by_payment_status", "monthly_revenue_by_product"],
    "performance": ["revenue_by_product", "revenue_by_region", "revenue_by_customer", "monthly_growth"],
    "revenue_analysis": ["revenue_by_product", "revenue_by_region", "revenue_by_customer", "monthly_revenue_by_product"],
    "customer_analysis": ["revenue_by_customer", "monthly_revenue_by_customer"],
    "product_analysis": ["revenue_by_product", "monthly_revenue_by_product"],
    "overview": ["revenue_by_product", "revenue_by_customer", "monthly_revenue_by_product", "detect_revenue_spikes"],
}
# Words of a question and the tool each adds to a plan, in plan order.
PLAN_WORDS = [
    (["customer"], "revenue_by_customer"),
    (["product"], "revenue_by_product"),
    (["growth", "trend"], "monthly_growth"),
    (["forecast", "predict"], "forecast_revenue_with_explanation"),
    (["spike", "anomaly"], "detect_revenue_spikes"),
]

# Sections of a combined result kept per question type; other types keep all.
SECTIONS_BY_TYPE = {
    "forecast": [
        "product_monthly_trends", "monthly_growth", "monthly_profit", "revenue_by_product", "total_revenue",
        "profit_margin", "product_forecast", "forecast_summary", "overall_forecast", "confidence_forecast",
        "top_product_forecast", "top_product_forecast_value", "positive_growth_months", "negative_growth_months",
        "avg_growth", "latest_growth", "latest_growth_month",
    ],
    "risk": [
        "payment_status_counts", "revenue_at_risk", "missing_customers", "failed_revenue",
        "pending_revenue", "anomalies", "product_monthly_trends",
    ],
    "performance": [
        "total_revenue", "total_profit", "profit_margin", "product_monthly_trends", "top_customers",
        "revenue_by_region", "monthly_growth", "revenue_by_product",
    ],
    "revenue_analysis": [
        "total_revenue", "product_monthly_trends", "revenue_by_product", "revenue_by_region", "top_customers",
        "monthly_growth", "monthly_revenue_by_product_raw", "revenue_by_product_raw",
    ],
}
