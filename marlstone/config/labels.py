"""Label dictionary, statement rules and period words. Order matters: the first entry that matches wins."""

# Label -> concept, in the order in which labels are tried.
LABELS: list[tuple[str, str]] = [
    ("Revenue", "Revenue"), ("Total revenue", "Revenue"), ("Net revenue", "Revenue"), ("Total net revenue", "Revenue"),
    ("Revenues", "Revenue"), ("Net revenues", "Revenue"), ("Sales", "Revenue"), ("Net sales", "Revenue"), ("Total sales", "Revenue"),
    ("Revenue:", "Revenue"), ("Total current", "Revenue"), ("Total revenue from product sales", "Revenue"),
    ("Product revenue", "Revenue"), ("Service revenue", "Revenue"), ("% of net revenue", "Revenue"), ("Cost of revenue", "Revenue"),
    ("Deferred revenue", "Revenue"),
    ("Net income", "Net Income"), ("Net earnings", "Net Income"), ("Total net income", "Net Income"), ("Net income (loss)", "Net Income"),
    ("Net Income", "Net Income"), ("Income", "Net Income"), ("Earnings", "Net Income"), ("Profit", "Net Income"),
    ("Total comprehensive income", "Net Income"), ("Interest income", "Net Income"), ("Retained earnings", "Net Income"),
    ("Net income attributable", "Net Income"), ("Net income per share", "Net Income"), ("Earnings per share", "Net Income"),
    ("Basic earnings per share", "Net Income"), ("Diluted earnings per share", "Net Income"), ("Comprehensive income", "Net Income"),
    ("Income after taxes", "Net Income"), ("After-tax income", "Net Income"), ("Bottom line", "Net Income"),
    ("Income from operations", "Operating Income"), ("Operating income", "Operating Income"), ("Operating profit", "Operating Income"),
    ("Operating income (loss)", "Operating Income"), ("Income (loss) from operations", "Operating Income"),
    ("Income before income tax", "Operating Income"), ("Operating margin", "Operating Income"),
    ("Income from continuing operations", "Operating Income"), ("Consolidated", "Operating Income"),
    ("Operating activities", "Operating Income"), ("Income before taxes", "Operating Income"), ("Pretax income", "Operating Income"),
    ("Operating results", "Operating Income"), ("Operating performance", "Operating Income"),
    ("Total assets", "Total Assets"), ("Assets", "Total Assets"), ("Current assets", "Total Assets"),
    ("Total current assets", "Total Assets"), ("Cash and cash equivalents", "Cash and Cash Equivalents"),
    ("Cash", "Cash and Cash Equivalents"), ("Cash & cash equivalents", "Cash and Cash Equivalents"),
    ("Cash and equivalents", "Cash and Cash Equivalents"), ("Total inventories", "Total Assets"),
    ("Cash & Cash Equiv.", "Cash and Cash Equivalents"), ("Cash equivalents", "Cash and Cash Equivalents"),
    ("Short-term investments", "Cash and Cash Equivalents"), ("Marketable securities", "Cash and Cash Equivalents"),
    ("Restricted cash", "Cash and Cash Equivalents"),
    ("Cash, cash equivalents and marketable securities", "Cash and Cash Equivalents"),
    ("Total liabilities", "Total Liabilities"), ("Liabilities", "Total Liabilities"), ("Current liabilities", "Total Liabilities"),
    ("Total current liabilities", "Total Liabilities"), ("Total shareholders' equity", "Stockholders Equity"),
    ("Shareholders' equity", "Stockholders Equity"), ("Stockholders' equity", "Stockholders Equity"), ("Equity", "Stockholders Equity"),
    ("Total equity", "Stockholders Equity"),
    ("Compute & Networking", "Revenue"), ("Compute and Networking", "Revenue"), ("Graphics", "Revenue"), ("Data Center", "Revenue"),
    ("Gaming", "Revenue"), ("Professional Visualization", "Revenue"), ("Automotive", "Revenue"), ("All Other", "Revenue"),
    ("Other", "Revenue"),
    ("Operating leases", "Operating Income"), ("Other comprehensive income", "Net Income"),
    ("Accumulated other comprehensive income (loss)", "Net Income"), ("Income tax expense (benefit)", "Net Income"),
    ("Deferred income taxes", "Net Income"), ("Foreign-derived intangible income", "Net Income"), ("Other income (expense)", "Net Income"),
]

# Statement -> (words in a label, concept), in the order in which they are tried.
STATEMENT_RULES: list[tuple[str, str, str]] = [
    ("income_statement", "revenue", "Revenue"), ("income_statement", "sales", "Revenue"), ("income_statement", "net income", "Net Income"),
    ("income_statement", "operating income", "Operating Income"), ("income_statement", "gross profit", "Gross Profit"),
    ("income_statement", "cost of sales", "Cost of Sales"), ("income_statement", "r&d", "Research and Development"),
    ("income_statement", "research and development", "Research and Development"),
    ("balance_sheet", "total assets", "Total Assets"), ("balance_sheet", "cash", "Cash and Cash Equivalents"),
    ("balance_sheet", "total liabilities", "Total Liabilities"), ("balance_sheet", "stockholders equity", "Stockholders Equity"),
    ("balance_sheet", "retained earnings", "Retained Earnings"),
    ("cash_flow", "operating activities", "Operating Cash Flow"), ("cash_flow", "investing activities", "Investing Cash Flow"),
    ("cash_flow", "financing activities", "Financing Cash Flow"),
]

# Words that tell a statement's kind, first kind that matches wins.
STATEMENT_WORDS: list[tuple[str, list[str]]] = [
    ("income_statement", ["revenue", "income", "earnings", "profit"]),
    ("balance_sheet", ["assets", "liabilities", "equity", "stockholders"]),
    ("cash_flow", ["cash flow", "operating activities", "investing", "financing"]),
]

# Words of weight in label matching.
WEIGHTY = ["revenue", "income", "profit", "assets", "liabilities", "equity", "cash", "operating", "net", "total", "comprehensive", "loss"]

# Search terms of each official metric.
METRIC_TERMS: list[tuple[str, list[str]]] = [
    ("Revenue", ["revenue", "total revenue", "net revenue"]), ("Net Income", ["net income"]), ("Operating Income", ["operating income"]),
    ("Total Assets", ["total assets"]), ("Cash and Cash Equivalents", ["cash and cash equivalents"]),
    ("Total Liabilities", ["total liabilities"]), ("Stockholders Equity", ["stockholders equity", "total stockholders equity"]),
]

# Concepts that can't be negative; concepts whose ratio may reach 1e7.
POSITIVE = ["Revenue", "Total Assets", "Cash and Cash Equivalents", "Stockholders Equity"]
WIDE_RATIO = ["Operating Income", "Net Income"]

# Words of segments and of consolidated figures in period headers.
SEGMENT_WORDS = ["compute", "networking", "graphics", "datacenter", "gaming", "professional", "automotive", "segment", "division", "business unit", "all other"]
SEGMENT_PERIODS = ["compute", "graphics", "networking", "gaming", "automotive", "datacenter", "professional visualization", "all other", "segment", "division", "business unit"]
CONSOLIDATED_WORDS = ["consolidated", "total", "year ended", "period ended", "fiscal year", "annual", "quarterly", "company", "entity"]

# The default fiscal calendar, newest first: (year, period end, spellings). Pass another for other issuers.
CALENDAR: list[tuple[str, str, list[str]]] = [
    ("2024", "2024-01-28", ["jan 28, 2024", "january 28, 2024"]),
    ("2023", "2023-01-29", ["jan 29, 2023", "january 29, 2023"]),
    ("2022", "2022-01-30", ["jan 30, 2022", "january 30, 2022"]),
]
