"""Keyword lists, capability tables, thresholds and constants of policy."""

# Page prefilter, table indicators, table content.
PAGE_WORDS = ["revenue", "income", "expense", "assets", "liabilities", "equity", "cash", "receivables", "inventory", "depreciation", "amortization", "gross profit", "operating income", "net income", "balance sheet", "income statement", "cash flow", "earnings", "loss", "total"]
TABLE_WORDS = ["revenue", "income", "expense", "assets", "liabilities", "equity", "cash", "total", "net", "gross", "operating", "$", "million", "thousand"]
CONTENT_WORDS = [*TABLE_WORDS, "balance", "statement", "earnings", "profit", "loss"]

# Mathematical signs and commands.
MATH = list("∑∫∂∆∇±≤≥≠≈∞∝∴∵∈∉⊂⊃∪∩∅√∛∜²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉αβγδεθλμπσφψω") + ["\\frac", "\\sum", "\\int", "\\partial", "\\delta", "\\nabla"]

# Tag -> words.
TAGS: list[tuple[str, list[str]]] = [
    ("financial_document", ["financial", "annual report", "10-k", "earnings", "revenue"]),
    ("technical_document", ["technical", "specification", "manual", "documentation"]),
    ("research_document", ["research", "study", "analysis", "methodology"]),
    ("contains_tables", ["table"]),
    ("contains_figures", ["figure", "chart", "graph"]),
    ("contains_formulas", ["formula", "equation", "calculation"]),
]

# Heading lines (regular expressions), titles of level 2 and 3. Names of companies are a parameter.
HEADINGS = [r"^Part\s+[IVX]+", r"^Item\s+\d+[A-Z]?\.?", r"^[A-Z][A-Z\s]+$", r"^Business$|^Risk Factors$|^Properties$", r"^Our Company$|^Forward-Looking Statements$"]
TITLES_2 = ["SECURITIES AND EXCHANGE COMMISSION", "ANNUAL REPORT", "FORM 10-K", "PART I", "PART II", "PART III", "PART IV"]
TITLES_3 = ["ITEM 1", "ITEM 2", "ITEM 3", "ITEM 4", "ITEM 5", "BUSINESS", "RISK FACTORS", "PROPERTIES"]
TYPE_ORDER = ["title", "text", "table", "figure", "formula", "list"]
LAYOUT_TYPES = {"Text": "text", "Title": "title", "List": "list", "Table": "table", "Figure": "figure"}

# Method -> capabilities; use case -> method.
CAPABILITIES = ["ocr_support", "layout_detection", "table_extraction", "figure_extraction", "formula_detection", "reading_order", "bounding_boxes", "multiple_formats", "visualization"]
HAS = {
    "traditional": ["ocr_support", "table_extraction", "bounding_boxes"],
    "layout_parser": ["ocr_support", "layout_detection", "table_extraction", "figure_extraction", "bounding_boxes", "multiple_formats", "visualization"],
    "docling": ["ocr_support", "layout_detection", "table_extraction", "figure_extraction", "formula_detection", "reading_order", "bounding_boxes", "multiple_formats"],
}
USE_CASES = [
    ("simple_text_extraction", "traditional"), ("financial_reports_with_tables", "docling"), ("academic_papers_with_formulas", "docling"),
    ("layout_analysis", "layout_parser"), ("high_volume_processing", "traditional"), ("complex_document_understanding", "docling"),
]

# Thresholds by method (largest WER, smallest precision and recall) and changes from a baseline that are regressions.
THRESHOLDS = [
    ("pdfplumber_tesseract", 0.05, 0.60, 0.45), ("hybrid_camelot_pdfplumber", 0.05, 0.60, 0.45),
    ("layout_parser", 0.05, 0.60, 0.45), ("docling", 0.05, 0.60, 0.70),
]
REGRESSION = {"wer": 0.10, "precision": 0.08, "recall": 0.08}
METHODS = ["docling", "layout_parser", "hybrid", "pdfplumber_tesseract"]

# Confidence of a block by kind and origin.
CONFIDENCE = {("text", "native"): 0.9, ("text", "ocr"): 0.7, ("table", "standard"): 0.9, ("table", "custom"): 0.8, ("table", "financial"): 0.85, ("layout", "words"): 0.85}
