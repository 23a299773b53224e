"""What is known beforehand of each extraction method and its files."""

# Method -> organisation of its texts, special capabilities, output formats, advanced features, strengths, limitations.
PROFILES = {
    "traditional": {
        "organization": "page_based",
        "table_method": "pdfplumber",
        "special": ["OCR fallback for scanned pages", "Word-level bounding boxes", "Configurable layout parameters"],
        "formats": ["txt", "json"],
        "advanced": [],
        "strengths": ["Fast processing", "OCR fallback", "Reliable text extraction"],
        "limitations": ["Limited layout understanding", "No semantic analysis"],
    },
    "layout_parser": {
        "organization": "block_based",
        "table_method": "layout_aware",
        "special": ["Deep learning-based block detection", "Multiple block types (text, title, table, figure, list)", "Layout visualization", "Confidence scores for detections"],
        "formats": ["txt", "csv", "png", "json"],
        "advanced": ["block_classification", "layout_visualization", "confidence_scoring"],
        "strengths": ["Deep learning accuracy", "Layout visualization", "Block classification"],
        "limitations": ["Requires GPU for best performance", "Complex setup"],
    },
    "docling": {
        "organization": "semantic_structure",
        "table_method": "advanced_understanding",
        "special": ["Reading order preservation", "Mathematical formula detection", "Advanced table understanding", "Unified document model", "Multiple export formats"],
        "formats": ["txt", "csv", "json", "markdown"],
        "advanced": ["reading_order", "formula_detection", "semantic_understanding", "markdown_export", "hierarchical_structure"],
        "strengths": ["Advanced understanding", "Reading order", "Multiple formats", "Formula detection"],
        "limitations": ["Newer library", "Higher resource requirements"],
    },
}
ADVANTAGES = [
    "Preserves reading order and document hierarchy", "Advanced table structure recognition", "Mathematical formula detection", "Unified document model (DoclingDocument)",
    "Multiple export formats (Markdown, JSON)", "Semantic understanding of document elements", "Better handling of complex layouts",
]

# Result files in the order in which they are looked for; patterns of reports (WER, precision, recall) and what stands where nothing is found.
RESULT_FILES = ["extraction_summary.json", "layout_parser_extraction_results.json", "docling_extraction_results.json"]
REPORT_PATTERNS = {
    "pdfplumber_tesseract": (r"(?is)PDFPlumber\+Tesseract.*?Overall Text WER:\s*(\d+(?:\.\d+)?)%", r"(?is)PDFPlumber\+Tesseract.*?Average Precision.*?(\d+(?:\.\d+)?)%", r"(?is)PDFPlumber\+Tesseract.*?Average Recall.*?(\d+(?:\.\d+)?)%"),
    "hybrid_camelot_pdfplumber": (r"(?i)Hybrid.*?(\d+-\d+)%", r"(?i)Hybrid.*?~(\d+)%.*?~\d+%", r"(?i)Hybrid.*?~\d+%.*?~(\d+)%"),
    "layout_parser": (None, r"(?i)Layout Parser.*?~(\d+)%.*?~\d+%", r"(?i)Layout Parser.*?~\d+%.*?~(\d+)%"),
    "docling": (r"(?is)Docling.*?WER.*?(\d+(?:\.\d+)?)%", r"Average Precision.*?(\d+\.\d+)%", r"Average Recall.*?(\d+\.\d+)%"),
}
REPORT_SECTIONS = {"docling": r"(?is)(## Method 4: Docling.*?)(?:##|$)"}
REPORT_DEFAULTS = {
    "pdfplumber_tesseract": (None, 0.0, 0.0), "hybrid_camelot_pdfplumber": (None, 0.60, 0.60),
    "layout_parser": (None, 0.60, 0.60), "docling": (0.0, 0.708, 0.816),
}
