"""Schemas of the relations the library works on."""

BBOX = "struct<x1:double,y1:double,x2:double,y2:double,width:double,height:double>"
CONTENT = "struct<text:string,structured:string,metadata:string>"
PROVENANCE = "struct<source_file:string,extraction_config:string,parent_blocks:array<string>,child_blocks:array<string>,source_methods:array<string>,best_method:string,consolidation_strategy:string,alternative_blocks:array<string>>"
QUALITY = "struct<text_length:bigint,word_count:bigint,readability_score:double,completeness:double>"
BLOCK = f"doc_id string, block_id string, extraction_method string, page_number int, block_type string, confidence double, bounding_box {BBOX}, content {CONTENT}, provenance {PROVENANCE}, semantic_tags array<string>, quality_metrics {QUALITY}, ord bigint"
DOCUMENT = "doc_id string, doc_name string, doc_path string, processing_timestamp timestamp, total_pages int, file_size_bytes bigint, checksum string, extraction_methods array<string>, processing_status string, processing_time_seconds double"
PAGE = "doc_id string, method string, page_number int, text string, text_length bigint, used_ocr boolean, success boolean, extraction_method string"
WORD = "doc_id string, page_number int, ord bigint, text string, x0 double, x1 double, top double, bottom double, fontname string, size double"
CELL = "doc_id string, method string, table_id string, page int, row_idx int, col_idx int, header string, value string"
FACT = "row_id bigint, concept string, period string, value double"
METRIC = "method string, metric string, value double"
