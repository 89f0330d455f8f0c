"""The document model: one table for each kind of element, joined by document_id."""

BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"
DOCUMENTS = "document_id string, filename string, file_type string, mime_type string, checksum string, source_uri string, page_count int, sheet_count int, parser_used string, processing_status string, metadata map<string,string>, named_ranges map<string,string>, external_links array<string>, errors array<string>"
PAGES = "document_id string, page_number int, width double, height double, rotation int, ocr_used boolean"
TEXT_BLOCKS = f"document_id string, block_id string, page_number int, ordinal int, reading_order_index int, text string, block_type string, font_size double, confidence double, bbox {BBOX}"
TABLES = "document_id string, table_id string, ordinal int, page_number int, sheet_name string, title string, row_count int, column_count int, confidence double"
TABLE_CELLS = "document_id string, table_id string, ordinal int, row_index int, column_index int, value string, data_type string, source_cell_ref string"
SHEETS = "document_id string, name string, index int, is_visible boolean, used_range string, row_count int, column_count int, merged_cells array<string>, hidden_rows array<int>, hidden_columns array<int>, comments array<struct<cell:string,author:string,text:string>>"
FORMULAS = "document_id string, sheet_name string, ordinal int, cell_address string, formula_text string, calculated_value string"
FIGURES = "document_id string, figure_id string, page_number int, figure_type string, caption string"
WARNINGS = "document_id string, code string, message string, page int, sheet string"

# File types and MIME types by extension.
FILE_TYPES = {
    ".pdf": "pdf", ".xlsx": "xlsx", ".xls": "xls", ".csv": "csv", ".docx": "docx", ".pptx": "pptx", ".rtf": "rtf",
    ".txt": "text", ".png": "image", ".jpg": "image", ".jpeg": "image", ".tiff": "image", ".tif": "image",
}
MIME_TYPES = {
    "pdf": "application/pdf",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xls": "application/vnd.ms-excel",
    "csv": "text/csv",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "rtf": "application/rtf",
    "text": "text/plain",
    "image": "image/png",
}
# Block types, keywords of the classifier, warning codes that lower confidence.
BLOCK_TYPES = ("paragraph", "heading", "list_item", "caption", "footnote", "header", "footer", "page_number")
FURNITURE = ("header", "footer", "page_number")
KEYWORDS = {
    "financial_model": ("revenue", "ebitda", "forecast", "budget", "p&l", "profit"),
    "invoice": ("invoice", "bill to", "amount due", "total due"),
    "contract": ("agreement", "contract", "whereas", "parties", "governing law"),
    "bank_statement": ("statement", "account", "balance", "transaction"),
    "resume": ("resume", "curriculum vitae", "experience", "education", "skills"),
}
LOW_CONFIDENCE_CODES = ("POSSIBLY_SCANNED", "HIDDEN_SHEET", "EXTERNAL_LINKS")
