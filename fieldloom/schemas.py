"""Schemas of the engine's tables, as DDL strings."""

DOCUMENTS = "doc_id long, path string, kind string, mime string, size long, text string, status string, created_at timestamp"
CELLS = "doc_id long, row int, col int, value string"
TOKENS = "doc_id long, page int, source string, tok_no int, text string, conf double, x0 int, y0 int, x1 int, y1 int"
VOTES = "doc_id long, voter string, voter_ord int, field string, value string, confidence double"
RESOLVED = (
    "doc_id long, field string, value string, confidence double, agreement string, "
    "vote_counts map<string,int>, all_values array<string>, selected_from array<string>"
)
LINE_ITEMS = (
    "doc_id long, item_no int, description string, quantity double, unit_price double, amount double, total double, confidence double"
)
VENDORS = (
    "id int, vendor_name string, vendor_name_normalized string, vendor_fingerprint string, confidence double, "
    "invoice_count int, last_seen timestamp, has_template boolean, template_version int"
)
CORRECTIONS = (
    "id int, doc_id long, vendor_id int, field_name string, corrected_value string, page_number int, "
    "bbox array<double>, source string, reviewer string, created_at timestamp"
)
TEMPLATE_FIELDS = (
    "vendor_id int, field string, examples array<string>, occurrences int, confidence double, bbox array<double>, "
    "page_number int, field_type string, format_pattern string, length int, digit_count int, magnitude string"
)
