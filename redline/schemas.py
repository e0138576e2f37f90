"""Types of what is kept or handed over, as DDL; each list has an explicit ordinal or an order of its own."""

TABLE = "struct<headers: array<string>, rows: array<array<string>>>"
SEGMENTS = "array<struct<op: string, text: string>>"
REGIONS = "array<struct<page_index: int, bbox: array<double>>>"
DIFF = (
    "alignment_id: string, status: string, risk_level: string, risk_reasons: array<string>, judged_by: string, number: string, title: string, "
    f"segments: {SEGMENTS}, page_regions: {REGIONS}"
)
#: The report of a pair.
REPORT = (
    "pair_id long, overall_risk string, total_alignments long, key_element_changes long, recognition_status string, unreliable_pages array<int>, "
    "status_counts map<string, long>, risk_distribution map<string, long>, "
    f"diffs array<struct<{DIFF}>>, unmatched array<struct<{DIFF}>>, "
    "key_elements array<struct<alignment_id: string, kind: string, word_value: string, pdf_value: string>>"
)
