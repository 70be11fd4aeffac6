"""Schemas of the tables."""

ENTITY_MAP = "map<string,array<string>>"

ARTICLE = (
    "link string, title string, summary string, published timestamp, source string, category string, "
    f"matched_entities {ENTITY_MAP}, collected_at timestamp"
)

PAPER = (
    ARTICLE + ", authors array<string>, doi string, arxiv_id string, pdf_url string, venue string, "
    "citation_count int, categories array<string>, keywords array<string>"
)

RAW = (
    "title string, link string, summary string, published string, source string, category string, "
    f"matched_entities {ENTITY_MAP}, logged_at string, run_id string"
)

SOURCE = (
    "position int, name string, type string, url string, enabled boolean, language string, country string, "
    "trust_tier string, collection_tier string, content_type string, producer_role string, "
    "info_purpose array<string>, notes string, config map<string,string>"
)

KEYWORD = "entity string, display_name string, pos int, keyword string"
