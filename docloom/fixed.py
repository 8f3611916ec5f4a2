"""Vocabularies and the registry of canonical fields."""

FOCUSED_TYPES = [
    "eligibility_criteria", "submission_deadlines", "technical_requirements", "scope_of_work",
    "payment_terms", "penalties_and_risks", "mandatory_documents", "set_asides",
]

# field key, bucket, display label
FIELD_DEFS = [
    ("project_name", "project_metadata_items", "Project name"),
    ("project_description", "project_metadata_items", "Project description"),
    ("project_owner", "project_metadata_items", "Project owner"),
    ("project_sector", "project_metadata_items", "Project sector"),
    ("project_solicitation_number", "project_metadata_items", "Project solicitation number"),
    ("project_document_acquisition_note", "project_metadata_items", "Project document acquisition note"),
    ("project_value", "project_metadata_items", "Project value"),
    ("project_engineer", "project_people_items", "Project engineer"),
    ("project_architect", "project_people_items", "Project architect"),
    ("project_square_footage", "project_size_location_items", "Project square footage"),
    ("project_location", "project_size_location_items", "Project location"),
]
DEADLINE_LABELS = {
    "bid_deadline_date_time": "Bid deadline",
    "bid_open_date_time": "Bid open date",
    "project_start_date_time": "Project start date",
    "project_end_date_time": "Project end date",
    "pre_bid_deadline_date_time": "Pre-bid deadline",
    "site_visit_date_time": "Site visit",
    "question_deadline_date_time": "Question deadline",
    "municipal_meeting_date_time": "Award date",
}
BOND_LABELS = {
    "bid_bond_information": "Bid bond information",
    "payment_and_security_bond": "Performance & payment bond",
    "maintenance_and_labor_bond": "Maintenance & labor bond",
    "certified_checks": "Certified checks",
    "other_bonds": "Other bonds",
}
SET_ASIDE_KEYS = [
    "set_aside", "set_aside_mbe", "set_aside_wbe", "set_aside_dbe", "set_aside_dvbe", "set_aside_hub", "set_aside_sbe",
]
SINGLETON_KEYS = [
    "project_name", "project_sector", "project_value", "project_square_footage", "project_description",
    "project_document_acquisition_note", "bid_deadline_date_time", "bid_open_date_time", "project_start_date_time",
    "project_end_date_time", "pre_bid_deadline_date_time", "site_visit_date_time", "question_deadline_date_time",
    "municipal_meeting_date_time",
]
EVENT_FIELDS = [
    ("project_document_acquisition_note", "Document acquisition — Events"),
    ("bid_deadline_date_time", "Bid deadline — Events"),
    ("bid_open_date_time", "Bid open — Events"),
    ("pre_bid_deadline_date_time", "Pre-bid — Events"),
    ("site_visit_date_time", "Site visit — Events"),
    ("question_deadline_date_time", "Question deadline — Events"),
    ("municipal_meeting_date_time", "Award — Events"),
]
ACTIVE_STAGES = [
    "intake_processing", "parsing_processing", "ocr_processing", "sectioning_processing", "chunking_processing",
    "embedding_processing", "extraction_processing", "summary_processing",
]
INTEL_STAGES = [
    "chunking_processing", "chunking_completed", "embedding_processing", "embedding_completed",
    "extraction_processing", "extraction_completed", "summary_processing",
]

DISPLAY_LABELS = {**{k: label for k, _, label in FIELD_DEFS}, **DEADLINE_LABELS, "set_aside": "Set-aside"}
CANONICAL_FIELDS = list(DISPLAY_LABELS.items())
