"""Closed vocabularies. The spellings are part of the data model."""

# The seven fields in their canonical order, and the groups they fall into.
FIELDS = ["shipper", "consignee", "notify_party", "port_of_loading", "port_of_discharge", "container_count", "gross_weight_kg"]
PARTY_FIELDS, PORT_FIELDS, NUMERIC_FIELDS = FIELDS[:3], FIELDS[3:5], FIELDS[5:]
# Categories in the order in which ties are won.
CATEGORIES = ["SPAM", "GENERAL", "INVOICE_QUERY", "SI_REQUEST", "BL_COMPARISON"]
STATUSES = ["OK", "MISMATCH", "NEEDS_REVIEW"]
REVIEW_REASONS = ["missing_attachment", "unreadable", "wrong_doc_type", "missing_value"]
# Document types in the order in which ties are won.
DOC_TYPES = ["SHIPPING_INSTRUCTION", "BILL_OF_LADING", "COMMERCIAL_INVOICE", "PACKING_LIST", "CERTIFICATE_OF_ORIGIN"]
MATCH, MISMATCH, UNCOMPARABLE = "MATCH", "MISMATCH", "UNCOMPARABLE"
NO_MISMATCH = "No mismatch detected."
