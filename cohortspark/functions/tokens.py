"""Endpoint tokens, families and their vocabularies. Fixed values."""

FAMILIES = ("OS", "DSS", "DFS", "PFS", "MFS")
FAMILY_TOKENS = {
    "OS": ("OS",),
    "DSS": ("DSS", "CSS", "BCSS"),
    "DFS": ("DFS", "RFS", "EFS", "DFI"),
    "PFS": ("PFS", "PFI"),
    "MFS": ("MFS", "DRFS"),
}
BROWSE = {"OS": "OS", "DSS": "DSS", "DFS": "DFS", "PFS": "PFS", "MFS": "PFS"}
DERIVED = ("DFI", "PFI")
ROLES = ("exact", "related", "derived", "absent")
CLASSES = ("Exact-equivalent", "Clinically-related", "Not-poolable", "Unknown", "Absent")
#: (token, family, place in the family's priority)
TOKEN_ROWS = tuple((t, f, k) for f, ts in FAMILY_TOKENS.items() for k, t in enumerate(ts))
