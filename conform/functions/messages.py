"""Exception kinds and the wording reported with them."""

# The exception kinds, in the order a run can raise them.
DUPLICATE = "duplicate"
UNKNOWN_PROFILE = "unknown_profile"
DRIFT_BLOCK = "drift_block"
RECORD_PARSE = "record_parse"
OOV_VALUE = "oov_value"
INVALID_VALUE = "invalid_value"
RENDER_ROUNDTRIP = "render_roundtrip"
KINDS = (DUPLICATE, UNKNOWN_PROFILE, DRIFT_BLOCK, RECORD_PARSE, OOV_VALUE, INVALID_VALUE, RENDER_ROUNDTRIP)

# The columns of the exceptions report, in file order.
EXCEPTION_COLUMNS = (
    "document", "record_ref", "kind", "field", "value", "reason", "suggestion", "template",
)
