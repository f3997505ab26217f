"""Rule sets, their validation, and the registry of rule checks."""
