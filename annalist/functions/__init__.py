"""Part of the annalist engine."""
