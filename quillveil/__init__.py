"""Finding, scoring and redacting personal data at corpus scale, with DataFrames."""
