"""Readers for tables, CSV, FHIR bundles and HL7 feeds; history and report sinks."""
