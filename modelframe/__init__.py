"""Part of the record and time-series engine."""
