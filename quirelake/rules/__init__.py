"""Rules that ship as data."""
