"""Lookups, rules, workflow and reports over catalogue tables."""
