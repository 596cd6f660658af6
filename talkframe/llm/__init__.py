"""Operators for preparing text corpora for model training; nothing outside this subpackage imports it."""
