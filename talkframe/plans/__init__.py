"""Registered queries: each reads the given tables and applies one operator or a chain of them."""

from talkframe.plans import details, folded, measures, mixed, ordered_sql, reports, speech, streams, wording

MODULES = (speech, measures, wording, folded, mixed, details, streams, reports)
QUERIES: dict = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLES: dict = {k: s for m in (*MODULES, ordered_sql) for k, s in m.ORACLES.items()}
