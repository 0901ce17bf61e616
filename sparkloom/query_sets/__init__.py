"""Registered queries by subject."""

from sparkloom.query_sets import answers, batches, invoices, orders, outlines, reports, search, trials, uploads  # noqa: F401
