"""Intentionally empty: every job of this library is an idempotent batch job.

News observations are always re-derived from the raw articles and the ledger
is replaced month by month, so no stream state is required.
"""
