"""Whole jobs on the driver's tables, and their SQL counterparts."""
