"""Preparation of training text: dedup, filters, scans, tokens, chat formatting."""
