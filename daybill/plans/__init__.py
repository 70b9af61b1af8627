"""Composed jobs: listing view, catalog refresh, feed, weekend edition, translations, reports."""
