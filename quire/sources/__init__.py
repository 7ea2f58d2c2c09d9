"""Readers, writers and adapters that shape raw tables into the corpus model."""
