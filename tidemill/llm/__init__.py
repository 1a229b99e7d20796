"""Operators for preparing large text corpora, see the table in the README."""
