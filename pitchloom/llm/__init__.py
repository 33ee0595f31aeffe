"""Operators for preparing large text corpora, one module for each, and their registered queries."""
