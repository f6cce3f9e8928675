"""Readers for mailbox tables, attachment files and dictionaries; sample tables for checks."""
