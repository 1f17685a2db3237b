"""Readers of question and function files, and the tables results are kept in."""
