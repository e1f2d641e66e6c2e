"""Relational operators over chunks, postings, links and rankings."""
