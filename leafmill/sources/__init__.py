"""Readers that turn files into tables of documents, chapters and blocks."""
