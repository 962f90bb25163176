"""Readers of articles and documents: XML, HTML, text of PDF files, Markdown, JSON."""
