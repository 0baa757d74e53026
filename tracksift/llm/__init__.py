"""Operators on data for language models; nothing outside this folder imports it."""
