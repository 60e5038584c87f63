"""Operators for text and matching problems; nothing outside this folder imports it."""
