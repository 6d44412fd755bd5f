"""Operators for building text corpora; nothing outside this folder imports it."""
