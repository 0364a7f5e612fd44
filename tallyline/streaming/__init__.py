"""Incremental runs of the batch operators over growing export folders."""
