"""Structured Streaming forms of the event fold, the request flow and the rate flags."""
