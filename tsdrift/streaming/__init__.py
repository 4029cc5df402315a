"""Structured Streaming jobs: windowed drift (STM-1), policy state (STM-2)."""
