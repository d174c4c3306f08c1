"""Readers: JSONL lines with physical line numbers, listings, JSON documents,
safetensors headers."""
