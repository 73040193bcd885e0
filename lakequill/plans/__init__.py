"""Composed runs: question answering over a lake, and the chunking benchmark."""
