"""Operators for preparing training text at corpus scale.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
