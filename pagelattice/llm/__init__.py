"""Training-data operators: dedup, language ID, BPE, extraction, secrets, joins, ANN, decontamination, quality.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
