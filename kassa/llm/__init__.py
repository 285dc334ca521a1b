"""Training-data operators (one module per operator) and their registered queries.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
