"""Training-data operators: one module per operator, one registry of their queries.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
