"""Training-data operators: extraction, scans, deduplication, mixing and sharding.

Nothing outside this folder (but ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py``) imports it.
"""
