"""Training-data operators: ten independent modules plus their query registry.

Nothing outside this subpackage imports it (apart from the guarded registry hook at the
repository top and corpus_pipeline.py).
"""
