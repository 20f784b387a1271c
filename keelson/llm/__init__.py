"""Training-data operators and the corpus pipeline's stages.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
