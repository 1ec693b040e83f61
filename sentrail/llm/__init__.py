"""Operations for building training corpora: filters, deduplication, scoring, packing.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it; the folder can be removed.
"""
