"""Operators for building training data: exact search, language spans, private
data, decontamination, sharding, similarity joins, duplicate lines and
passages, packing, web archives, conversation repair, licence scans and
collocations.  Nothing outside this subpackage (and
``corpus_pipeline.py``) imports it."""
