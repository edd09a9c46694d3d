"""Schemas of the engine's tables. The index is these DataFrames."""

TOKENS = "doc_id long, position int, term string, start_offset int, end_offset int"
POSTINGS = "term string, doc_id long, tf int, positions array<int>, doc_len int"
DOC_STATS = "doc_id long, doc_len int"
VOCAB = "term string, df long, cf long"
HITS = "doc_id long, score int, raw_score double"
