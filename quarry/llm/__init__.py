"""Operators for preparing language-model training data.

Thirteen operators (mixing, token files, licence scan, language identification,
decontamination, archives, nearest neighbours, token rollups, Jaccard join,
line templates, page differencing, tokenizer alignment, hard negatives) and the corpus pipeline.  Nothing outside this package imports
it; ``registry`` holds its queries and oracle SQL.
"""
