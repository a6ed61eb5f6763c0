"""Training-data operators: near duplicates, language, secrets, tokens, search,
decontamination, URL policy, language-model scores, byte-level BPE, quality, ranked
lexical search, whitening, license scans.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
