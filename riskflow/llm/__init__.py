"""Training-data operators: tokenising, deduplication, decontamination,
toxicity, HTML extraction, exact vector search and licence scans.

Nothing else in the library imports this subpackage; it may import general
helpers (``riskflow.session``).  Operators take DataFrames and return
DataFrames; ``queries`` registers one query per operator."""
