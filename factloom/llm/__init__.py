"""Training-data operators: token files, joins on shingles, decontamination, tokenisation, filters, chat formatting.

Nothing outside this package imports it; its queries and their SQL are in ``factloom.llm.queries``.
"""
