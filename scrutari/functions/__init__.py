"""Column expressions: text analysis, length quantisation, relevance scoring, document ids."""
