"""Column functions: text normalisation, scoring, stemming and integer codecs."""
