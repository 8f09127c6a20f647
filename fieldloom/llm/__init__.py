"""Training-data operators: sanitising, language, media, toxicity, near-duplicates,
conversations, mixing, language-model scoring, decontamination and page extraction.

Nothing else in the library imports this subpackage.
"""
