"""Readers and writers: word lists, phrases, corpora, lexicons, models and reports."""

from .files import corpus, numbered_lines, parse_combined, parse_phrases, read_history, read_lexicon, read_model, read_report, read_vocabulary, wordlist, write_history, write_lexicon, write_model, write_report

__all__ = ["corpus", "numbered_lines", "parse_combined", "parse_phrases", "read_history", "read_lexicon", "read_model", "read_report", "read_vocabulary", "wordlist", "write_history", "write_lexicon", "write_model", "write_report"]
