"""Operators for preparing training text at scale. Nothing else in the library imports this package;
``stratum.llm.queries`` registers one query per operator plus the corpus pipeline."""
