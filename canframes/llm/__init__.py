"""Operators of a training-data pipeline over a ``documents`` table (and its companions):
personal data, chat quotes, licences, SentencePiece, quality, SimHash, language, secrets,
benchmark decontamination and line dedup. Nothing else in the library imports this
subpackage; its queries are listed in :mod:`canframes.llm.queries`."""
