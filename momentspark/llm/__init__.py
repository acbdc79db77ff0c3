"""Operations of a training-data pipeline over the tables `documents`, `pages`, `embeddings` and `labels`.

Nothing outside this subpackage (but for the guarded import in `__spark_entry__.py`) depends on it.
"""
