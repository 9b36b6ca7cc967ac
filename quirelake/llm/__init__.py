"""Operations of a training-data pipeline.

Nothing outside this folder imports it.  Each module is one operator with a
general interface; ``queries`` holds the thin registered queries.
"""
