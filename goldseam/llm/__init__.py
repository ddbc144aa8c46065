"""Operators that prepare text corpora for training language models.

Nothing outside this package imports it. Operators take and return DataFrames; ``queries`` holds the
registered queries with their SQL checks. All tables an operator has to read twice are written below
``spark.checkpoint.dir`` (see ``common.staged``), so a lost executor costs a task, not the job.
"""
