"""Operators for preparing text corpora at scale.

Nothing outside this subpackage imports it; ``tendermill.llm.entries`` holds its registered queries.
"""
