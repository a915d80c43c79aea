"""Training-data operators: ten document and conversation operators built on DataFrames.

Nothing outside this subpackage imports it.  Queries are in
:mod:`riverdeck.llm.queries`.
"""
