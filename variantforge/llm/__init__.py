"""Training-data operators: decontamination, privacy, tokens, duplicates, language, licences, quality and URLs.

Nothing outside this subpackage imports it.  Every operator takes DataFrames, states its
null, empty, tie and repeat rules in its docstring, and leaves no state on an executor.
"""
