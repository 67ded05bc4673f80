"""Operators that prepare text corpora for language-model training.

Nothing outside this package imports it. Each module holds one operator with its general
interface; :mod:`wakeline.llm.bindings` applies them to the bundled tables.
"""
