"""Training-data operators (documents, pages, conversations).

Nothing outside this subpackage imports it; its queries live in :mod:`galeframe.llm.queries`.
"""
