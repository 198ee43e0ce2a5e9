"""quirework: a PySpark engine for collections of research documents.

Sections, evidence spans, verified concept relations, a provenance-tracked concept graph, vector retrieval with
graph context, and retrieval metrics, all as DataFrame plans.
"""
