"""Operators for preparing language-model training data.

Nothing outside this folder imports it; the entry module adds its queries when
the folder is there.
"""
