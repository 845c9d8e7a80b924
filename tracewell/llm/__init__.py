"""Operations for large training-text corpora, as DataFrame transformations.

Nothing outside this folder imports it; ``queries.py`` registers its queries.
"""
