"""Operators: ``f(df, ..., by=()) -> DataFrame``.

``by`` names the owner columns (account owner, subject, repository, filer). They are part of every
group, window and join key, so one job serves many owners; ``by=()`` is the single-owner case.
"""
