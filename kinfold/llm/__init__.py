"""Operators for preparing training data at corpus scale.

Every operator takes and returns DataFrames, reads whole texts, and is stand
alone: nothing outside this subpackage imports it.  Modules whose work is
native (``urlfilter``, ``decontam``) use DataFrame functions only; the others
run Arrow batches through ``mapInArrow`` / ``mapInPandas``.
"""
