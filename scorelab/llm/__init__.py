"""Operators for large text corpora: token counts, toxicity, decontamination, neighbours, secrets,
repeated passages, token files, language, packing and near copies. Nothing else in the library
imports this subpackage."""
