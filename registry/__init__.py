"""Registered queries over the driver's tables, each with its SQL where SQL can."""

from registry import annotation, corpus_models, evaluation, files, labelling, prompting, shaping, text

MODULES = (evaluation, text, shaping, prompting, labelling, annotation, corpus_models, files)
QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
