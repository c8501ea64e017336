"""Table schemas of comment, label, bundle and annotation data."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
IDS = T.ArrayType(I)

# Header of the twelve-column comment export.
COMMENTS = (
    T.StructType()
    .add("Comment ID", S)
    .add("Reply to Which Comment", S)
    .add("User ID", S)
    .add("Username", S)
    .add("Nick Name", S)
    .add("Comment", S)
    .add("Comment Time", S)
    .add("Digg Count", I)
    .add("Author Digged", S)
    .add("Reply Count", I)
    .add("Pinned to Top", S)
    .add("User Homepage", S)
)

# Header of the two-column development file.
COMMENTS_SHORT = (
    T.StructType()
    .add("Comment ID", S)
    .add("Comment", S)
)

# Columns of stored labelled rows.
LABELLED = (
    T.StructType()
    .add("aspect", S)
    .add("aspect_mask", IDS)
    .add("token_ids", IDS)
    .add("token_type_ids", IDS)
    .add("attention_mask", IDS)
    .add("implicitness", B)
    .add("polarity", I)
    .add("raw_text", S)
)
FINAL = T.StructType(COMMENTS.fields + LABELLED.fields)

# Metric columns of the scored table.
METRICS = (
    "shannon_entropy",
    "mutual_information_score",
    "surprisal",
    "perplexity",
    "contextual_mutual_information_score",
    "contextual_surprisal",
    "contextual_perplexity",
)

# What the scored table has after the comment's own columns.
_LABEL_COLUMNS = (
    T.StructType()
    .add("index", L)
    .add("aspect_mask", IDS)
    .add("token_ids", IDS)
    .add("token_type_ids", IDS)
    .add("attention_mask", IDS)
    .add("raw_text", S)
    .add("aspect", S)
    .add("implicitness", B)
    .add("polarity", I)
)
SCORED = T.StructType(COMMENTS.fields + _LABEL_COLUMNS.fields + [T.StructField(name, D) for name in METRICS])

# Lists of the training bundle.
BUNDLE = (
    T.StructType()
    .add("raw_texts", T.ArrayType(S))
    .add("raw_aspect_terms", T.ArrayType(S))
    .add("bert_tokens", T.ArrayType(IDS))
    .add("aspect_masks", T.ArrayType(IDS))
    .add("implicits", T.ArrayType(B))
    .add("labels", IDS)
)

ANNOTATION = (
    T.StructType()
    .add("doc_id", L)
    .add("sent_id", I)
    .add("tok_id", I)
    .add("text", S)
    .add("lemma", S)
    .add("upos", S)
    .add("head", I)
    .add("deprel", S)
    .add("ner", S)
)

# Attributes and elements of annotated sentences in XML.
ASPECT_TERM = (
    T.StructType()
    .add("_term", S)
    .add("_polarity", S)
    .add("_from", I)
    .add("_to", I)
    .add("_implicit_sentiment", S)
    .add("_opinion_words", S)
)
ASPECT_XML = (
    T.StructType()
    .add("_id", S)
    .add("text", S)
    .add("aspectTerms", T.StructType().add("aspectTerm", T.ArrayType(ASPECT_TERM)))
)
