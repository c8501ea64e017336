"""Queries: keys, batches, alignment, masks, bundles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from registry import common as C
from sentiloom import constants as K
from sentiloom.functions import text as X
from sentiloom.operators import information as I
from sentiloom.operators import lexicon as L
from sentiloom.operators import shape as S
from sentiloom.sources import tables as IO

QUERIES, ORACLE, query = C.registry()


@query(
    "read_labelled",
    """SELECT doc_id, lang, CAST(n_chars AS INTEGER) AS n_chars, CAST(NULL AS VARCHAR) AS aspect
    FROM documents""",
)
def read_labelled(spark, sf):
    wanted = T.StructType.fromDDL("doc_id bigint, lang string, n_chars int, aspect string")
    return IO.read_labelled(spark, f"{sf}/documents.parquet", wanted)


SIZED = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE length({c}::VARCHAR) || ':' || {c}::VARCHAR END"


@query(
    "row_key",
    f"SELECT doc_id, sha256({SIZED('lang')} || {SIZED('source')} || {SIZED('text')}) AS row_key FROM documents",
)
def row_key(spark, sf):
    docs = C.docs(spark, sf, "doc_id", "lang", "source", "text")
    return S.with_row_key(docs, ["lang", "source", "text"]).select("doc_id", "row_key")


@query(
    "batches",
    f"""SELECT doc_id, rn // {K.LABELLING_BATCH} AS batch_id, rn % {K.LABELLING_BATCH} AS pos
    FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents)""",
)
def batches(spark, sf):
    return S.batches(C.table(spark, sf, "documents").select("doc_id"), K.LABELLING_BATCH, ["doc_id"])


@query(
    "batch_count",
    "SELECT count(*) AS n_rows, CAST(ceil(count(*) / 16) AS BIGINT) AS n_batches FROM documents",
)
def batch_count(spark, sf):
    return S.batch_count(C.table(spark, sf, "documents"))


@query(
    "encode",
    f"""WITH {C.SQL_WORDS}, v AS (SELECT word, count(*) AS n, row_number() OVER (ORDER BY word) AS id
    FROM words GROUP BY word)
    SELECT doc_id, string_agg(CASE WHEN n >= 2 THEN id ELSE 0 END::VARCHAR, ',' ORDER BY pos) AS token_ids
    FROM words JOIN v USING (word) GROUP BY doc_id""",
)
def encode(spark, sf):
    docs = C.docs(spark, sf)
    vocab = I.vocabulary(docs).where("n >= 2").select("word", (F.col("id") + 1).alias("id"))
    ids = S.encode(L.tokens(docs), vocab, "doc_id", 0)
    return ids.select("doc_id", C.joined("token_ids").alias("token_ids"))


@query(
    "encode_by_frequency",
    f"""WITH {C.SQL_WORDS}, v AS (SELECT word, count(*) AS n, row_number() OVER (ORDER BY word) AS id
    FROM words GROUP BY word)
    SELECT doc_id, string_agg(CASE WHEN n >= 2 AND word NOT IN ({C.sql_list(K.STOP_WORDS)}) THEN id ELSE 0 END::VARCHAR, ','
      ORDER BY pos) AS token_ids FROM words JOIN v USING (word) GROUP BY doc_id""",
)
def encode_by_frequency(spark, sf):
    """By the tokens' counts; the vocabulary leaves out the most frequent words."""
    docs = C.docs(spark, sf)
    vocab = I.vocabulary(docs).where("n >= 2").select("word", "n", (F.col("id") + 1).alias("id"))
    vocab = L.content_words(vocab)
    ids = S.encode(L.tokens(docs), vocab, "doc_id", 0)
    return ids.select("doc_id", C.joined("token_ids").alias("token_ids"))


LINE_IDS = "list_transform(regexp_extract_all(lower(text), '(\\p{L}+)'), lambda w: length(w))"


@query(
    "pad_batch",
    f"""WITH ids AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id,
      {LINE_IDS} AS ids FROM documents),
    m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS longest FROM ids)
    SELECT doc_id, batch_id,
      array_to_string(list_concat(ids, list_transform(range(longest - len(ids)), lambda x: 0)), ',') AS input_ids,
      array_to_string(list_transform(range(longest), lambda x: 0), ',') AS token_type_ids,
      array_to_string(list_transform(range(longest), lambda x: CASE WHEN x < len(ids) THEN 1 ELSE 0 END), ',')
        AS attention_mask FROM m""",
)
def pad_batch(spark, sf):
    docs = C.docs(spark, sf).select("doc_id", C.ids_of("text").alias("token_ids"))
    padded = S.pad_batch(S.batches(docs, K.EVALUATION_BATCH, ["doc_id"]).drop("pos"))
    return padded.select(
        "doc_id", "batch_id", *[C.joined(c).alias(c) for c in ("input_ids", "token_type_ids", "attention_mask")]
    )


@query(
    "attach_tokens",
    f"""SELECT d.doc_id, d.lang, CASE WHEN l.doc_id IS NOT NULL THEN array_to_string({LINE_IDS}, ',') END
    AS token_ids FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def attach_tokens(spark, sf):
    base = C.docs(spark, sf, "doc_id", "lang")
    tokens = C.labelled(spark, sf).select("doc_id", C.joined("token_ids").alias("token_ids")).distinct()
    return S.attach_tokens(base, tokens, "doc_id")


@query(
    "attach_aspects",
    f"""SELECT doc_id, lang, CASE WHEN len({C.SQL_HELD}) > 0 THEN array_to_string({C.SQL_HELD}, ',') END
    AS aspects FROM documents""",
)
def attach_aspects(spark, sf):
    base = C.docs(spark, sf, "doc_id", "lang")
    held = C.docs(spark, sf).select("doc_id", X.contained("text", C.ASPECTS).alias("aspects"))
    held = held.where(F.array_size("aspects") > 0)
    return S.attach_aspects(base, held, "doc_id").withColumn("aspects", C.joined("aspects"))


@query(
    "attach_labels",
    f"""WITH {C.SQL_LABELLED} SELECT doc_id, lang, source, aspect, implicitness, polarity
    FROM labelled JOIN documents USING (doc_id)""",
)
def attach_labels(spark, sf):
    rows = C.labelled(spark, sf).select("doc_id", "aspect", "implicitness", "polarity")
    return S.attach_labels(rows, C.docs(spark, sf, "doc_id", "lang", "source"), "doc_id")


@query(
    "explode_aspects",
    f"""SELECT doc_id, unnest(h) AS aspect, CAST(generate_subscripts(h, 1) - 1 AS INTEGER) AS aspect_pos
    FROM (SELECT doc_id, {C.SQL_HELD} AS h FROM documents)""",
)
def explode_aspects(spark, sf):
    held = C.docs(spark, sf).select("doc_id", X.contained("text", C.ASPECTS).alias("aspects"))
    return S.explode_aspects(held)


@query(
    "explode_aspects_outer",
    f"""WITH e AS (SELECT doc_id, unnest(h) AS aspect, CAST(generate_subscripts(h, 1) - 1 AS INTEGER) AS aspect_pos
    FROM (SELECT doc_id, {C.SQL_HELD} AS h FROM documents))
    SELECT doc_id, aspect_pos, aspect FROM documents LEFT JOIN e USING (doc_id)""",
)
def explode_aspects_outer(spark, sf):
    held = C.docs(spark, sf).select("doc_id", X.contained("text", C.ASPECTS).alias("aspects"))
    return S.explode_aspects(held, outer=True)


@query(
    "explode_nested",
    f"""WITH {C.SQL_SENTENCES} SELECT doc_id, array_to_string(list_transform(
    regexp_extract_all(lower(sentence), '(\\p{{L}}+)'), lambda w: length(w)), ',') AS ids FROM sents""",
)
def explode_nested(spark, sf):
    nested = C.docs(spark, sf).select("doc_id", F.transform(X.sentences("text"), C.ids_of).alias("ids"))
    return S.explode_nested(nested, "ids").withColumn("ids", C.joined("ids"))


@query(
    "aspect_mask",
    """WITH i AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '(\\p{L}+)'), lambda w: length(w)) AS ids
      FROM documents), p AS (SELECT doc_id, ids, len(ids) AS n, ids[1] AS a, ids[2] AS b FROM i)
    SELECT doc_id, CASE WHEN n = 1 THEN '1' ELSE array_to_string(list_transform(range(1, n + 1), lambda j:
      CASE WHEN (j < n AND ids[j] = a AND ids[j + 1] = b) OR (j > 1 AND ids[j - 1] = a AND ids[j] = b)
      THEN 1 ELSE 0 END), '') END AS mask FROM p""",
)
def aspect_mask(spark, sf):
    ids = C.docs(spark, sf).select("doc_id", C.ids_of("text").alias("token_ids"))
    rows = ids.withColumn("aspect_ids", F.slice("token_ids", 1, 2))
    return S.with_aspect_mask(rows).select("doc_id", C.joined("aspect_mask", "").alias("mask"))


@query(
    "align_by_position",
    f"""WITH l AS (SELECT doc_id, list_transform(regexp_extract_all(text, '([^.!?\\n]+[.!?]?)'), lambda s: length(s)) AS a,
      {C.SQL_HELD} AS b FROM documents)
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(a[pos + 1] AS INTEGER) AS sentence_length, b[pos + 1] AS aspect, len(a) = len(b) AS aligned
    FROM (SELECT *, unnest(range(greatest(len(a), len(b)))) AS pos FROM l)""",
)
def align_by_position(spark, sf):
    lists = C.docs(spark, sf).select(
        "doc_id",
        F.transform(X.sentences("text"), F.length).alias("sentence_length"),
        X.contained("text", C.ASPECTS).alias("aspect"),
    )
    return S.align_by_position(lists, ["doc_id"], ["sentence_length", "aspect"])


@query(
    "to_training",
    f"""WITH {C.SQL_LABELLED} SELECT raw_text AS raw_texts, aspect AS raw_aspect_terms,
    array_to_string(token_ids, ',') AS bert_tokens, array_to_string(aspect_mask, ',') AS aspect_masks,
    implicitness AS implicits, polarity AS labels FROM labelled""",
)
def to_training(spark, sf):
    out = S.to_training(C.labelled(spark, sf))
    return out.withColumn("bert_tokens", C.joined("bert_tokens")).withColumn("aspect_masks", C.joined("aspect_masks"))


PER_BUNDLE = 100


def _bundle(spark, sf):
    rows = C.labelled(spark, sf).select(
        "doc_id", *[F.col(src).alias(dst) for dst, src in S.BUNDLE_COLUMNS.items()]
    )
    return S.rows_to_bundle(rows, ["doc_id", "raw_aspect_terms"], list(S.BUNDLE_COLUMNS), PER_BUNDLE)


@query(
    "rows_to_bundle",
    f"""WITH {C.SQL_LABELLED}, r AS (SELECT *, (row_number() OVER (ORDER BY doc_id, aspect) - 1) // {PER_BUNDLE} AS shard
      FROM labelled)
    SELECT shard, string_agg(raw_text, chr(31) ORDER BY doc_id, aspect) AS raw_texts,
      string_agg(aspect, chr(31) ORDER BY doc_id, aspect) AS raw_aspect_terms,
      string_agg(array_to_string(token_ids, ','), chr(31) ORDER BY doc_id, aspect) AS bert_tokens,
      string_agg(array_to_string(aspect_mask, ','), chr(31) ORDER BY doc_id, aspect) AS aspect_masks,
      string_agg(CASE WHEN implicitness THEN 'true' ELSE 'false' END, chr(31) ORDER BY doc_id, aspect) AS implicits,
      string_agg(polarity::VARCHAR, chr(31) ORDER BY doc_id, aspect) AS labels FROM r GROUP BY shard""",
)
def rows_to_bundle(spark, sf):
    nested = lambda c: F.array_join(F.transform(c, lambda a: F.array_join(a, ",")), C.SEP)
    plain = lambda c: F.array_join(F.col(c).cast("array<string>"), C.SEP)
    return _bundle(spark, sf).select(
        "shard",
        plain("raw_texts").alias("raw_texts"),
        plain("raw_aspect_terms").alias("raw_aspect_terms"),
        nested("bert_tokens").alias("bert_tokens"),
        nested("aspect_masks").alias("aspect_masks"),
        plain("implicits").alias("implicits"),
        plain("labels").alias("labels"),
    )


@query(
    "bundle_to_rows",
    f"""WITH {C.SQL_LABELLED}, r AS (SELECT *, row_number() OVER (ORDER BY doc_id, aspect) - 1 AS rn FROM labelled)
    SELECT rn // {PER_BUNDLE} AS shard, CAST(rn % {PER_BUNDLE} AS INTEGER) AS pos, raw_text AS text, aspect AS target,
    polarity AS label, CAST(implicitness AS INTEGER) AS implicit, TRUE AS aligned FROM r""",
)
def bundle_to_rows(spark, sf):
    return S.bundle_to_rows(_bundle(spark, sf), "shard")


@query("remaining", "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def remaining(spark, sf):
    base = C.table(spark, sf, "documents").select("doc_id", "lang")
    return S.remaining(base, C.table(spark, sf, "labels"), "doc_id")


@query(
    "progress",
    """SELECT count(*) AS total, count(*) // 2 AS half, count(l.doc_id) AS done,
    count(*) - count(l.doc_id) AS remaining, CAST(0 AS BIGINT) AS without_key
    FROM documents LEFT JOIN labels l USING (doc_id)""",
)
def progress(spark, sf):
    return S.progress(C.table(spark, sf, "documents"), C.table(spark, sf, "labels"), "doc_id")


@query("processed_keys", "SELECT DISTINCT text FROM documents")
def processed_keys(spark, sf):
    return S.processed_keys(C.docs(spark, sf), "text")


@query(
    "collect_texts",
    """SELECT rn // 100 AS chunk, string_agg(text, chr(31) ORDER BY doc_id) AS texts
    FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents) GROUP BY chunk""",
)
def collect_texts(spark, sf):
    out = S.collect_texts(C.docs(spark, sf), "text", "doc_id", 100)
    return out.select("chunk", C.joined("texts", C.SEP).alias("texts"))


@query("order_by_key", "SELECT doc_id, source, lang FROM documents ORDER BY source, doc_id")
def order_by_key(spark, sf):
    return S.order_by_key(C.table(spark, sf, "documents").select("doc_id", "source", "lang"), ["source", "doc_id"])


@query(
    "parse_comment_time",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END
    AS comment_time FROM events""",
)
def parse_comment_time(spark, sf):
    shown = F.when(F.col("event_type") == "error", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format("ts", K.EXPORT_TIME)
    )
    return C.table(spark, sf, "events").select(
        "event_id", S.stored_time(S.parse_comment_time(shown)).alias("comment_time")
    )
