"""The registered queries of the operators, each with its SQL where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiloom.llm import (
    centroids,
    decontaminate,
    embeddings,
    language,
    licenses,
    mixing,
    pii,
    quality,
    secrets,
    shards,
    simhash,
    tries,
    urls,
)

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def outside(key: str, folds: int, held: int) -> F.Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)) != held


@query("op1_language_mixture")
def op1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(outside("doc_id", 3, 1)))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "row.doc_id",
        (~outside("row.doc_id", 3, 1)).alias("held_out"),
        "lang_pred",
        "score",
        "languages",
    )


@query("op2_contextual_pii")
def op2(spark, sf):
    found = pii.find(table(spark, sf, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    number = [
        F.size(F.filter(kinds, F.lit(k).eqNullSafe)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)
    ]
    return found.select(
        "doc_id",
        *number,
        F.sha2(pii.digest(F.col("base")), 256).alias("base_sha256"),
        pii.digest(F.array_sort(F.concat("base", "found"))).alias("spans"),
        F.size("found").cast("long").alias("n_found"),
    )


@query("op3_embedding_quantisation")
def op3(spark, sf):
    return embeddings.near_duplicates(table(spark, sf, "embeddings").select("vec_id", "embedding"))


SQL_TEXTS = "templates(template, text) AS (VALUES " + ", ".join(
    "('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(licenses.TEMPLATES.items())
) + ")"
OP4_SQL = f"""
WITH {SQL_TEXTS},
runs AS (SELECT template, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM templates),
shingles AS (SELECT DISTINCT template, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM runs),
known AS (SELECT template, s, count(*) OVER (PARTITION BY template) AS m FROM shingles),
docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
places AS (SELECT doc_id, unnest(list_transform(range(0, len(w) - 4), lambda i: {{'pos': i, 's': array_to_string(w[i + 1:i + 5], ' ')}})) AS p
  FROM docs WHERE len(w) >= 5),
met AS (SELECT doc_id, p.pos AS pos, template, k.s, m FROM places JOIN known k ON k.s = p.s),
windows AS (SELECT doc_id, template, m, s, pos, unnest([pos // m, pos // m - 1]) AS block FROM met),
held AS (SELECT doc_id, template, block, count(DISTINCT s) / any_value(m)::DOUBLE AS containment, min(pos) AS start_word, max(pos) + 5 AS end_word,
    count(DISTINCT s) AS n, any_value(m) AS m FROM windows WHERE block >= 0 GROUP BY doc_id, template, block)
SELECT doc_id, template, containment, start_word, end_word FROM held WHERE n >= 0.8 * m
QUALIFY row_number() OVER (PARTITION BY doc_id, template ORDER BY containment DESC, block) = 1
"""


@query("op4_license_windows", OP4_SQL)
def op4(spark, sf):
    return licenses.scan(table(spark, sf, "documents").select("doc_id", "text"))


@query("op5_simhash_wildcards")
def op5(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return simhash.classes(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_WORDS = "coalesce(regexp_extract_all(" + SQL_LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
OP7_SQL = f"""
WITH items AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {SQL_WORDS.format('text')} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(10, len(w)) AS size,
    unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda i: array_to_string(w[i:i + 9], ' '))) AS win
  FROM items WHERE len(w) > 0),
docs AS (SELECT doc_id, {SQL_WORDS.format('text')} AS w FROM documents),
spots AS (SELECT doc_id, size, unnest(list_transform(range(1, len(w) - size + 2),
    lambda i: {{'pos': i, 'win': array_to_string(w[i:i + size - 1], ' ')}})) AS spot
  FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size),
met AS (SELECT doc_id, spot.pos AS pos, s.size, item FROM spots s JOIN windows v ON v.size = s.size AND v.win = spot.win),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS k FROM met) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query("op7_benchmark_automaton", OP7_SQL)
def op7(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf, "benchmark"))
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op8_vector_packing")
def op8(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return shards.shards(docs, 40).select(
        "row.doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


OP9_SQL = r"""
WITH docs AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM sums),
level AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(weight) OVER () AS weights,
    coalesce(sum(source_size) OVER before, 0) AS size_before, coalesce(sum(weight) OVER before, 0) AS weight_before
  FROM weighed WINDOW before AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
eaches AS (SELECT *, (total - 2 * size_before)::DOUBLE / (weights - weight_before)::DOUBLE AS each FROM level),
open AS (SELECT first(each ORDER BY source_size / weight, source IS NULL, source) AS l FROM eaches WHERE each * weight < 2 * source_size),
targets AS (SELECT source, source_size,
    CASE WHEN each * weight >= 2 * source_size THEN source_size * 2.0::DOUBLE ELSE (SELECT l FROM open) * weight END AS target FROM eaches),
plan AS (SELECT *, target - whole * source_size AS rest FROM (SELECT *,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets)),
sizes AS (SELECT source, size, count(*)::HUGEINT AS n FROM docs WHERE size > 0 GROUP BY source, size),
scales AS (SELECT source, size, coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS above,
    sum(n * size * size) OVER (PARTITION BY source ORDER BY size)::DOUBLE AS squares FROM sizes),
edges AS (SELECT p.source, max(size) AS largest, arg_max((rest - above) / squares, size) AS scale, arg_max(rest - above, size) AS wanted
  FROM scales s JOIN plan p ON p.source IS NOT DISTINCT FROM s.source WHERE rest > above AND (rest - above) / squares * size < 1 GROUP BY p.source),
odds AS (SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.whole, e.largest, e.wanted, e.scale * d.size AS p,
    ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM docs d JOIN plan p ON p.source IS NOT DISTINCT FROM d.source LEFT JOIN edges e ON e.source IS NOT DISTINCT FROM d.source),
ranked AS (SELECT *, CASE WHEN size > 0 AND size <= largest THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM odds),
placed AS (SELECT *, sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id NULLS LAST, size) - size / 2.0::DOUBLE AS middle FROM ranked)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN size > largest THEN 1
  WHEN rank IS NOT NULL AND middle <= wanted THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM placed
"""


@query("op9_pareto_mix", OP9_SQL)
def op9(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select(
        "row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


@query("op10_byte_convolution")
def op10(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    net = quality.fit(docs, labels.where(outside("doc_id", 5, 0)))
    return quality.scored(docs, net).select(
        "row.doc_id",
        (~outside("row.doc_id", 5, 0)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


SQL_RULES = "rules(verdict, rule) AS (VALUES " + ", ".join(f"('{v}', '{r}')" for v, r in URL_RULES) + ")"
OP6_SQL = f"""
WITH {SQL_RULES},
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (SELECT page_id, {SQL_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS ruled FROM urls, rules
  WHERE ('.' || host) LIKE ('%.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY page_id),
segs AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS s FROM urls LEFT JOIN fits USING (page_id)),
rows_ AS (SELECT *, array_to_string(list_transform(s[1:8], lambda x: CASE WHEN regexp_matches(x, '^[0-9a-fA-F-]{{8,}}$') AND regexp_matches(x, '[0-9]')
    AND regexp_matches(x, '[a-fA-F-]') THEN '<hex>' ELSE regexp_replace(x, '[0-9]+', '<n>', 'g') END)
    || CASE WHEN len(s) > 8 THEN ['**'] ELSE [] END, '/') AS form FROM segs),
forms AS (SELECT host, form, count(*) AS n, count(*) FILTER (ruled = 'block') AS blocked, count(ruled) AS labelled FROM rows_ GROUP BY host, form),
parts AS (SELECT *, string_split(form, '/') AS p FROM forms),
levels AS (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM parts),
steps AS (SELECT host, form, n, blocked, labelled, i AS level, array_to_string(p[1:i - 1], '/') AS parent, p[i] AS segment, coalesce(p[i + 1], '') AS next FROM levels),
follow AS (SELECT host, level, parent, segment, next, sum(n) AS n FROM steps GROUP BY ALL),
branch AS (SELECT host, level, parent, segment, sum(n) AS total, sum(blocked) AS b, sum(labelled) AS l FROM steps GROUP BY ALL),
par AS (SELECT host, level, parent, count(*) AS children, sum(total) AS every, sum(b) AS bs, sum(l) AS ls FROM branch GROUP BY ALL),
pooled AS (SELECT host, level, parent, next, sum(n) AS pool FROM follow GROUP BY ALL),
kinds AS (SELECT host, level, parent, count(*) AS kinds FROM pooled GROUP BY ALL),
g AS (SELECT host, level, parent, segment, any_value(b) AS b, any_value(l) AS l, 2 * sum(n * ln(n::DOUBLE * every / (total * pool))) AS g
  FROM follow JOIN branch USING (host, level, parent, segment) JOIN pooled USING (host, level, parent, next) JOIN par USING (host, level, parent) GROUP BY ALL),
names AS (SELECT host, level, parent, segment, CASE WHEN (children >= 8 AND every < 4 * children)
    OR (children > 1 AND g <= kinds - 1 + 3 * sqrt(2 * (kinds - 1)) + 1e-9 AND 2 * (CASE WHEN b > 0 THEN b * ln(b::DOUBLE * ls / (l * bs)) ELSE 0 END
      + CASE WHEN l > b THEN (l - b) * ln((l - b)::DOUBLE * ls / (l * (ls - bs))) ELSE 0 END) <= 1 + 3 * sqrt(2)) THEN '*' ELSE segment END AS name
  FROM g JOIN par USING (host, level, parent) JOIN kinds USING (host, level, parent)),
spelled AS (SELECT host, form, string_agg(name, '/' ORDER BY level) AS template FROM steps JOIN names USING (host, level, parent, segment) GROUP BY host, form),
placed AS (SELECT * FROM spelled JOIN forms USING (host, form)),
overall AS (SELECT (sum(blocked) + 2.5::DOUBLE) / (sum(labelled) + 5.0::DOUBLE) AS o FROM placed),
hosts AS (SELECT host, (sum(blocked) + 5.0::DOUBLE * any_value(o)) / (sum(labelled) + 5.0::DOUBLE) AS h FROM placed, overall GROUP BY host),
known AS (SELECT host, template, (sum(blocked) + 5.0::DOUBLE * any_value(h)) / (sum(labelled) + 5.0::DOUBLE) AS purity FROM placed JOIN hosts USING (host) GROUP BY host, template)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity >= 0.7 THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 9) AS purity
FROM rows_ JOIN placed USING (host, form) JOIN known USING (host, template)
"""


@query("op6_path_templates", OP6_SQL)
def op6(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return urls.judged(pages, URL_RULES).select(
        "row.page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 9).alias("purity")
    )


OP11_SQL = """
WITH own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, unhex(md5(length(role) || ':' || role || text))) AS t
  FROM own GROUP BY conv_id),
crc AS (SELECT range AS v FROM range(256)),
polynomial AS (SELECT v AS byte, list_reduce(list_prepend(v, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS entry FROM crc),
lookup AS (SELECT list(entry ORDER BY byte) AS entries FROM polynomial),
heads AS (SELECT conv_id, t, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: xor(c // 256, entries[xor(c % 256, b) + 1])), 4294967295) % 6 AS h FROM lists, lookup),
built AS (SELECT a.conv_id, list_concat(coalesce(b.t, [])[1:a.h], a.t[a.h + 1:]) AS t FROM heads a LEFT JOIN lists b ON b.conv_id = a.conv_id - a.conv_id % 100),
walks AS (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS depth FROM built),
nodes AS (SELECT t[1:depth] AS key, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CASE WHEN len(t) = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256,
    CASE WHEN depth > 0 THEN length(any_value(t[depth].text)) ELSE 0 END AS cp FROM walks GROUP BY key, depth),
kids AS (SELECT key[1:depth - 1] AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (key)),
above AS (SELECT unnest(range(0, depth + 1)) AS d, key, n_children, n_convs, cp FROM full_nodes),
sums AS (SELECT key[1:d] AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * cp) AS saved FROM above GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s USING (key) LEFT JOIN nodes p ON n.depth > 0 AND p.key = n.key[1:n.depth - 1]
"""


@query("op11_prefix_radix_tree", OP11_SQL)
def op11(spark, sf):
    nodes, ends = tries.prefix_tree(table(spark, sf, "conversations"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.join(tries.digests(ends), ["k1", "k2"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


@query("op12_credential_grammar")
def op12(spark, sf):
    found = secrets.find(table(spark, sf, "documents").select("doc_id", "text"))
    number = [
        F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(secrets.KINDS)
    ]
    spans = F.transform("found", lambda s: F.struct(s["kind"], s["start"], s["end"]))
    return found.select(
        "row.doc_id",
        *number,
        F.sha2(secrets.digest(F.col("base")), 256).alias("base_sha256"),
        secrets.digest(F.concat("base", spans)).alias("spans"),
        F.size("found").cast("long").alias("n_found"),
    )


def op13_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds one after the other: cells ``(c, i, v)`` of centroids, vectors ``(r, c, d)``."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""dist{r} AS MATERIALIZED (SELECT r, c, sum((q.v - m.v) * (q.v - m.v)) AS d FROM q JOIN cent{r} m USING (i) GROUP BY r, c),
near{r} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM dist{r} GROUP BY r)"""
        )
        if r < rounds:
            steps.append(
                f"""sum{r} AS MATERIALIZED (SELECT c, i, sum(v) AS s, count(*)::HUGEINT AS n FROM near{r} JOIN q USING (r) GROUP BY c, i),
cent{r + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN v ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS v FROM cent{r} LEFT JOIN sum{r} USING (c, i))"""
            )
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS e
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
q AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(e)::HUGEINT AS v FROM kept),
first AS (SELECT e, row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR) NULLS LAST, e) - 1 AS c FROM kept
  QUALIFY c < {k}),
cent0 AS MATERIALIZED (SELECT c, unnest(range(64)) AS i, unnest(e) AS v FROM first),
{", ".join(steps)},
marks AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS mark FROM cent{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, mark AS centroid_sha256 FROM near{rounds} JOIN kept USING (r) JOIN marks USING (c)
"""


@query("op13_centroid_tables", op13_sql())
def op13(spark, sf):
    return centroids.clustered(table(spark, sf, "embeddings").select("vec_id", "embedding")).select(
        "row.vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
