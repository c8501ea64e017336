"""Personal data by patterns, and identifiers that their contexts give away.

Well-formed emails, addresses, cards and phone numbers are found by pattern.
They are the seeds of a bootstrap: the words before them are lexical patterns,
patterns and instances form a graph whose scores are passed to and fro, and
what follows patterns of high confidence is personal data as well.
All of it is column expressions and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentiloom.llm.common import packed, store

KINDS = ("email", "ip", "card", "phone")
# No match can start inside a run of its first characters unless the one before
# ended there (\G); with that, and as nothing is given back, patterns are linear.
# A card is a whole run of digits with single blanks or hyphens between them, so
# that runs of other lengths need not match at all.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts in which this does not occur have no match.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: A candidate is a token, from white space to white space, with a digit or an @.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"

def matches(text: str, pattern: str, hint: str) -> Column:
    """``(value, piece)`` of each match, leftmost first; ``piece`` lies before it."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    pieces = F.split(F.col(text), pattern, -1)
    # one piece more than matches; the last pair has no value
    pairs = F.filter(F.arrays_zip(found.alias("value"), pieces.alias("piece")), lambda x: x["value"].isNotNull())
    return F.when(F.rlike(F.col(text), F.lit(hint)), pairs)


def luhn(digits: Column) -> Column:
    """From the right every second digit counts twice, less 9 where that exceeds 9."""
    values = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.rlike(value, F.lit(rf"^{OCTET}(\.{OCTET}){{3}}$"))
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _word(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "[0-9]+", "#")


def _gaps(pairs: Column) -> Column:
    return F.transform(pairs, lambda x: F.struct(F.length(x["piece"]).alias("gap"), x["value"].alias("value")))


def _context(pairs: Column) -> Column:
    """Each token's gap, and the last two words of the piece before it."""

    def one(x):
        near = F.right(x["piece"], F.lit(96))
        return F.struct(
            F.length(x["piece"]).alias("gap"),
            x["value"].alias("value"),
            F.regexp_extract(near, r"(\S+)\s+$", 1).alias("before"),
            F.regexp_extract(near, r"(\S+)\s+\S+\s+$", 1).alias("left"),
        )

    return F.transform(pairs, one)


def _placed(rows: DataFrame, *by: str) -> DataFrame:
    """Code points, start and end: pieces and matches alternate, so running sums are places."""
    order = Window.partitionBy("place", *by).orderBy("pos")
    end = F.sum(F.col("gap") + F.length("value")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))


def base(df: DataFrame, key: str, text: str) -> DataFrame:
    """One pass over the texts: ``place``, ``key``, matches ``m0`` … by kind, ``tokens``."""
    own = F.coalesce(F.col("row").getField(text).cast("string"), F.lit(""))
    rows = packed(df).select(F.col("row").getField(key).alias("key"), own.alias("text"))
    names = [f"m{k}" for k in range(len(KINDS))]
    found = rows.select(
        "key",
        *[matches("text", PATTERNS[k], HINTS[k]).alias(n) for n, k in zip(names, KINDS)],
        matches("text", CANDIDATE, "[0-9@]").alias("tokens"),
    )
    return found.select(
        F.monotonically_increasing_id().alias("place"),
        "key",
        *[_gaps(F.col(n)).alias(n) for n in names],
        _context(F.col("tokens")).alias("tokens"),
    )


def spans(kept: DataFrame) -> DataFrame:
    """``(place, kind, start, end, value, ok)`` of each match; ``ok`` says that it passed its check."""
    rows = None
    for k, kind in enumerate(KINDS):
        own = kept.select("place", F.posexplode(f"m{k}").alias("pos", "match")).select(
            "place", F.lit(k).alias("kind"), "pos", "match.gap", "match.value", passes(kind, F.col("match.value")).alias("ok")
        )
        rows = own if rows is None else rows.union(own)
    return _placed(rows, "kind").select("place", "kind", "start", "end", "value", "ok")


def candidates(kept: DataFrame, known: DataFrame) -> DataFrame:
    """``(place, start, end, value, patterns, seed, refused)`` of each token.

    Punctuation at a token's ends is left out.  ``seed`` is the kind of a base
    span that starts in the token, whose ``value`` it then has; ``refused`` says
    that it touches a base span or a match that failed its check.  Tokens and
    matches are gone through once in the order of their places.
    """
    order = Window.partitionBy("place").orderBy("pos")
    rows = kept.select("place", F.posexplode("tokens").alias("pos", "token")).select("place", "pos", "token.*")
    head = F.length(F.regexp_extract("value", r"^[^\p{L}\p{N}+(]*", 0))
    tail = F.length(F.regexp_extract("value", r"[^\p{L}\p{N}]*$", 0))
    last = F.coalesce(F.lag("value").over(order), F.lit(""))
    before = F.when(F.col("before") != "", F.col("before")).otherwise(last)
    left = F.when(F.col("left") != "", F.col("left")).otherwise(F.when(F.col("before") != "", last).otherwise(F.lit("")))
    tokens = (
        _placed(rows)
        .withColumns({"first": before, "second": left, "head": head, "tail": tail})
        .select(
            "place",
            (F.col("start") + F.col("head")).alias("start"),
            (F.col("end") - F.col("tail")).alias("end"),
            F.substring(F.col("value"), F.col("head") + 1, F.length("value") - F.col("head") - F.col("tail")).alias("value"),
            F.array_distinct(F.array(_word(F.col("first")), F.concat_ws(" ", _word(F.col("second")), _word(F.col("first"))))).alias(
                "patterns"
            ),
        )
        .where("end > start")
    )
    none = lambda kind: F.lit(None).cast(kind)
    events = tokens.select(
        "place", (F.col("end") - 1).alias("at"), F.lit(1).alias("token"), "start", "end", "value", "patterns",
        none("int").alias("reach"), none("struct<start:int,kind:int,value:string>").alias("seen"),
    ).union(
        known.select(
            "place", F.col("start").alias("at"), F.lit(0), "start", "end", none("string"), none("array<string>"),
            "end", F.when(F.col("ok"), F.struct("start", (-F.col("kind")).alias("kind"), "value")),
        )
    )
    so_far = Window.partitionBy("place").orderBy("at", "token").rowsBetween(Window.unboundedPreceding, 0)
    seen = events.withColumns({"reach": F.max("reach").over(so_far), "seen": F.max("seen").over(so_far)}).where("token = 1")
    starts = F.col("seen.start") >= F.col("start")
    return seen.select(
        "place",
        "start",
        "end",
        F.when(starts, F.col("seen.value")).otherwise(F.col("value")).alias("value"),
        "patterns",
        F.when(starts, -F.col("seen.kind")).alias("seed"),
        F.coalesce(F.col("reach") > F.col("start"), F.lit(False)).alias("refused"),
    )


def _mean(pairs: DataFrame, by: str, prior: float, *more) -> DataFrame:
    """The mean of each score there is, by the number of occurrences, towards zero by ``prior``."""
    counted = F.sum(F.when(F.col("s0").isNotNull(), F.col("n"))) + prior
    means = [(F.sum(F.col("n") * F.col(f"s{k}")) / counted).alias(f"s{k}") for k in range(len(KINDS))]
    return pairs.groupBy(by).agg(*means, *more)


def bootstrap(tokens: DataFrame, rounds: int = 3, support: int = 3, prior: float = 1.0) -> DataFrame:
    """Scores ``s0`` … by kind of every ``value`` that is no seed.

    A pattern's confidence in a kind is the mean score of what it precedes,
    zero unless ``support`` different values with a score do; a value's score
    is the mean confidence of the patterns before it.  A pattern that fewer
    than ``support`` values speak for or against, with a score, as seeds or as
    failures of a check, says nothing and is left out of the mean.  Seeds keep
    score one, values that failed a check count against every kind.
    """
    scores = [f"s{k}" for k in range(len(KINDS))]
    links = store(
        tokens.select("value", F.explode("patterns").alias("pattern")).groupBy("value", "pattern").agg(F.count("*").alias("n")),
        "pattern-links",
    )
    ones = [F.max((F.col("seed") == k).cast("double")).alias(f"s{k}") for k in range(len(KINDS))]
    values = store(
        tokens.groupBy("value").agg(*ones, F.max(F.col("seed").isNotNull() | F.col("refused")).alias("fixed")).na.fill(0.0, scores),
        "values",
    )
    fixed, open_ = values.where("fixed"), values.where("not fixed").select("value", F.lit(False).alias("fixed"))
    now = values
    for _ in range(rounds):
        some = F.count(F.when(F.greatest(*scores) > 0, F.lit(1))).alias("some")
        sure = F.count(F.when((F.greatest(*scores) > 0) | F.col("fixed"), F.lit(1))).alias("sure")
        enough = [F.when(F.col("some") >= support, F.col(s)).otherwise(0.0).alias(s) for s in scores]
        patterns = _mean(links.join(now, "value"), "pattern", prior, some, sure).where(F.col("sure") >= support).select("pattern", *enough)
        heard = _mean(links.join(open_, "value").join(patterns, "pattern", "left"), "value", 0.0).na.fill(0.0, scores)
        now = store(fixed.unionByName(heard.withColumn("fixed", F.lit(False))), "values")
    return now.where("not fixed").select("value", *scores)


def find(
    df: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 3, support: int = 3, least: float = 0.8
) -> DataFrame:
    """``(key, base, found)``: spans ``(kind, start, end)`` of every row.

    ``base`` holds well-formed spans by kind and start, ``found`` tokens that
    patterns of confidence ``least`` or more precede on average.  Kinds are
    places in ``KINDS``; places are code points, the end exclusive.  A found
    span touches no base span and no match that failed its check.  Null and
    empty texts have no spans; repeated rows are searched alike and each
    counts; texts are searched whole, in time linear in their length.
    """
    kept = store(base(df, key, text), "matches")
    known = store(spans(kept), "spans")
    tokens = store(candidates(kept, known), "tokens")
    scores = [F.struct(F.col(f"s{k}").alias("score"), F.lit(-k).alias("kind")) for k in range(len(KINDS))]
    best = bootstrap(tokens, rounds, support).select("value", F.greatest(*scores).alias("best")).where(F.col("best.score") >= least)
    new = tokens.where("seed IS NULL AND NOT refused").join(best, "value")
    listed = F.array_sort(F.collect_list(F.struct("kind", "start", "end")))
    found = new.withColumn("kind", -F.col("best.kind")).groupBy("place").agg(listed.alias("found"))
    well = known.where("ok").groupBy("place").agg(listed.alias("base"))
    empty = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return (
        kept.select("place", F.col("key").alias(key))
        .join(well, "place", "left")
        .join(found, "place", "left")
        .select(key, F.coalesce("base", empty).alias("base"), F.coalesce("found", empty).alias("found"))
    )


def digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )
