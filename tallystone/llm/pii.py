"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Fixed patterns give seed entities. The two words before a seed, and the last of them alone, are lexical patterns. A
graph of patterns and instances is scored in rounds: a pattern by the confidence of its instances, against all places of the
corpus where its words stand before another word; an instance by its patterns. Patterns of high confidence then take in
identifiers of a plausible shape that no fixed pattern covers. What a kind's own check refutes is never taken in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import last_words, total, with_matches
from .common import masked, materialise, small, with_row_key

#: Where so many texts or fewer hold personal data, their spans are broadcast, and texts stay where they are.
MOST_BROADCAST = 200_000
KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, written so that Java's matcher neither backtracks over nor recurses into long runs: a run
#: is entered at its start or where the last match ended, and its repetitions are possessive.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match: a cheap test before the costly ones.
GUARDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: F.contains(t, F.lit("+")) & t.rlike(r"\+[0-9]"),
}
#: Tokens with a digit or @, and number groups that follow them.
CANDIDATE = r"(?<!\S)(?=\S*?[0-9@])\S++(?:\x20[(]?[0-9]\S*+)*+"
#: Shapes that an identifier without a fixed pattern may have, by kind.
SHAPES = {
    "email": r"^[^\s@]+(?:@|\(at\)|\[at\])[^\s@]+$",
    "ip": r"^[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]*){3,7}$",
    "card": r"^(?:[0-9][\x20.-]?){12,19}$",
    "phone": r"^[+(]?(?:[0-9][\x20().-]{0,2}){7,15}$",
}


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    back = F.reverse(digits(m))
    worth = F.transform(
        F.sequence(F.lit(1), F.length(back)),
        lambda i: F.when(i % 2 == 1, F.substring(back, i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(back, i, F.lit(1)).cast("int") + 1)),
    )
    return total(worth) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(m)).otherwise(False)
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def refuted(kind: str, m: Column) -> Column:
    """Whether m has the form that the kind's own check is made for, and fails it."""
    n = F.length(digits(m))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), ~luhn(m)).otherwise(False)
    if kind == "ip":
        return m.rlike(r"^[0-9]+(?:\.[0-9]+){3}$") & ~valid("ip", m)
    if kind == "phone":
        return F.startswith(m, F.lit("+")) & ~valid("phone", m)
    return F.lit(False)


def plausible(m: Column) -> Column:
    """The kinds whose shape m has, and whose check doesn't refute it."""
    return F.array_compact(F.array(*[F.when(m.rlike(SHAPES[kind]) & ~refuted(kind, m), F.lit(k)) for k, kind in enumerate(KINDS)]))


def base_spans(rows: DataFrame, keep: list[str], text: str) -> DataFrame:
    """keep columns, base (spans by fixed pattern) and loose (tokens with a digit or @ that no base span touches).

    Spans are struct(start, k, end, hit, before), with k the kind's place in KINDS; loose ones have k -1.
    """
    df = rows.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    for kind in KINDS:
        df = with_matches(df, f"_{kind}", "_text", PATTERNS[kind], GUARDS[kind](F.col("_text")), words=2)
    df = with_matches(df, "_loose", "_text", CANDIDATE, F.col("_text").rlike("[0-9@]"), words=2)
    span = lambda k: lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"), x["hit"].alias("hit"), x["before"].alias("before"))
    passes = lambda kind: lambda x: valid(kind, x["hit"])
    empty = F.array().cast("array<struct<start:int,k:int,end:int,hit:string,before:string>>")
    parts = [F.coalesce(F.transform(F.filter(f"_{kind}", passes(kind)), span(k)), empty) for k, kind in enumerate(KINDS)]
    df = df.withColumn("base", F.array_sort(F.concat(*parts)))
    free = F.filter("_loose", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    trimmed = F.transform(free, span(-1))
    lead = lambda x: F.length(F.regexp_extract(x["hit"], r"^[^0-9A-Za-z+(@]*", 0))
    core = lambda x: F.regexp_extract(x["hit"], r"^[^0-9A-Za-z+(@]*(.*?)[^0-9A-Za-z)]*$", 1)
    shorn = F.transform(trimmed, lambda x: F.struct((x["start"] + lead(x)).alias("start"), x["k"].alias("k"), (x["start"] + lead(x) + F.length(core(x))).alias("end"), core(x).alias("hit"), x["before"].alias("before")))
    return df.select(*keep, "base", F.coalesce(F.filter(shorn, lambda x: F.length(x["hit"]) > 4), empty).alias("loose"))


def contexts(spans: DataFrame) -> DataFrame:
    """Adds pattern: the two words before a span and the last of them, lower-cased, digits as 0; one row each."""
    tail = lambda n: F.regexp_replace(F.regexp_replace(F.lower(last_words(F.col("before"), n)), "[0-9]", "0"), r"\s+", " ")
    both = F.when(F.trim("before").rlike(r"\s"), F.concat(F.lit("2 "), tail(2)))
    return spans.withColumn("pattern", F.explode(F.array_compact(F.array(both, F.concat(F.lit("1 "), tail(1)))))).where(F.length("pattern") > 2)


def occurrences(rows: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """pattern, total: in how many places of all texts the words of each pattern stand before another word.

    Up to MOST_BROADCAST patterns are looked up where the texts are, so that only their counts are shuffled.
    """
    wanted = patterns.select("pattern", F.regexp_extract("pattern", r"(\S+)$", 1).alias("tail"))
    n = wanted.count()
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "[0-9]", "0")
    words = rows.select(F.regexp_extract_all(plain, F.lit(r"\S+"), F.lit(0)).alias("ws")).where(F.size("ws") > 1)
    places = F.transform(F.sequence(F.lit(0), F.size("ws") - 2), lambda i: F.struct(F.get("ws", i - 1).alias("lead"), F.get("ws", i).alias("tail")))
    pairs = words.select(F.inline(places))
    held = F.explode(F.array_compact(F.array(F.concat(F.lit("1 "), F.col("tail")), F.concat(F.lit("2 "), F.col("lead"), F.lit(" "), F.col("tail"))))).alias("pattern")
    if n > MOST_BROADCAST:  # counted within tasks before the shuffle
        return pairs.select(held).groupBy("pattern").agg(F.count("*").alias("total")).join(wanted, "pattern", "left_semi")
    found = pairs.join(F.broadcast(wanted.select("tail").distinct()), "tail", "left_semi").select(held)
    return found.join(F.broadcast(wanted.select("pattern")), "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("total"))


def score_patterns(edges: DataFrame, rounds: int = 3, least_seeds: int = 5, sure: float = 0.8) -> DataFrame:
    """k, pattern, confidence of the patterns that have least_seeds different sure instances and a confidence of sure or more.

    edges: k, pattern, instance, seed (0/1), n (how often), total (of the pattern), one row each. A pattern's confidence is the sum of
    n times its instances' over its total plus one; an instance that isn't a seed has 1 - product(1 - confidence) over its patterns. In the
    first round only seeds are sure; in each later one so are the identifiers that the former round's patterns found,
    and they support patterns of their own, which may hold no seed at all.
    """
    belief = edges.withColumn("c", F.col("seed").cast("double"))
    for left in range(rounds, 0, -1):
        confidence = F.sum(F.col("c") * F.col("n")) / (F.greatest(F.max("total"), F.sum("n")) + 1)
        patterns = belief.groupBy("k", "pattern").agg(confidence.alias("confidence"), F.count_if(F.col("c") >= sure).alias("seeds"))
        strong = patterns.where(F.col("seeds") >= least_seeds)
        if left == 1:
            return strong.where(F.col("confidence") >= sure).select("k", "pattern", "confidence")
        odds = edges.join(strong, ["k", "pattern"]).groupBy("k", "instance").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("p"))
        belief = edges.join(odds, ["k", "instance"], "left").withColumn("c", F.when(F.col("seed") == 1, 1.0).otherwise(F.coalesce("p", F.lit(0.0))))
    return belief


def learn(spans: DataFrame, rows: DataFrame, text: str, least_seeds: int = 5, **how) -> DataFrame:
    """score_patterns() over the table of base_spans() of rows. Patterns of fewer than least_seeds instances can't become sure and are left out."""
    seeds = contexts(spans.select(F.inline("base")).withColumn("seed", F.lit(1)))
    loose = spans.select(F.inline("loose")).withColumn("k", F.explode(plausible(F.col("hit")))).withColumn("seed", F.lit(0))
    both = seeds.unionByName(contexts(loose.select(seeds.drop("pattern").columns)))
    edges = both.groupBy("k", "pattern", F.xxhash64(F.lower("hit")).alias("instance")).agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    edges = materialise(edges, "edges")
    able = materialise(edges.groupBy("k", "pattern").agg(F.count("*").alias("met")).where(F.col("met") >= least_seeds).select("pattern").distinct(), "able")
    totals = occurrences(rows, text, able)
    return score_patterns(materialise(edges.join(totals, "pattern"), "edges"), least_seeds=least_seeds, **how)


def added_spans(spans: DataFrame, patterns: DataFrame, key: str) -> DataFrame:
    """key and added, the array of spans that patterns give to loose tokens of a plausible shape; of several kinds the surest."""
    loose = spans.select(key, F.inline("loose")).withColumn("k", F.explode(plausible(F.col("hit"))))
    sure = contexts(loose).join(patterns, ["k", "pattern"]).groupBy(key, "start", "end").agg(F.max_by("k", F.struct("confidence", -F.col("k"))).alias("k"))
    return sure.groupBy(key).agg(F.collect_list(F.struct("start", "k", "end")).alias("added"))


def all_spans(rows: DataFrame, keep: list[str], text: str, **how) -> DataFrame:
    """_row, keep columns, base and all_spans: sorted arrays of struct(start, k, end). rows have a unique _row."""
    spans = materialise(base_spans(rows, ["_row", *keep], text), "spans")
    added = added_spans(spans, learn(spans, rows, text, **how), "_row")
    slim = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end")))
    joined = spans.withColumn("base", slim).join(added, "_row", "left")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,k:int,end:int>>"))))
    return joined.select("_row", *keep, "base", every.alias("all_spans"))


def extract(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, base and all_spans of every row.

    Null and empty texts have no spans, very long ones are searched whole. Positions are code points, ends exclusive.
    Repeated rows are searched one by one; of several kinds for one token the surest wins, then the first of KINDS. An
    empty table gives an empty result; other columns of docs don't matter.
    """
    rows = with_row_key(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "doc_id")
    return all_spans(rows, ["doc_id"], "_text", **how).drop("_row")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets. spans are sorted."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    step = lambda s, x: F.struct(
        F.greatest(s["at"], x["end"]).alias("at"),
        F.when(x["start"] >= s["at"], F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.element_at(names, x["k"] + 1))).otherwise(s["out"]).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs, with personal data in text replaced by [EMAIL], [IP], [CARD] or [PHONE]; null texts stay null.

    Very long texts are searched whole, repeated rows one by one; an empty table stays empty; columns keep their names.
    """
    hidden, names = masked(docs)
    at = dict(zip(docs.columns, names))
    rows = with_row_key(hidden, at[doc_id])
    spans = materialise(all_spans(rows, [], at[text], **how).where(F.size("all_spans") > 0).select("_row", "all_spans"), "redactions")
    spans = small(spans, spans.count(), MOST_BROADCAST)
    new = F.when(F.col("all_spans").isNotNull(), redacted(F.col(at[text]), F.col("all_spans"))).otherwise(F.col(at[text]))
    return rows.join(spans, "_row", "left").withColumn(at[text], new).select(*names).toDF(*docs.columns)
