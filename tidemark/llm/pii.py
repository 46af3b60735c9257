"""Personal data by bootstrapped extraction from contexts; SQL expressions only.

``scan`` finds e-mail addresses, IP addresses, card and telephone numbers by their forms, and further identifiers by where they stand:

1. Each text is searched once for each form, leftmost and without overlaps, and for candidates: runs of words with digits or an @ that no form covers. Matches that fail their check (a part over 255, the
   checksum, the number of digits) are no finds, and tell against contexts.
2. Seeds are the values found by form. A pattern is a lexical context: the two words before, the word before, or the words on both sides. Patterns and
   values are a bipartite graph; copies of a text, and repeats of a value in a context, are one edge.
3. A pattern's confidence in a kind is the lower end of Wilson's interval for the share of its values of that kind: values accepted in an earlier round count half, candidates not yet
   decided a tenth, others and failed ones in full. A candidate of a form the kind may have is scored by 1 - product(1 - confidence) over its
   patterns of one shape, the best shape counting, and accepted from ``ACCEPT``. Both steps are aggregates; there are ``ROUNDS`` of them.
4. Accepted values are added wherever they stand as candidates. Finds by form always stay.

Places are code points. Null texts are empty; an empty table gives an empty result; rows of equal texts get equal results whatever their ids, and are searched and counted once in the graph; other columns are kept, but those with the
names of results. The patterns for forms are written so that Java's matcher takes linear time and no recursion on texts of any length; they find what ``FORMS`` find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

KINDS = ("email", "ip", "card", "phone")
#: The forms as defined.
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same without a start in the middle of a run (but where the last match ended) and without a way back; cards only with the digits that a card may have.
FAST = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": FORMS["phone"],
}
#: A text without this has no match.
NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Words in a row with a digit, or one with an @.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9]*+[0-9]\S*+)*+"
#: Forms that an identifier of a kind may have, with the digits that it must and may have.
SHAPES = {
    "email": (r"^[^\s@]+@[^\s@]+$", 0, 64),
    "ip": (r"^(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}$|^[0-9]{1,3}(?:[.,:-][0-9]{1,3}){3}$", 1, 32),
    "card": (r"^[0-9](?:[\x20./_-]{0,2}[0-9])+$", 12, 19),
    "phone": (r"^[+(]?[0-9](?:[\x20()./-]{0,3}[0-9])+$", 6, 15),
}
#: Code points of an identifier at most, and of the text on either side that its context is taken from.
LONGEST, SIDE = 64, 64
#: Least confidence of a pattern that speaks, least score of a value that is accepted, weight of an undecided value and of one accepted earlier, and rounds.
SPEAKS, ACCEPT, UNDECIDED, EARLIER, ROUNDS = 0.5, 0.8, 0.1, 0.5, 3
_Z2 = 1.96**2


def _hits(text: Column, kind: str, pattern: str, needed: str) -> Column:
    """Matches of a pattern in order, each with the number of code points since the one before and what stands on both sides."""
    both = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("s")))  # bound once: every match takes its pieces from it

    def one(z, x, i):
        return F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("i"), F.length(z["s"][i]).cast("long").alias("gap"), x.alias("value"), _right(z["s"][i]).alias("before"), F.left(z["s"][i + 1], F.lit(SIDE)).alias("after"))

    found = F.transform(both, lambda z: F.transform(z["m"], lambda x, i: one(z, x, i)))[0]
    return F.when(text.rlike(needed), found)


def _right(x: Column) -> Column:
    return F.right(x, F.lit(SIDE))


def _digits(x: Column) -> Column:
    return F.length(F.regexp_replace(x, "[^0-9]", ""))


def luhn(value: Column) -> Column:
    """Whether the digits' checksum holds."""
    d = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def term(i):
        x = F.substring(d, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), term), F.lit(0), lambda a, b: a + b) % 10 == 0


def _holds() -> Column:
    """Whether a match passes the check of its kind."""
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    value, kind = F.col("value"), F.col("kind")
    return F.when(kind == "ip", value.rlike(rf"^{part}(?:\.{part}){{3}}$")).when(kind == "card", luhn(value)).when(kind == "phone", _digits(value).between(10, 15)).otherwise(True)


def _found(texts: DataFrame) -> DataFrame:
    """Matches and candidates of different texts (key, hits), with their places: (key, kind, start, end, value, ok, patterns). Candidates have the kind ``?``; those that a match covers are left out."""
    order = Window.partitionBy("key", "kind").orderBy("i")
    rows = texts.select("key", F.explode("hits").alias("h")).select("key", "h.*")
    rows = rows.withColumn("size", F.length("value").cast("long")).withColumn("skip", F.col("gap") + F.coalesce(F.lag("size").over(order), F.lit(0)))
    rows = rows.withColumn("start", F.sum("skip").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.filter((F.col("kind") != "?") | (F.col("size") <= 2 * LONGEST))
    # a candidate's own edges
    lead = F.when(F.col("kind") == "?", F.length(F.regexp_extract("value", "^[^A-Za-z0-9+(:]*", 0))).otherwise(0)
    bare = F.regexp_replace(F.regexp_replace("value", "^[^A-Za-z0-9+(:]+", ""), "[^A-Za-z0-9:]+$", "")
    rows = rows.withColumn("start", F.col("start") + lead).withColumn("value", F.when(F.col("kind") == "?", bare).otherwise(F.col("value")))
    rows = rows.filter("value <> ''").withColumn("end", F.col("start") + F.length("value"))
    running = (Window.unboundedPreceding, Window.currentRow)
    by_place, from_end = Window.partitionBy("key").orderBy("start").rangeBetween(*running), Window.partitionBy("key").orderBy(F.desc("start")).rangeBetween(*running)  # a frame up to the end would be gone through again for every row
    form = F.col("kind") != "?"
    covered = F.coalesce(F.max(F.when(form, F.col("end"))).over(by_place) > F.col("start"), F.lit(False))
    covered = covered | F.coalesce(F.min(F.when(form, F.col("start"))).over(from_end) < F.col("end"), F.lit(False))
    rows = rows.withColumn("covered", covered).filter(form | (~F.col("covered") & (F.length("value") <= LONGEST)))
    rows = rows.withColumn("ok", F.when(form, _holds()))
    may = F.array_compact(F.array(*[F.when(F.col("value").rlike(p) & _digits(F.col("value")).between(least, most), F.lit(k)) for k, (p, least, most) in SHAPES.items()]))
    rows = rows.withColumn("may", F.when(form, F.array().cast("array<string>")).otherwise(may)).filter(form | (F.size("may") > 0))
    return rows.select("key", "kind", "start", "end", "value", "ok", "may", _patterns().alias("patterns"))


def _patterns() -> Column:
    """The contexts of a match: lower case, digits as 0. Empty ones are none."""
    before, after = (F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.col(c)), "[0-9]+", "0"), r"\s+", " ")) for c in ("before", "after"))
    one, two = F.regexp_extract(before, r"\S+$", 0), F.regexp_extract(before, r"\S+ \S+$", 0)
    following = F.regexp_extract(after, r"^\S+", 0)
    return F.array_compact(F.array(F.when(one != "", F.concat(F.lit("1|"), one)), F.when(two != "", F.concat(F.lit("2|"), two)), F.when((one != "") & (following != ""), F.concat(F.lit("b|"), one, F.lit("|"), following))))


def wilson(good: Column, all_: Column) -> Column:
    """The lower end of Wilson's interval of 95 %, in millionths."""
    share = good / all_
    low = (share + _Z2 / (2 * all_) - F.sqrt(_Z2 * (share * (1 - share) / all_ + _Z2 / (4 * all_ * all_)))) / (1 + _Z2 / all_)
    return F.when(all_ > 0, F.round(low * 1e6)).otherwise(0).cast("long")


def accepted_values(edges: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT) -> DataFrame | None:
    """(value, as_kind): candidates that the graph's patterns speak for. ``edges``: distinct (pattern, kind, value, ok, may)."""
    taken = None
    for _ in range(rounds):
        now = edges.withColumn("as_kind", F.when(F.col("ok"), F.col("kind")))
        weight = F.when(F.col("kind") != "?", 1.0)
        if taken is not None:
            now = now.drop("as_kind").join(taken, "value", "left").withColumn("as_kind", F.when(F.col("kind") != "?", F.when(F.col("ok"), F.col("kind"))).otherwise(F.col("as_kind")))
            weight = weight.when(F.col("as_kind").isNotNull(), EARLIER)
        now = now.withColumn("weight", weight.otherwise(UNDECIDED))
        sums = now.groupBy("pattern").agg(F.sum("weight").alias("all"), *[F.sum(F.when(F.col("as_kind") == k, F.col("weight")).otherwise(0.0)).alias(k) for k in KINDS])
        told = F.explode(F.array(*[F.struct(F.lit(k).alias("of"), wilson(F.col(k), F.col("all")).alias("trust")) for k in KINDS]))
        patterns = sums.filter(" + ".join(KINDS) + " > 0").select("pattern", told.alias("t")).select("pattern", "t.*").filter(F.col("trust") >= int(SPEAKS * 1e6))
        patterns = materialise(patterns, "patterns")
        voiced = edges.filter("kind = '?'").join(patterns, "pattern").filter(F.array_contains("may", F.col("of")))
        doubt = -F.round(F.log(1 - F.least(F.col("trust"), F.lit(999_999)) / 1e6) * 1e6).cast("long")
        by_shape = voiced.groupBy("value", "of", F.substring("pattern", 1, 1).alias("shape")).agg(F.sum(doubt).alias("score"))
        best = by_shape.groupBy("value", "of").agg(F.max("score").alias("score"))
        rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(-i))])
        best = best.groupBy("value").agg(F.max_by("of", F.struct("score", rank[F.col("of")])).alias("as_kind"), F.max("score").alias("score"))
        sure = -F.round(F.log(F.lit(1 - accept)) * 1e6).cast("long")
        more = materialise(best.filter(F.col("score") >= sure).select("value", "as_kind"), "accepted")
        if more.isEmpty():
            return taken
        taken = more if taken is None else materialise(taken.unionByName(more.join(taken.select("value"), "value", "left_anti")), "accepted")
    return taken


def _text_of(spans: Column) -> Column:
    """Spans (start, rank, end) as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without its text, with n_email, n_ip, n_card, n_phone (finds by form), base_sha256 (of those finds' spans), n_added and spans (all of them)."""
    made = (*(f"n_{k}" for k in KINDS), "base_sha256", "n_added", "spans")
    rest = [c for c in df.columns if c not in (text, *made)]
    names = [f"_c{i}" for i in range(len(rest))]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    none = F.array().cast("array<struct<kind:string,i:bigint,gap:bigint,value:string,before:string,after:string>>")
    hits = F.concat(*[F.coalesce(_hits(whole, k, FAST[k], NEEDED[k]), none) for k in KINDS], F.coalesce(_hits(whole, "?", CANDIDATE, "[0-9@]"), none))
    searched = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rest, names, strict=True)], F.unhex(F.md5(whole)).alias("key"), hits.alias("hits"))
    searched = materialise(searched, "searched")
    # equal texts are one: a partial aggregate in each task before they are dealt out
    texts = searched.filter("size(hits) > 0").groupBy("key").agg(F.first("hits").alias("hits"))
    found = materialise(_found(texts), "found")
    edges = materialise(found.select(F.explode("patterns").alias("pattern"), "kind", "value", "ok", "may").distinct(), "edges")
    taken = accepted_values(edges)
    spans = found.filter("ok").select("key", "start", "end", "kind", F.lit(False).alias("added"))
    if taken is not None:
        spans = spans.unionByName(found.filter("kind = '?'").join(taken, "value").select("key", "start", "end", F.col("as_kind").alias("kind"), F.lit(True).alias("added")))
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    place = F.struct("start", rank[F.col("kind")].alias("rank"), "end")
    by_form = F.sort_array(F.collect_list(F.when(~F.col("added"), place)))
    per_text = spans.groupBy("key").agg(*[F.count_if((F.col("kind") == k) & ~F.col("added")).alias(f"n_{k}") for k in KINDS], F.sha2(_text_of(by_form), 256).alias("base_sha256"), F.count_if("added").alias("n_added"), _text_of(F.sort_array(F.collect_list(place))).alias("spans"))
    per_text = materialise(per_text, "spans")
    out = searched.drop("hits").join(per_text, "key", "left")
    empty = {**{f"n_{k}": F.lit(0).cast("long") for k in KINDS}, "base_sha256": F.sha2(F.lit(""), 256), "n_added": F.lit(0).cast("long"), "spans": F.lit("")}
    return out.select(*[F.col(n).alias(c) for c, n in zip(rest, names, strict=True)], *[F.coalesce(c, v).alias(c) for c, v in empty.items()])
