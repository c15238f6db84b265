"""Personal data by rules and bootstrapped contextual extraction.

Four kinds are found by rule: e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers. They are seeds.
Seeds induce two kinds of lexical patterns: the two words before them, and the word before with the word after. Words
that look like identifiers but that no rule matched, and runs of numbers joined by single blanks, are candidates, with
their patterns. Patterns and instances form a graph, one edge per distinct (pattern, instance) with its occurrences. In
each round a pattern's confidence in a kind is the share of all places in the corpus where its words stand, whatever
they surround, that hold a known instance of the kind; patterns with enough distinct known instances and confidence are
taken, and candidates score one minus the product of their patterns' doubts; those above the threshold, of a shape that
the kind allows, become known. At the end the candidates that stand in a taken pattern are spans as well. All steps are
DataFrame functions, and the graph lives in tables. Places are counted over all texts, for patterns that could be taken if
all candidates of a kind's shape were known; where there is none, nothing can be taken and the texts aren't read again.

The regular expressions are written so that Java's matcher stays linear and doesn't recurse: repeated groups are
possessive, and a match starts only where a run of its characters does or where the last match ended.

Defined results: a null text is empty; equal rows have equal spans; offsets are code points, ends exclusive; an empty
table gives no rows; other columns are not looked at, and `redact` returns all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty, unused

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text of the kind must contain: a cheap test before the matcher runs.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Pieces of numbers, each a word up to marks that end it, joined by single blanks.
_PIECE = r"[(+]?+[0-9][0-9().+/-]*+(?=[\"',;:!?\]>}]*+(?:[\x20\x09-\x0D]|$))"
RUN = rf"(?<![^\x20\x09-\x0D\"'\[<{{]){_PIECE}(?:\x20{_PIECE})++"
#: Code points beyond which values and contexts are kept as hashes.
LONGEST = 64
#: Matches whose places are added up at once.
CHUNK = 256
#: The most rows, patterns or spans, that are sent to all executors.
SEND = 1_000_000
_WS, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
SPANS = "array<struct<kind:int,start:int,stop:int>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(_digits(text))
    return n.between(8, 15) if kind == "phone" else F.when(n.between(16, 19), _luhn(_digits(text))).otherwise(False)


def once(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern with their places: array<struct<start,stop,value,before,after>>. The text between matches
    gives the places; they are added up in chunks, so many matches in one text stay affordable. before: the text from the
    last match but one to this one, in which the words before it stand; after: likewise."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,stop:int,value:string,before:string,after:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        row = F.struct(start.alias("start"), (start + F.length(x["value"])).alias("stop"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct((start + F.length(x["value"])).alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    def placed(values: Column) -> Column:
        def over(gaps: Column) -> Column:
            part = lambda a, i: F.when(i >= 0, F.get(a, i)).otherwise("")
            before = lambda i: F.concat(part(values, i - 2), part(gaps, i - 1), part(values, i - 1), F.get(gaps, i))
            after = lambda i: F.concat(F.get(gaps, i + 1), F.coalesce(F.get(values, i + 1), F.lit("")), F.coalesce(F.get(gaps, i + 2), F.lit("")))
            rows = F.transform(values, lambda v, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), v.alias("value"), before(i).alias("before"), after(i).alias("after")))
            parts = lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / CHUNK).cast("int")), lambda c: F.slice(r, c * CHUNK + 1, F.lit(CHUNK)))
            return once(once(rows, parts), chunked)

        return once(F.split(text, pattern, -1), over)

    def chunked(parts: Column) -> Column:
        total = lambda p: F.aggregate(p, F.lit(0), lambda s, x: s + x["gap"] + F.length(x["value"]))
        ahead = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, p: F.struct((acc["at"] + total(p)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(parts, ahead, lambda p, at: F.aggregate(p, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])))

    return once(found, lambda f: F.when(F.size(f) > 0, placed(f)).otherwise(none))


def rule_matches(text: Column) -> Column:
    """array<struct<kind,start,stop,value>> by kind, then start."""
    none = F.array().cast("array<struct<kind:int,start:int,stop:int,value:string,before:string,after:string>>")

    def of(number: int, kind: str) -> Column:
        ok = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
        typed = F.transform(ok, lambda m: F.struct(F.lit(number).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), m["value"].alias("value"), m["before"].alias("before"), m["after"].alias("after")))
        return F.when(F.contains(text, F.lit(HINTS[kind])), typed).otherwise(none) if kind in HINTS else typed

    return F.concat(*[of(i, k) for i, k in enumerate(KINDS)])


def _contexts(m: Column) -> Column:
    """The patterns that a match stands in, in lower case with single blanks: the two words before it; the word before it,
    _ and the word after it. A match that begins within a word has none."""
    two = F.regexp_replace(F.regexp_extract(m["before"], rf"(?:^|{_WS})({_WORD}++{_WS}++{_WORD}++){_WS}++$", 1), rf"{_WS}++", " ")
    one = F.regexp_extract(m["before"], rf"({_WORD}++){_WS}++$", 1)
    next_ = F.regexp_extract(m["after"], rf"^{_WORD}*+{_WS}++({_WORD}++)", 1)
    around = F.when((one != "") & (next_ != ""), F.concat(one, F.lit(" _ "), next_)).otherwise("")
    return F.transform(F.filter(F.array(two, around), lambda c: c != ""), lambda c: _bounded(F.lower(c)))


def _bounded(value: Column) -> Column:
    return F.when(F.length(value) > LONGEST, F.sha2(value, 256)).otherwise(value)


def _shape(kind: Column, value: Column) -> Column:
    """Whether a candidate could be of the kind."""
    n = F.length(_digits(value))
    return (
        F.when(kind == 0, value.rlike("^[^@]+@[^@]+$"))
        .when(kind == 1, value.rlike("^[0-9A-Fa-f]+(?:[.:]+[0-9A-Fa-f]+){3,7}$"))
        .when(kind == 2, n.between(12, 19) & value.rlike("^[0-9 -]+$"))
        .otherwise(n.between(7, 15) & value.rlike("^[0-9() .+/-]+$"))
    )


def occurrences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_id, base (rule matches with contexts) and candidates of each row, without texts."""
    body = text_or_empty(text)
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_id"), body.alias("text"))
    rows = rows.withColumn("found", rule_matches(F.col("text"))).withColumn("words", matches(F.col("text"), CANDIDATE))
    rows = rows.withColumn("runs", F.when(F.col("text").rlike(RUN), matches(F.col("text"), RUN)).otherwise(F.filter("words", lambda m: F.lit(False))))
    base = F.transform("found", lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), _bounded(F.lower(m["value"])).alias("value"), _contexts(m).alias("contexts")))
    lead, tail = "\"'([<{", "\"'),.;:!?]>}"

    def cored(m: Column, cut: Column, value: Column) -> Column:
        start = m["start"] + F.length(m["value"]) - F.length(cut)
        shape = F.array(*[_shape(F.lit(k), value) for k in range(len(KINDS))])
        return F.struct(start.alias("start"), (start + F.length(value)).alias("stop"), _bounded(F.lower(value)).alias("value"), shape.alias("shape"), _contexts(m).alias("contexts"))

    def core(m: Column) -> Column:
        cut = F.ltrim(m["value"], F.lit(lead))
        return cored(m, cut, F.rtrim(cut, F.lit(tail)))

    def core_of_run(m: Column) -> Column:
        """Brackets around all of a run go, those within stay."""
        cut = F.when(m["value"].rlike(r"^\([^()]*+\)?+[.+/-]*+$"), F.substring(m["value"], F.lit(2), F.length(m["value"]))).otherwise(m["value"])
        value = F.rtrim(cut, F.lit(".(+/-"))
        return cored(m, cut, F.when(F.contains(value, F.lit("(")), value).otherwise(F.rtrim(value, F.lit(").(+/-"))))

    free = lambda c: F.filter(c, lambda m: ~F.exists("found", lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"])))
    shaped = lambda c: F.exists(c["shape"], lambda x: x)
    rows = rows.select("doc_id", "text_id", base.alias("base"), F.transform(free("words"), core).alias("words"), F.filter(F.transform(free("runs"), core_of_run), shaped).alias("runs"))
    # a word of no shape that lies in a run is a part of an instance, not one of its own
    own = F.filter("words", lambda c: shaped(c) | ~F.exists("runs", lambda r: (r["start"] <= c["start"]) & (c["stop"] <= r["stop"] + 1)))
    return rows.select("doc_id", "text_id", "base", F.filter(F.concat(own, "runs"), lambda c: (c["value"] != "") & (F.size(c["contexts"]) > 0)).alias("candidates"))


def places(df: DataFrame, text: str, contexts: DataFrame) -> DataFrame:
    """context, places: how often the words of a pattern (context) stand in the texts of df, with a word where a match
    would be."""
    words = F.filter(F.split(F.lower(text_or_empty(text)), rf"{_WS}++"), lambda w: w != "")
    # the words before a word, and those around one
    before = lambda w: F.transform(F.slice(w, F.lit(3), F.size(w)), lambda _, i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1)))
    around = lambda w: F.transform(F.slice(w, F.lit(3), F.size(w)), lambda _, i: F.concat(F.get(w, i), F.lit(" _ "), F.get(w, i + 2)))
    found = df.select(F.explode(once(words, lambda w: F.concat(before(w), around(w)))).alias("context")).select(_bounded(F.col("context")).alias("context"))
    if contexts.count() <= SEND:
        return found.join(F.broadcast(contexts), "context").groupBy("context").agg(F.count("*").alias("places"))
    return found.groupBy("context").agg(F.count("*").alias("places")).join(contexts, "context")


def bootstrap(scratch: Scratch, df: DataFrame, text: str, found: DataFrame, rounds: int = 3, support: int = 5, confidence: float = 0.9, threshold: float = 0.8) -> DataFrame | None:
    """context, kind, confidence of the patterns that are taken in the last round; None if no pattern has the support."""
    seeds = found.select(F.explode("base").alias("m")).select(F.explode("m.contexts").alias("context"), "m.value", "m.kind", F.lit(None).cast("array<boolean>").alias("shape"))
    others = found.select(F.explode("candidates").alias("m")).select(F.explode("m.contexts").alias("context"), "m.value", F.lit(None).cast("int").alias("kind"), "m.shape")
    edges = scratch.stage(seeds.unionByName(others).groupBy("context", "value").agg(F.min("kind").alias("seed"), F.max("shape").alias("shape"), F.count("*").alias("n")), "edges")
    # what may ever be known as of a kind: its seeds, and candidates of its shape
    may = [(F.col("seed") == k) | (F.col("seed").isNull() & F.get("shape", F.lit(k))) for k in range(len(KINDS))]
    each = [F.struct(F.count_if(m).alias("distinct"), F.coalesce(F.sum(F.when(m, F.col("n"))), F.lit(0)).alias("n")) for m in may]
    totals = edges.groupBy("context").agg(F.sum("n").alias("least"), F.array(*each).alias("kinds"))
    supported = totals.filter(F.exists("kinds", lambda k: (k["distinct"] >= support) & (k["n"] >= confidence * F.col("least")))).select("context", "least")
    supported = scratch.stage(supported, "supported")
    if supported.isEmpty() or edges.filter("seed is not null").isEmpty():
        return None
    stand = places(df, text, supported.select("context"))
    # runs of several words are not places of one word, but places all the same
    stand = scratch.stage(supported.join(stand, "context", "left").select("context", F.greatest("least", "places").alias("places")), "places")
    edges = edges.join(stand, "context")
    known = edges.filter("seed is not null").groupBy("value").agg(F.min("seed").alias("kind"))
    for r in range(rounds):
        known = scratch.stage(known, f"known{r}")
        by_kind = edges.join(known, "value").groupBy("context", "kind").agg(F.count("*").alias("distinct"), F.sum("n").alias("n"), F.first("places").alias("places"))
        sure = F.col("n") / F.col("places")
        taken = by_kind.filter((F.col("distinct") >= support) & (sure >= confidence))
        taken = scratch.stage(taken.groupBy("context").agg(F.max_by(F.struct("kind", "n", "places"), F.struct("n", -F.col("kind"))).alias("t")).select("context", "t.kind", (F.col("t.n") / (F.col("t.places") + 1)).alias("confidence")), f"patterns{r}")
        doubt = edges.join(known.select("value"), "value", "left_anti").join(taken, "context").filter(F.get("shape", F.col("kind")))
        scored = doubt.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        fresh = scored.filter(F.col("score") >= threshold).groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
        known = known.unionByName(fresh)
    return taken


def discovered(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """doc_id, text_id, added: spans of candidates in taken patterns; only of documents that have any."""
    rows = found.filter(F.size("candidates") > 0).select("doc_id", "text_id", F.explode("candidates").alias("c")).select("doc_id", "text_id", "c.start", "c.stop", "c.shape", F.explode("c.contexts").alias("context"))
    hit = rows.join(patterns, "context").filter(F.get("shape", F.col("kind")))
    return hit.groupBy("doc_id", "text_id").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "stop"))).alias("added"))


def _plain(spans: str | Column) -> Column:
    return F.transform(spans, lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["stop"].alias("stop")))


def _found(df: DataFrame, key: str, text: str, how: dict) -> tuple[Scratch, DataFrame, DataFrame | None]:
    """The occurrences and, if there are any, the added spans."""
    scratch = Scratch(df.sparkSession)
    found = scratch.stage(occurrences(df, key, text), "occurrences")
    patterns = bootstrap(scratch, df, text, found, **how)
    added = scratch.stage(discovered(found, patterns), "added") if patterns is not None else None
    scratch.close(keep=[t for t in (found, added) if t is not None])
    return scratch, found, added


def find(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, base and spans (all) of each row, by kind, then start."""
    _, found, added = _found(df, key, text, how)
    if added is None:
        return found.select("doc_id", _plain("base").alias("base"), _plain("base").alias("spans"))
    same = found["doc_id"].eqNullSafe(added["doc_id"]) & (found["text_id"] == added["text_id"])
    rows = found.join(added, same, "left").select(found["doc_id"], _plain("base").alias("base"), "added")
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPANS)))).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the bracketed name of its first kind."""
    merged = F.aggregate(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))),
        F.array().cast("array<struct<start:int,stop:int,kind:int>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] > s["start"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], s["stop"]).alias("stop"), F.element_at(acc, -1)["kind"].alias("kind"))))).otherwise(F.concat(acc, F.array(s))),
    )
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def rebuilt(m: Column) -> Column:
        parts = F.transform(m, lambda s, i: F.concat(F.substring(text, F.when(i == 0, 0).otherwise(F.get(m, i - 1)["stop"]) + 1, s["start"] - F.when(i == 0, 0).otherwise(F.get(m, i - 1)["stop"])), F.get(names, s["kind"])))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(m, -1)["stop"] + 1, F.length(text)))

    return F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, F.transform(F.array(merged), rebuilt)[0]).otherwise(text)


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """All rows and columns, with personal data replaced in the texts. Spans are joined by key and text; where they are too
    many to be sent to all executors, the rules are applied anew, and only added spans are joined."""
    scratch, found, added = _found(df, key, text, how)
    owner, hashed, spans = unused(df, "owner", "hashed", "spans")
    rows = found.filter(F.size("base") > 0).select("doc_id", "text_id", F.explode(_plain("base")).alias("s"))
    if added is not None:
        rows = rows.unionByName(added.select("doc_id", "text_id", F.explode("added").alias("s")))
    rows = scratch.stage(rows.distinct(), "spans")  # equal rows have equal spans
    few = rows.count() <= SEND
    if not few and added is not None:
        rows = added.select("doc_id", "text_id", F.explode("added").alias("s"))
    side = rows.groupBy(F.col("doc_id").alias(owner), F.col("text_id").alias(hashed)).agg(F.array_sort(F.collect_set("s")).alias(spans))
    if few or added is not None:
        side = scratch.stage(side, "span-lists")
        side = F.broadcast(side) if few or added.agg(F.sum(F.size("added"))).first()[0] <= SEND else side
        out = df.join(side, df[key].cast("long").eqNullSafe(side[owner]) & (F.xxhash64(text_or_empty(text)) == side[hashed]), "left")
    else:
        out = df.withColumn(spans, F.lit(None).cast(SPANS))
    if not few:
        out = out.withColumn(spans, F.concat(_plain(rule_matches(text_or_empty(text))), F.coalesce(spans, F.array().cast(SPANS))))
    return out.withColumn(text, redacted(F.col(text), F.col(spans))).select(df.columns)
