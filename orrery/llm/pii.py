"""Personal data by bootstrapped contextual extraction (operator 7), with DataFrame and SQL functions only.

Base matches of four kinds are the seeds. An instance is a run of words with a digit or an at sign, and its anchor the last word
of letters before it; anchor and class (with an at sign, five digits or more, fewer) make its lexical pattern. Patterns and
instances form a bipartite graph that is scored in a few rounds. A pattern's confidence is the share of its anchor's occurrences
in all texts that its instances' scores make up, so an everyday word before a number induces nothing; an instance's score is the
best confidence of its patterns, and seeds stay at one. Instances that no base match covers and that patterns of high confidence,
with enough distinct seeds of one kind, reach are added as that kind; base spans always stay.

Offsets are code points, ends exclusive. A pattern's matches and the gaps between them come from one regular expression, so the
offsets are sums of lengths.

Defined results
    * null and empty texts have no spans; repeated rows give repeated results; a null doc_id is kept as it is
    * a pattern with as many seeds of two kinds takes the kind listed first, if that one has the share asked for
    * an instance without a word of letters before it, after the last instance, has no pattern
    * where spans overlap `redact` replaces the earlier one and what the later has beyond it
    * an empty table gives an empty result; further columns are ignored by `find` and kept by `redact`
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, whole_text

#: The base patterns. A match begins where the one before ended or where no character of its first class precedes
#: it, which finds the same matches without reading long runs again from each of their characters.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"(?:\G|(?<![0-9]))(?=[0-9][\x20-]?[0-9])[0-9]++(?:[\x20-][0-9]++)*+", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
KINDS = tuple(PATTERNS)
_MARKED = r"[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
INSTANCE = rf"(?:\G|(?<![^\x20\x09-\x0D])){_MARKED}(?:\x20{_MARKED})*+"
LETTERS, LAST_LETTERS = r"\p{L}++", r"(?<!\p{L})(\p{L}++)[^\p{L}]*+$"


def none() -> Column:
    return F.expr("cast(array() as array<struct<start:int,end:int,kind:int>>)")


def no_instance() -> Column:
    return F.expr("cast(array() as array<struct<start:int,end:int,word:string,anchor:string>>)")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit is right: every second digit from the right counts double, less 9 if over 9."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    n = F.length(_digits(hit))
    if kind == "ip":
        small = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(small, lambda p: (F.length(p) <= 3) & (F.coalesce(F.try_to_number(p, F.lit("999")), F.lit(0)) <= 255))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), luhn(_digits(hit))).otherwise(F.lit(False))
    return (n >= 9) & (n <= 15) if kind == "phone" else F.lit(True)


def _located(text: Column, pattern: str, make, empty: Column, kept) -> Column:
    """make(start, end, hit, gap) of the matches for which kept(hit)."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    zipped = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("h"), g.alias("g")))

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + F.length(x["g"])
        b = a + F.length(x["h"])
        return F.struct(b.alias("at"), F.when(kept(x["h"]), F.concat(s["out"], F.array(make(a, b, x["h"], x["g"])))).otherwise(s["out"]).alias("out"))

    return F.when(F.size(hits) == 0, empty).otherwise(F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"]))


def base_spans(text: Column) -> Column:
    """array of (start, end, kind number), in the order of start and kind."""
    found = []
    for k, (kind, (pattern, sign)) in enumerate(PATTERNS.items()):
        spans = _located(
            text, pattern, lambda a, b, h, g, k=k: F.struct(a.alias("start"), b.alias("end"), F.lit(k).alias("kind")), none(), lambda h, kind=kind: _valid(kind, h)
        )
        gate = F.contains(text, F.lit(sign)) if sign else text.rlike("[0-9][0-9 -]")
        found.append(F.when(gate, spans).otherwise(none()))
    by = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])
    return F.array_sort(F.concat(*found), by)


def instances(text: Column) -> Column:
    """array of (start, end, word, anchor) of the runs of words with a digit or an at sign, marks at both ends left out."""

    def make(a: Column, b: Column, h: Column, g: Column) -> Column:
        lead, tail = (F.length(F.regexp_extract(h, p, 0)) for p in (r"^[^\p{L}\p{N}+(]*", r"[^\p{L}\p{N})]*$"))
        word = F.substring(h, lead + 1, F.greatest(F.length(h) - lead - tail, F.lit(0)))
        return F.struct((a + lead).alias("start"), F.greatest(b - tail, a + lead).alias("end"), word.alias("word"), F.lower(F.regexp_extract(g, LAST_LETTERS, 1)).alias("anchor"))

    return F.when(text.rlike("[0-9@]"), _located(text, INSTANCE, make, no_instance(), lambda h: F.lit(True))).otherwise(no_instance())


def word_class(word: Column) -> Column:
    """With an at sign 2, with five digits or more 1, else 0."""
    return F.when(F.contains(word, F.lit("@")), 2).otherwise((F.length(_digits(word)) >= 5).cast("int"))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _base(docs: DataFrame) -> DataFrame:
    text = whole_text()
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), base_spans(text).alias("base"), instances(text).alias("inst"))
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()), "base")


def occurrences(docs: DataFrame) -> DataFrame:
    """anchor and n, how often each word of letters occurs in all texts."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(whole_text()), F.lit(LETTERS), F.lit(0))).alias("anchor"))
    return words.groupBy("anchor").agg(F.count(F.lit(1)).alias("all"))


def discovered(docs: DataFrame, base: DataFrame, rounds: int = 3, confidence: float = 0.6, least_seeds: int = 3, purity: float = 0.8) -> DataFrame:
    """row and the added spans of the rows that have any."""
    hit = F.filter("base", lambda s: (s["start"] < F.col("i.end")) & (F.col("i.start") < s["end"]))
    inst = base.select("row", "base", F.explode("inst").alias("i")).filter("i.anchor <> '' AND i.word <> ''")
    inst = inst.select("row", "i.start", "i.end", "i.anchor", F.sha2("i.word", 256).alias("word"), word_class(F.col("i.word")).alias("class"), F.get(hit, F.lit(0))["kind"].alias("kind"))
    inst = materialise(inst.filter("class > 0"), "instances")
    edges = inst.groupBy("anchor", "class", "word").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("kind"))
    of = [F.count_if(F.col("kind") == k).alias(f"k{k}") for k in range(len(KINDS))]
    known = edges.groupBy("anchor", "class").agg(*of, F.sum(F.when(F.col("kind").isNotNull(), F.col("n"))).alias("met"))
    counts, seeds = F.array(*[f"k{k}" for k in range(len(KINDS))]), sum(F.col(f"k{k}") for k in range(len(KINDS)))
    known = known.filter((seeds >= least_seeds) & (F.array_max(counts) >= purity * seeds))
    known = known.select("anchor", "class", "met", (F.array_position(counts, F.array_max(counts)) - 1).cast("int").alias("kind"))
    # patterns that may qualify, with what their anchors' occurrences are shared out over
    known = materialise(known.join(occurrences(docs), "anchor"), "patterns")
    patterns = known.select("anchor", "class", (F.col("met") / (F.col("all") + 1)).alias("p"))
    edges = materialise(edges.join(known.select("anchor", "class", "all"), ["anchor", "class"]), "graph")
    for _ in range(rounds - 1):
        scores = edges.join(patterns, ["anchor", "class"]).groupBy("word").agg(F.max(F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.col("p"))).alias("score"))
        patterns = materialise(edges.join(scores, "word").groupBy("anchor", "class").agg((F.sum(F.col("n") * F.col("score")) / (F.first("all") + 1)).alias("p")), "confidence")
    strong = patterns.filter(F.col("p") >= confidence).join(known.select("anchor", "class", "kind"), ["anchor", "class"])
    added = inst.filter("kind IS NULL").drop("kind").join(strong, ["anchor", "class"])
    return added.groupBy("row").agg(F.collect_set(F.struct("start", "end", "kind")).alias("added"))


def _all_spans(docs: DataFrame) -> DataFrame:
    base = _base(docs)
    rows = base.drop("inst").join(discovered(docs, base), "row", "left")
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])
    return rows.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("added", none())), order))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, of every row."""
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return _all_spans(docs).select("doc_id", *[of(k) for k in range(len(KINDS))], F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, broadcast_spans: int = 50_000) -> DataFrame:
    """docs with every span of text replaced by its kind in angle brackets; n_chars follows where there is such a column. Added
    spans are broadcast where there are at most broadcast_spans of them."""
    text = whole_text()
    base = _base(docs)
    more = base.select("row", "doc_id", "text_key").join(discovered(docs, base), "row").select("doc_id", "text_key", "added").dropDuplicates(["doc_id", "text_key"])
    more = materialise(more, "added")
    few = (more.agg(F.sum(F.size("added") + 1)).first()[0] or 0) <= broadcast_spans
    more = more.select(F.col("doc_id").alias("add_id"), F.col("text_key").alias("add_key"), "added")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text.alias("whole"))
    rows = rows.join(F.broadcast(more) if few else more, F.col("doc.doc_id").eqNullSafe(F.col("add_id")) & (F.xxhash64("whole") == F.col("add_key")), "left")
    spans = F.array_sort(F.concat(base_spans(F.col("whole")), F.coalesce("added", none())))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    rows = rows.withColumn("spans", spans)

    def cut(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        piece = F.concat(F.substring(F.col("whole"), s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0))), F.get(names, x["kind"]))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], F.when(fresh, piece).otherwise(F.lit(""))).alias("out"))

    clean = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut, lambda s: F.concat(s["out"], F.substring(F.col("whole"), s["at"] + 1, F.length("whole"))))
    rows = rows.withColumn("clean", F.when(F.size("spans") == 0, F.col("doc.text")).otherwise(clean))
    new = {"text": F.col("clean"), "n_chars": F.when(F.size("spans") == 0, F.col("doc.n_chars")).otherwise(F.length("clean").cast("long")) if "n_chars" in docs.columns else None}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
