"""Personal data: pattern spans, and terms that disclose them, with DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers found by fixed patterns. The values
found are the protected entities. Around each occurrence a window of text gives context terms; over the
whole corpus, the pointwise mutual information of term and entity, as a share of the entity's information
content, says how strongly the term reveals the entity. Terms at or over the disclosure threshold, seen with
the entity in enough different contexts, become spans of kind ``term`` wherever they stand in a text that
holds the entity. ``sanitise`` generalises
base spans to their kind; it generalises disclosing terms too, and removes those that all but name the entity.

Copies of a context count once. Term frequencies count all documents.

Defined cases: null text is empty and has no span; an empty table gives an empty result; rows that repeat
doc_id and text get the same spans; a null doc_id is a row like any other; other columns are ignored by
``find_personal_data`` and passed through by ``sanitise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import Scratch, table

KINDS = ("email", "ip", "card", "phone", "term")
#: Code points of context on each side; contexts a pair of term and entity needs; least share of information; share from which a term is removed.
CONTEXT, SUPPORT, DISCLOSURE, REMOVAL = 160, 3, 0.5, 0.9
#: Numbers that are summed at once when places in a text are counted.
RUN = 64
#: Base spans before and after one that can touch its context: four kinds, each without overlaps, of five code points or more.
NEIGHBOURS = 4 * (CONTEXT // 5 + 1)
# The patterns find the same matches as the plain ones, in linear time and constant stack: quantifiers are
# possessive where nothing could be given back, and look-behinds keep a scan from starting inside a run
# that has failed at its start (\G lets it start where the last match ended).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole runs of 14 to 19 digits with single separators; shorter and longer runs would be dropped anyway.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
TERM = r"(?<![\p{L}\p{N}])\p{L}{4,}(?![\p{L}\p{N}])"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often lambda functions in ``body`` use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums_before(xs: Column) -> Column:
    """For each place of an array of numbers, the sum of those before it, by way of sums of ``RUN`` of them."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    runs = lambda z: F.transform(F.sequence(F.lit(0), F.expr("0") + F.floor(F.size(z) / RUN).cast("int")), lambda k: total(F.slice(z, k * RUN + 1, F.lit(RUN))))
    ahead = lambda r: F.transform(r, lambda _, k: total(F.slice(r, F.lit(1), k)))
    place = lambda z, p: F.transform(z, lambda _, i: F.get(p, F.floor(i / RUN).cast("int")) + total(F.slice(z, i - i % RUN + 1, i % RUN)))
    return let(xs, lambda z: let(let(runs(z), ahead), lambda p: place(z, p)))


def located(text: Column, pattern: str) -> Column:
    """Matches of a pattern as array<struct<start, end, value>> in code points, the end exclusive.

    The pieces between the matches give their places.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.struct(values.alias("values"), F.transform(F.split(text, pattern, -1), lambda g: F.length(g)).alias("gaps"))

    def placed(z: Column) -> Column:
        moves = F.zip_with(F.slice(z["gaps"], F.lit(1), F.size(z["values"])), z["values"], lambda g, v: g + F.length(v))
        starts = F.zip_with(sums_before(moves), F.slice(z["gaps"], F.lit(1), F.size(z["values"])), lambda a, g: a + g)
        return F.zip_with(starts, z["values"], lambda at, v: F.struct(at.alias("start"), (at + F.length(v)).alias("end"), v.alias("value")))

    return F.when(F.regexp_like(text, F.lit(pattern)), let(found, placed))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    each = F.transform(F.split(F.reverse(digits(value)), ""), lambda d: F.expr("0") + d.cast("int"))
    double = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(double, F.lit(0), lambda a, d: a + d) % 10 == 0


def base_spans(text: Column) -> Column:
    """All base spans as array<struct<start, kind, end, value>>, sorted; kind is the place in ``KINDS``."""

    def kind(k: int, guard: Column, pattern: str, valid) -> Column:
        found = F.when(guard, F.filter(located(text, pattern), lambda s: valid(s["value"])))
        shaped = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
        return F.coalesce(shaped, F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)"))

    part = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.expr("0") + F.right(p, F.lit(3)).cast("int") <= 255)
    return F.array_sort(
        F.concat(
            kind(0, F.contains(text, F.lit("@")), EMAIL, lambda v: F.lit(True)),
            kind(1, text.rlike(r"[0-9]\.[0-9]"), IP, lambda v: F.forall(F.split(v, r"\."), part)),
            kind(2, text.rlike(r"[0-9](?:[ -]?[0-9]){13}"), CARD, luhn),
            kind(3, F.contains(text, F.lit("+")), PHONE, lambda v: F.length(digits(v)).between(10, 15)),
        )
    )


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_table(docs: DataFrame) -> DataFrame:
    """Per row its key, doc_id, base spans, and the context of each span."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    found = own.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text", base_spans(F.col("text")).alias("base"))
    low = lambda s: F.greatest(s["start"] - CONTEXT, F.lit(0))

    def touching(i: Column, s: Column) -> Column:
        nearby = F.slice(F.col("base"), F.greatest(i - NEIGHBOURS + 1, F.lit(1)), F.lit(2 * NEIGHBOURS + 1))
        return F.transform(F.filter(nearby, lambda x: (x["start"] < s["end"] + CONTEXT) & (x["end"] > s["start"] - CONTEXT)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    context = F.transform("base", lambda s, i: F.struct(low(s).alias("at"), F.substring(F.col("text"), low(s) + 1, s["end"] - low(s) + CONTEXT).alias("context"), (s["end"] + CONTEXT >= F.col("chars")).alias("last"), touching(i, s).alias("taken")))
    return found.withColumn("chars", F.length("text")).select("row", "doc_id", "base", F.when(F.size("base") > 0, context).alias("contexts"))


def entity_of(span: Column) -> Column:
    return F.xxhash64(span["kind"], F.when(span["kind"] >= 1, digits(span["value"])).otherwise(F.lower(span["value"])))


def context_terms(base: DataFrame) -> DataFrame:
    """(row, entity, context, term, start, end) of the words around each base span, outside all base spans."""
    each = base.filter("size(base) > 0").select("row", F.explode(F.arrays_zip("base", "contexts")).alias("z"))
    around = each.select("row", F.col("z.contexts.taken").alias("taken"), entity_of(F.col("z.base")).alias("entity"), F.xxhash64("z.contexts.context").alias("context"), "z.contexts.at", "z.contexts.last", F.length("z.contexts.context").alias("size"), F.explode(located(F.col("z.contexts.context"), TERM)).alias("t"))
    start, end = F.col("at") + F.col("t.start"), F.col("at") + F.col("t.end")
    whole = ((F.col("t.start") > 0) | (F.col("at") == 0)) & ((F.col("t.end") < F.col("size")) | F.col("last"))
    free = ~F.exists("taken", lambda s: (s["start"] < end) & (start < s["end"]))
    return around.filter(whole & free).select("row", "entity", "context", F.lower("t.value").alias("term"), start.alias("start"), end.alias("end"))


def term_frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, documents) over all documents for the given terms; words are counted by their hashes, within tasks first."""
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word"))
    counts = words.select(F.xxhash64("word").alias("h")).groupBy("h").agg(F.count("*").alias("documents"))
    return terms.withColumn("h", F.xxhash64("term")).join(counts, "h").select("term", "documents")


def disclosing_terms(scratch: Scratch, docs: DataFrame, near: DataFrame, support: int = SUPPORT, least: float = DISCLOSURE) -> DataFrame:
    """(entity, term, disclosure): PMI of term and entity over the entity's information content, capped at 1."""
    contexts = near.select("entity", "context").distinct().groupBy("entity").agg(F.count("*").alias("ce"))
    pairs = near.select("entity", "context", "term").distinct().groupBy("entity", "term").agg(F.count("*").alias("cet")).filter(F.col("cet") >= support)
    total = float(max(2, docs.count()))
    information = F.log2(total / F.least(F.col("ce").cast("double"), F.lit(total / 2)))
    # the documents that have a term near any entity bound its frequency from below, and so its disclosure from above
    at_least = near.select("row", "term").distinct().groupBy("term").agg(F.count("*").alias("low"))
    bound = F.log2(F.col("cet") * total / (F.greatest("low", "cet") * F.col("ce"))) / information
    pairs = scratch.save(pairs.join(contexts, "entity").join(at_least, "term").filter(bound >= least).drop("low"), "pairs")
    counts = term_frequencies(docs, pairs.select("term").distinct())
    # the pair's contexts bound the term's frequency from below, should a term occur inside longer words only
    ct = F.greatest(F.col("documents"), F.col("cet")).cast("double")
    pmi = F.log2(F.col("cet") * total / (ct * F.col("ce")))
    scored = pairs.join(counts, "term").select("entity", "term", F.least(pmi / information, F.lit(1.0)).alias("disclosure"))
    return scored.filter(F.col("disclosure") >= least)


def term_hits(docs: DataFrame, base: DataFrame, disclosing: DataFrame) -> DataFrame:
    """(row, start, end, disclosure) of every occurrence of a disclosing term, anywhere in a text that holds its entity."""
    each = base.filter("size(base) > 0").select("row", F.explode("base").alias("s"))
    held = each.select("row", entity_of(F.col("s")).alias("entity")).distinct()
    wanted = held.join(disclosing, "entity").groupBy("row", "term").agg(F.max("disclosure").alias("disclosure"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = own.select(F.xxhash64("doc_id", "text").alias("row"), "text").join(wanted.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"])
    words = texts.select("row", F.explode(located(F.col("text"), TERM)).alias("t")).select("row", F.lower("t.value").alias("term"), "t.start", "t.end")
    hits = words.join(wanted, ["row", "term"]).select("row", "start", "end", "disclosure")
    blocks = lambda start, end: F.explode(F.sequence(F.floor(start / RUN), F.floor((end - 1) / RUN))).alias("block")
    spans = base.join(wanted.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"]).select("row", F.explode("base").alias("s"))
    spans = spans.select("row", F.col("s.start").alias("low"), F.col("s.end").alias("high"), blocks(F.col("s.start"), F.col("s.end")))
    inside = hits.select("row", "start", "end", blocks(F.col("start"), F.col("end"))).join(spans, ["row", "block"]).filter((F.col("low") < F.col("end")) & (F.col("start") < F.col("high")))
    return hits.join(inside.select("row", "start").distinct(), ["row", "start"], "left_anti")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, its key, base spans, and ``terms``: array<struct<start, kind, end, disclosure>> added by the method."""
    scratch = Scratch(docs.sparkSession, "pii")
    base = scratch.save(base_table(docs), "base")
    near = scratch.save(context_terms(base), "near")
    disclosing = scratch.save(disclosing_terms(scratch, docs, near), "disclosing")
    hits = term_hits(docs, base, disclosing).groupBy("row", "start", "end").agg(F.max("disclosure").alias("disclosure"))
    spans = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end", "disclosure"))).alias("terms"))
    out = base.drop("contexts").join(spans, "row", "left")
    return out.withColumn("terms", F.coalesce("terms", F.expr("cast(array() as array<struct<start:int,kind:int,end:int,disclosure:double>>)")))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` generalised to ``[kind]`` and the most disclosing terms removed."""
    found = Scratch(docs.sparkSession, "pii").save(find_personal_data(docs).select("row", "base", "terms").dropDuplicates(["row"]), "found")
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind"]).alias("put")))
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["disclosure"] >= REMOVAL, "").otherwise("[term]").alias("put")))
    edits = found.select(F.col("row").alias("__row"), F.array_sort(F.concat(plain, terms)).alias("__edits")).filter("size(__edits) > 0")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    start = F.expr("named_struct('at', 0, 'parts', cast(array() as array<string>))")

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["put"]))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), more.alias("parts"))).otherwise(acc)

    done = F.aggregate("__edits", start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    out = docs.join(edits, F.xxhash64(docs["doc_id"].cast("long"), text) == F.col("__row"), "left")
    return out.select(*[F.when(F.col("__edits").isNull(), docs["text"]).otherwise(done).alias(c) if c == "text" else docs[c] for c in docs.columns])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.array_sort(F.concat(base, terms))).alias("spans"))
