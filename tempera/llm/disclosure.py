"""Personal data and what gives it away: information-theoretic sanitisation in DataFrame expressions.

Emails, addresses, card and phone numbers are found by patterns. Each found value is a protected
entity. All words of the documents that mention it are candidate terms; from counts over the whole
corpus, a term's disclosure of an entity is its pointwise mutual information with the entity as
a share of the entity's own information. Terms beyond the lower threshold are
generalised, beyond the upper one removed, wherever they stand in a document with the entity.

Positions come from the pieces between matches: ``split`` and ``regexp_extract_all`` walk the
same matches, so lengths of pieces and matches add up to code-point offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempera.catalog.registry import table
from tempera.llm.catalog import llm_query
from tempera.llm.support import text_or_empty
from tempera.plans.staging import materialize

#: A pattern may only start where a run of its characters starts, or where the last match ended; runs are taken
#: possessively. That gives the plain pattern's matches in time linear in the text.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
LETTERS = r"[^\p{L}]"
#: A pair seen in fewer different texts is smoothed: the term counts as if it also stood in the missing ones, without the entity.
SUPPORT = 3
#: Words whose places are counted up together; changes no result.
BLOCK = 100
GENERALISE, REMOVE = 0.8, 0.95

SPAN = "array<struct<start:int,end:int,value:string>>"


def _nothing(kind: str) -> Column:
    return F.array().cast(kind)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def place(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), place) % 10 == 0


def _sound(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: x.cast("double") <= 255)
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _spans(kind: str, text: Column) -> Column:
    """All matches of a kind as (start, end, value); failing ones are dropped and not tried again."""
    pattern = PATTERNS[kind]
    steps = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"),
    )
    start = F.struct(F.lit(0).alias("at"), _nothing(SPAN).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        end = at + F.length(x["value"])
        span = F.struct(at.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(span)).alias("found"))

    matched = F.filter(steps, lambda x: x["value"].isNotNull())
    found = F.aggregate(matched, start, step, lambda acc: acc["found"])
    return F.filter(found, lambda s: _sound(kind, s["value"]))


def _worth(kind: str, text: Column) -> Column:
    """A cheap condition without which a kind can't occur."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return F.col("_digit")


def _entity(kind: str, value: Column) -> Column:
    plain = F.lower(value) if kind in ("email", "ip") else _digits(value)
    return F.concat(F.lit(f"{kind}:"), plain)


def _entities(kind: str) -> Column:
    return F.transform(kind, lambda s: _entity(kind, s["value"]))


def _replaced(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"], s["end"], F.lit(f"[{kind.upper()}]")))


def _terms(text: Column) -> Column:
    """Distinct letter words of a text in small letters."""
    words = F.array_distinct(F.split(text, LETTERS + "+"))
    return F.filter(F.array_distinct(F.transform(words, lambda w: F.lower(w))), lambda w: w != "")


def _word_places(texts: DataFrame) -> DataFrame:
    """(text_id, term, start, end) of every letter word of (text_id, text), in time linear in the text."""
    n = F.size("_pieces")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice("_pieces", b * BLOCK + 1, F.lit(BLOCK)))
    lengths = F.transform("_blocks", lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + F.length(x) + 1))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))

    def next_block(acc: Column, n: Column) -> Column:
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["found"], F.array(acc["at"])).alias("found"))

    def next_word(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x)
        word = F.struct(F.lower(x).alias("term"), acc["at"].alias("start"), end.alias("end"))
        found = F.when(end > acc["at"], F.concat(acc["found"], F.array(word))).otherwise(acc["found"])
        return F.struct((end + 1).alias("at"), found.alias("found"))

    first = F.struct(F.col("b._at").alias("at"), F.array().cast("array<struct<term:string,start:int,end:int>>").alias("found"))
    return (
        texts.select("text_id", F.split("text", LETTERS, -1).alias("_pieces"))
        .select("text_id", blocks.alias("_blocks"))
        .select("text_id", "_blocks", lengths.alias("_lengths"))
        .select("text_id", "_blocks", F.aggregate("_lengths", begin, next_block, lambda acc: acc["found"]).alias("_at"))
        .select("text_id", F.explode(F.arrays_zip("_blocks", "_at")).alias("b"))
        .select("text_id", F.explode(F.aggregate(F.col("b._blocks"), first, next_word, lambda acc: acc["found"])).alias("w"))
        .select("text_id", "w.term", "w.start", "w.end")
    )


def found_values(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, a span array per kind and ``held``: the text if it has a value, else null."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    out = out.withColumns({"text_key": F.xxhash64("text"), "_digit": F.rlike("text", F.lit("[0-9]"))})
    text = F.col("text")
    out = out.withColumns({k: F.when(_worth(k, text), _spans(k, text)).otherwise(_nothing(SPAN)) for k in KINDS})
    some = F.concat(*[F.col(k) for k in KINDS])
    return out.select("doc_id", "text_key", *KINDS, F.when(F.size(some) > 0, text).alias("held"))


def _text_id() -> Column:
    return F.md5(F.col("held").cast("binary"))


def texts_with_values(found: DataFrame) -> DataFrame:
    """text_id, copies, text and the distinct entities of each different text that has a value."""
    mentions = F.array_distinct(F.flatten(F.array(*[_entities(k) for k in KINDS])))
    return (
        found.filter("held is not null")
        .select(_text_id().alias("text_id"), F.col("held").alias("text"), mentions.alias("entities"))
        .groupBy("text_id")
        .agg(F.count("*").alias("copies"), F.first("text").alias("text"), F.first("entities").alias("entities"))
    )


def _pairs(texts: DataFrame) -> DataFrame:
    """(text_id, copies, entity, term), each once a text."""
    words = texts.select("text_id", "copies", "entities", F.explode(_terms(F.col("text"))).alias("term"))
    return words.select("text_id", "copies", "term", F.explode("entities").alias("entity"))


def revealing_terms(
    docs: DataFrame, found: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, texts: DataFrame | None = None
) -> DataFrame:
    """(entity, term, disclosure) of the pairs at or beyond ``generalise``, from counts over all documents.

    A pair counts once a document; a term counts in every document that has it as a word. Copies of a
    text count as documents but not as further evidence: the texts that a pair lacks to ``support`` are added to the term's
    count with as many copies as its texts have on average.
    """
    texts = texts_with_values(found) if texts is None else texts
    together = _pairs(texts).groupBy("entity", "term").agg(F.sum("copies").alias("n_both"), F.count("*").alias("texts"))
    entities = texts.select("copies", F.explode("entities").alias("e")).groupBy("e").agg(F.sum("copies").alias("n_entity"))
    terms = docs.select(F.explode(_terms(text_or_empty())).alias("w")).groupBy("w").agg(F.count("*").alias("n_term"))
    total = found.agg(F.count("*").alias("n"))
    counted = (
        together.join(entities, F.col("entity") == F.col("e"))
        .join(terms, F.col("term") == F.col("w"))
        .join(F.broadcast(total))  # one row
    )
    lacking = F.greatest(F.lit(support) - F.col("texts"), F.lit(0)) * F.col("n_both") / F.col("texts")
    own = F.log(F.col("n") / F.col("n_entity"))
    shared = F.log(F.col("n") * F.col("n_both") / (F.col("n_entity") * (F.col("n_term") + lacking)))
    disclosure = F.when(own > 0, shared / own).otherwise(F.lit(0.0))
    return counted.select("entity", "term", disclosure.alias("disclosure")).filter(F.col("disclosure") >= generalise)


def personal_data(docs: DataFrame, remove: float = REMOVE) -> DataFrame:
    """doc_id, text_key, span arrays per kind and ``terms`` (start, end, term, removed) of every document.

    Null texts are empty; rows that repeat are reported as often as they occur; a null doc_id stays null; an
    empty table gives no rows; other columns are ignored.
    """
    found = materialize(found_values(docs), "found")
    texts = materialize(texts_with_values(found), "texts-with-values")
    revealing = materialize(revealing_terms(docs, found, texts=texts), "revealing")
    hits = (
        _pairs(texts)
        .join(revealing, ["entity", "term"])
        .groupBy("text_id", "term")
        .agg(F.max("disclosure").alias("disclosure"))
    )
    marked = (
        _word_places(texts)
        .join(hits, ["text_id", "term"])
        .groupBy(F.col("text_id").alias("m_text_id"))
        .agg(
            F.array_sort(
                F.collect_list(F.struct("start", "end", "term", (F.col("disclosure") >= remove).alias("removed")))
            ).alias("m_terms")
        )
    )
    everything = F.concat(*[F.col(k) for k in KINDS])
    # Words inside a found value go with it.
    free = F.filter("m_terms", lambda w: ~F.exists("_all", lambda o: (o["start"] < w["end"]) & (o["end"] > w["start"])))
    none = F.array().cast("array<struct<start:int,end:int,term:string,removed:boolean>>")
    columns = ["doc_id", "text_key", *KINDS]
    some = found.filter("held is not null").select(*columns, everything.alias("_all"), _text_id().alias("_text_id"))
    some = some.join(marked, F.col("_text_id") == F.col("m_text_id"), "left")
    return (
        found.filter("held is null").select(*columns, none.alias("terms"))
        .unionByName(some.select(*columns, F.coalesce(free, none).alias("terms")))
    )


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def sanitised_text(text: Column) -> Column:
    """The text with found values replaced by their kind, revealing terms generalised or removed."""
    kinds = [_replaced(k) for k in KINDS]
    terms = F.transform(
        "terms",
        lambda s: F.struct(
            s["start"], s["end"], F.when(s["removed"], F.lit("[REMOVED]")).otherwise(F.concat(F.left(s["term"], F.lit(1)), F.lit("*")))
        ),
    )
    kind = "array<struct<start:int,end:int,put:string>>"
    ordered = F.array_sort(F.concat(*[x.cast(kind) for x in kinds], terms.cast(kind)))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        # A span that starts inside the one before lengthens it.
        last = F.element_at(acc["kept"], -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["put"].alias("put"))
        joined = F.concat(F.slice(acc["kept"], 1, F.size(acc["kept"]) - 1), F.array(longer))
        kept = F.when(s["start"] < acc["at"], joined).otherwise(F.concat(acc["kept"], F.array(s)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), kept.alias("kept"))

    kept = F.aggregate(ordered, begin, step, lambda acc: acc["kept"])
    starts = F.concat(F.array(F.lit(0)), F.transform(kept, lambda s: s["end"]))
    stops = F.concat(F.transform(kept, lambda s: s["start"]), F.array(F.length(text)))
    puts = F.concat(F.transform(kept, lambda s: s["put"]), F.array(F.lit("")))
    pieces = F.transform(
        F.arrays_zip(starts.alias("a"), stops.alias("b"), puts.alias("put")),
        lambda x: F.concat(F.substring(text, x["a"] + 1, x["b"] - x["a"]), x["put"]),
    )
    return F.when(F.size(ordered) > 0, F.array_join(pieces, "")).otherwise(text)


@llm_query("op6_disclosure")
def op6_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.flatten(F.array(*[_listed(k, F.col(k)) for k in KINDS]))
    every = F.concat(base, _listed("term", F.col("terms")))
    return personal_data(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(every, ",").alias("spans"),
    )
