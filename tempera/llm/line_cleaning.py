"""Line-first quality rules: lines that fail a rule go, then documents that lost too much text go.

Every line is judged by itself: does it end like a sentence or is it at least long, is it made of odd
marks, is it a row of menu entries, is it a stock phrase of web pages, did it stand in the text before. What
is left is the cleaned text; a document is kept if enough of it is left. DataFrame expressions only, one scan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempera.catalog.registry import table
from tempera.llm.catalog import llm_query
from tempera.llm.support import text_or_empty

#: Least words of a document, before and after cleaning.
LEAST_WORDS = 50
#: A document may repeat at most so many hundredths of its words, and lose at most so many of its word characters.
MOST_REPEATED, MOST_LOST = 50, 50
#: A line without an end mark passes from so many words on.
LONG_LINE = 12
#: Odd marks may be at most half as many as words.
MARKS = "#*$%&|<>!"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
SENTENCE_END = r"""[.!?:;…]["'”’»)\]]*$"""
#: Words that only part menu entries; two of them, one in every eight words, make a line navigation.
PARTING = ("|", "»", "›", ">", "·", "•", "→", "/")
#: Lines that are nothing but one of these are navigation, too.
MENU_LINES = (
    "home", "menu", "login", "log in", "sign in", "sign up", "register", "search", "contact", "contact us", "about", "about us",
    "sitemap", "back to top", "next", "previous", "read more", "share", "tweet", "print", "skip to content", "startseite", "anmelden",
    "accueil", "connexion", "inicio", "iniciar",
)
STOCK_PHRASES = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies", "accept cookies",
    "use of cookies", "enable javascript", "javascript is disabled", "lorem ipsum", "subscribe to our newsletter", "click here to",
    "powered by wordpress", "alle rechte vorbehalten", "datenschutzerkl", "verwendet cookies", "tous droits r", "utilise des cookies",
    "todos los derechos reservados", "utiliza cookies",
)
RULES = ("punctuation", "navigation", "boilerplate")


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _solid(text: Column) -> Column:
    """Code points in words."""
    return F.length(_without(text, BLANKS))


def _fails(rule: str) -> Callable[[Column], Column]:
    return lambda x: x["rule"] == rule


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def measured(line: Column, marked: Column) -> Column:
    """What the rules look at: the line, its trimmed and its lower-case form, its words, odd marks and parting words.

    Without ``marked`` the line has neither odd marks nor parting words.
    """
    marks = F.length(line) - F.length(_without(line, MARKS))

    def parts(words: Column) -> Column:
        bare = F.btrim(line, F.lit(BLANKS))
        return F.struct(
            line.alias("line"), bare.alias("bare"),
            F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("low"),
            F.size(words).alias("words"), F.when(marked, marks).otherwise(F.lit(0)).alias("marks"),
            F.when(marked, F.size(F.filter(words, lambda w: w.isin(*PARTING)))).otherwise(F.lit(0)).alias("parting"),
        )

    return _let(words_of(line), parts)


def failed_rule(m: Column) -> Column:
    """Name of the first rule that a measured line fails, or null."""
    stock = reduce(lambda a, b: a | b, [F.contains(m["low"], F.lit(p)) for p in STOCK_PHRASES])
    menu = ((m["parting"] >= 2) & (8 * m["parting"] >= m["words"])) | m["low"].isin(*MENU_LINES)
    broken = (2 * m["marks"] > m["words"]) | ((m["words"] < LONG_LINE) & ~m["bare"].rlike(SENTENCE_END))
    return F.when(menu, F.lit(RULES[1])).when(stock, F.lit(RULES[2])).when(broken, F.lit(RULES[0]))


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that a text has twice or more.

    Where hashes of windows repeat, the windows behind them are sorted by their text, so equal ones are neighbours; places
    of repeated windows in text order cover 3 words each, less where the next one begins sooner.
    """

    def beside(a: Column, field: str) -> Callable[[Column, Column], Column]:
        """The place of an entry that is like the one before or behind it."""
        like = lambda x, k: F.coalesce(x[field] == F.get(a, k)[field], F.lit(False))
        return lambda x, k: F.when(like(x, k - 1) | like(x, k + 1), x["i"])

    def places(sorted_entries: Column, field: str) -> Column:
        return F.filter(F.transform(sorted_entries, beside(sorted_entries, field)), lambda i: i.isNotNull())

    def covered(p: Column) -> Column:
        each = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b)

    def count(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        text = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        alike = _let(by_hash, lambda s: places(s, "h"))
        by_text = F.sort_array(F.transform(alike, lambda i: F.struct(text(i).alias("w"), i.alias("i"))))
        found = _let(_let(by_text, lambda s: F.sort_array(places(s, "w"))), covered)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(found)

    hashed = F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))
    return _let(F.slice(hashed, 1, F.greatest(F.size(words) - 2, F.lit(0))), count)


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its counts, its text without failing lines, lines lost by rule, and the verdict.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_text, clean_words,
    lost_chars (word characters), lost_lines (map of rule to lines; "repeated" for lines that stood before), kept.
    A null text is an empty one: no words, base_failed, not kept. Null and repeated ids, and texts of any
    length, are judged row by row; other columns are ignored; an empty table gives no rows.
    """
    body = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("_c_text"))
    body = body.withColumn("_c_words", words_of(F.col("_c_text")))
    odd = _without(F.col("_c_text"), "".join(sorted({*MARKS, *PARTING})))
    body = body.withColumn("_c_marked", F.length("_c_text") > F.length(odd))
    body = body.withColumns({"n_words": F.size("_c_words").cast("long"), "n_repeat_words": repeated_words(F.col("_c_words"))})
    lines = F.filter(F.split("_c_text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    body = body.withColumn("_c_lines", lines).withColumn("_c_once", F.array_distinct("_c_lines"))
    body = body.withColumn("_c_measured", F.transform("_c_once", lambda x: measured(x, F.col("_c_marked"))))
    body = body.withColumn("_c_judged", F.transform("_c_measured", lambda m: F.struct(m["line"].alias("line"), m["words"].alias("words"), failed_rule(m).alias("rule"))))
    body = body.withColumn("_c_good", F.filter("_c_judged", lambda x: x["rule"].isNull()))
    body = body.withColumn("clean_text", F.array_join(F.transform("_c_good", lambda x: x["line"]), "\n"))
    dup = F.size("_c_lines") - F.size("_c_once")
    symbols = F.length("_c_text") - F.length(_without(F.col("_c_text"), SYMBOLS))
    pairs = [y for rule in RULES for y in (F.lit(rule), F.size(F.filter("_c_judged", _fails(rule))))]
    body = body.withColumns({
        "word_chars": _solid(F.col("_c_text")).cast("long"),
        "n_symbols": F.when(F.col("_c_marked"), symbols).otherwise(F.lit(0)).cast("long"),
        "n_dup_lines": dup.cast("long"),
        "lost_lines": F.create_map(*pairs, F.lit("repeated"), dup),
        "clean_words": F.aggregate("_c_good", F.lit(0).cast("long"), lambda n, x: n + x["words"]),
        "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
    })
    lost = F.when(F.size("_c_good") == F.size("_c_lines"), F.lit(0)).otherwise(F.col("word_chars") - _solid(F.col("clean_text")))
    body = body.withColumn("lost_chars", lost.cast("long"))
    enough = (100 * F.col("lost_chars") <= MOST_LOST * F.col("word_chars")) & (F.col("clean_words") >= LEAST_WORDS)
    return body.withColumn("kept", ~F.col("base_failed") & enough).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "clean_text", "clean_words", "lost_chars", "lost_lines", "kept",
    )


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    words = lambda c: f"list_filter(regexp_split_to_array({c}, '{GAP}'), lambda w: w <> '')"
    stock = " OR ".join(f"contains(low, {quote(p)})" for p in STOCK_PHRASES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, {words("t")} AS ws, list_filter(string_split(t, chr(10)), lambda x: trim(x, {blanks}) <> '') AS ls FROM d),
win AS (SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT k, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY k),
line AS (SELECT DISTINCT k, unnest(ls) AS x FROM w),
bare AS (SELECT k, x, trim(x, {blanks}) AS b, {words("x")} AS xw FROM line),
judged AS (
  SELECT k, x, len(xw) AS n, length(regexp_replace(x, '{GAP}', '', 'g')) AS solid, low IN ({", ".join(map(quote, MENU_LINES))})
      OR (parting >= 2 AND 8 * parting >= len(xw)) OR {stock} OR 2 * marks > len(xw)
      OR (len(xw) < {LONG_LINE} AND NOT regexp_matches(b, {quote(SENTENCE_END)})) AS bad
  FROM (SELECT *, translate(b, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
               length(x) - length(translate(x, '{MARKS}', '')) AS marks,
               len(list_filter(xw, lambda y: y IN ({", ".join(map(quote, PARTING))}))) AS parting FROM bare)),
left_over AS (SELECT k, sum(n) AS n, sum(solid) AS solid FROM judged WHERE NOT bad GROUP BY k),
base AS (
  SELECT k, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{GAP}', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (k)),
full_row AS (
  SELECT base.*, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
         coalesce(l.n, 0)::BIGINT AS clean_words, (word_chars - coalesce(l.solid, 0))::BIGINT AS lost_chars
  FROM base LEFT JOIN left_over l USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_words, lost_chars,
       NOT base_failed AND 100 * lost_chars <= {MOST_LOST} * word_chars AND clean_words >= {LEAST_WORDS} AS kept
FROM full_row
"""


@llm_query("op13_line_cleaning", _sql())
def op13_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(table(spark, sf_dir, "documents")).drop("clean_text", "lost_lines")
