"""Interchange formats: samples and sections written from the tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tempera.catalog.binning import BINS, RANKED
from tempera.catalog.registry import query, rounded, table
from tempera.operators.binning import assign_bins, equal_count_bins, equal_count_bounds
from tempera.operators.store import SampleStore
from tempera.plans.adapters import order_samples, vector_samples
from tempera.plans.staging import materialize, staged_path
from tempera.sources import config, text
from tempera.sources.record import read_records, write_records
from tempera.streaming.deposit import stream_deposits, writer_name

_SAMPLES = """SELECT vec_id AS id, len(embedding) AS dim,
      round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: i * embedding[i]::DOUBLE)), 9) AS checksum,
      round(-100.0::DOUBLE * embedding[1]::DOUBLE * embedding[1]::DOUBLE, 9) AS weight, TRUE AS calculated FROM embeddings"""


def interchange_samples(spark, sf_dir):
    return vector_samples(spark, sf_dir).select("data", F.col("id").cast("int").alias("id"), "weight", F.lit(True).alias("calculated"))


def _summary(samples):
    total = F.aggregate(F.transform("data", lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x)
    return samples.select(
        F.col("id").cast("long"), F.size("data").cast("long").alias("dim"), rounded(total, 9).alias("checksum"),
        rounded("weight", 9).alias("weight"), "calculated",
    )


@query("binary_record_roundtrip", _SAMPLES)
def binary_record_roundtrip(spark, sf_dir):
    path = staged_path(spark, "records")
    write_records(interchange_samples(spark, sf_dir), path)
    return _summary(read_records(spark, path))


@query("text_record_roundtrip", _SAMPLES)
def text_record_roundtrip(spark, sf_dir):
    """Binary to text and back to binary."""
    binary, lines, again = (staged_path(spark, n) for n in ("records", "lines", "records"))
    write_records(interchange_samples(spark, sf_dir), binary)
    text.binary_to_text(spark, binary, lines)
    text.text_to_binary(spark, lines, again)
    return _summary(read_records(spark, again))


@query("posterior_draw_text", _SAMPLES.replace("vec_id AS id", "row_number() OVER (ORDER BY vec_id) - 1 AS id"))
def posterior_draw_text(spark, sf_dir):
    """Draws as 'log posterior, log likelihood, x...' lines, imported as samples numbered by line."""
    path = staged_path(spark, "posterior")
    v = vector_samples(spark, sf_dir).orderBy("id")
    v.select(
        F.concat_ws(" ", F.col("weight").cast("string"), (F.col("weight") - 1.0).cast("string"),
                    F.transform("data", lambda x: x.cast("string"))).alias("value")
    ).write.text(path)
    return _summary(text.read_posterior_draws(spark, path))


@query(
    "run_dump_text",
    f"""WITH {RANKED} SELECT CAST(level AS BIGINT) AS level, CAST(bin AS BIGINT) AS bin, id, round(energy, 6) AS x, round(weight, 6) AS weight FROM binned""",
)
def run_dump_text(spark, sf_dir):
    """A run dumped as one record file per level, bin and task, turned to text by level and bin, and read back."""
    run, lines = staged_path(spark, "run"), staged_path(spark, "run-text")
    binned = equal_count_bins(order_samples(spark, sf_dir), BINS)
    write_records(
        binned.select(F.array(-F.col("weight")).alias("data"), F.col("id").cast("int").alias("id"), "weight", F.lit(True).alias("calculated"), "level", "bin"), run
    )
    text.run_to_text(spark, run, lines)
    back = text.from_lines(spark.read.text(lines), "level", "bin")
    return back.select(
        F.col("level").cast("long"), F.col("bin").cast("long"), F.col("id").cast("long"), rounded(F.col("data")[0]).alias("x"), rounded("weight").alias("weight")
    )


@query(
    "tagged_sections",
    """SELECT o_orderpriority AS section, row_number() OVER (PARTITION BY o_orderpriority ORDER BY y) - 1 AS pos, round(v, 2) AS value
    FROM (SELECT o_orderpriority, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)""",
)
def tagged_sections(spark, sf_dir):
    """Yearly volumes written as tagged vector sections, one file of text per priority, parsed back."""
    path = staged_path(spark, "sections")
    yearly = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(
        F.sum("o_totalprice").alias("v")
    )
    rows = yearly.groupBy("o_orderpriority").agg(F.sort_array(F.collect_list(F.struct("y", "v"))).alias("s"))
    body = F.concat(
        F.lit("% yearly volume\n//== "), F.col("o_orderpriority"), F.lit(" ==//   // volumes\n"),
        F.size("s").cast("string"), F.lit("   % count\n\n"),
        F.concat_ws("  ", F.transform("s", lambda t: t["v"].cast("string"))), F.lit("\n\n// end\n"),
    )
    rows.repartition(rows.count(), "o_orderpriority").select(body.alias("value")).write.text(path)
    sections = config.read_sections(spark, path)
    names = sections.select("section").distinct()
    count = sections.where("ordinal = 0").select("file", "section", F.col("value").alias("n"))
    out = sections.join(count, ["file", "section"]).join(names, "section")
    return out.where("ordinal > 0 AND ordinal <= n").select(
        "section", (F.col("ordinal") - 1).cast("long").alias("pos"), rounded("value", 2).alias("value")
    )


CODES = (1, 2, 3, 4, 5, 103, 203, 207)
NAMES = sorted({n for c in CODES for n in config.fixed_names(c)} | set(config.OPTIONAL_FIXED))
_NATIONS = f"""bal AS (SELECT n_nationkey AS k, coalesce(round(avg(s_acctbal), 2), 0) / 10000 AS b
      FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1),
    n AS (SELECT *, [{', '.join(map(str, CODES))}][k % {len(CODES)} + 1] AS code, k % 3 + 4 AS c, 1 + k % 3 AS s1, 1 + (k // 3) % 2 AS s2 FROM bal)"""


def _nation_files(spark, sf_dir):
    """A parameter file per nation, with the code, fixed values and regime flags that its key and suppliers give; written and parsed."""
    balance = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.round(F.avg("s_acctbal"), 2).alias("b"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k")).join(balance, "k", "left")
    n = n.withColumn("b", F.coalesce("b", F.lit(0.0)) / 10000).withColumn("code", F.element_at(F.array(*map(F.lit, CODES)), F.col("k") % len(CODES) + 1))
    values = [
        F.when((F.col("k") + i) % 7 != 0, F.concat(F.lit(f"//== {name} ==//\n"), (F.lit(float(i)) + F.col("b")).cast("string"), F.lit("  % fixed\n")))
        for i, name in enumerate(NAMES)
    ]
    m = F.when(F.col("code").between(100, 199), 9).otherwise(8)

    def flags(block: int):
        def row(p):
            used = (F.col("k") + p + block) % 3 == 0
            marks = [F.when(used & ((p + block) % 2 == j), F.lit("1")).otherwise("0") for j in (0, 1)]
            return F.concat_ws(" ", *marks, F.when(p == 2, "1").otherwise("0"))

        return F.concat(m.cast("string"), F.lit("\n"), F.concat_ws("\n", F.transform(F.sequence(F.lit(0), m - 1), row)), F.lit("\n"))

    number = lambda name, c: F.concat(F.lit(f"//== {name} ==//\n"), c.cast("string"), F.lit("\n"))
    text_of = F.concat_ws(
        "\n", number("nation", F.col("k")), number("code", F.col("code")), *values,
        number("Number of states for state_variable[1]", 1 + F.col("k") % 3),
        number("Number of states for state_variable[2]", 1 + F.floor(F.col("k") / 3) % 2),
        number(config.CONSTANT_COUNT, F.col("k") % 3 + 4),
        *[F.concat(F.lit(f"//== {name} ==//\n"), flags(b)) for b, name in enumerate(config.VARYING.values())],
    )
    path = staged_path(spark, "nation-files")
    n.repartition(n.count(), "k").select(text_of.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    sections = materialize(config.read_sections(spark, path), "nation-sections")
    head = sections.where("ordinal = 0").groupBy("file").agg(
        *[F.max(F.when(F.col("section") == c, F.col("value"))).cast("int").alias(c) for c in ("nation", "code")]
    )
    return sections, head


@query(
    "fixed_parameters",
    f"""WITH {_NATIONS}, asked(code, name, otherwise) AS (VALUES {', '.join(
        f"({c}, '{x}', {config.OPTIONAL_FIXED.get(x, 'NULL')}::DOUBLE)" for c in CODES for x in [*config.fixed_names(c), *config.OPTIONAL_FIXED])}),
    place(name, i) AS (VALUES {', '.join(f"('{x}', {i})" for i, x in enumerate(NAMES))})
    SELECT k AS nation, n.code, name, round(coalesce(CASE WHEN (k + i) % 7 <> 0 THEN i + b END, otherwise), 9) AS value,
           otherwise IS NULL AND (k + i) % 7 = 0 AS missing
    FROM n JOIN asked USING (code) JOIN place USING (name)""",
)
def fixed_parameters(spark, sf_dir):
    """Fixed parameters that each nation's file holds, takes by default, or lacks under its restriction code."""
    sections, head = _nation_files(spark, sf_dir)
    found = config.fixed_parameters(sections, head.select("file", "code")).join(head.select("file", "nation"), "file")
    return found.select("nation", "code", "name", rounded("value", 9).alias("value"), "missing")


@query(
    "regime_vectors",
    f"""WITH {_NATIONS}, m AS (SELECT *, CASE WHEN code BETWEEN 100 AND 199 THEN 9 ELSE 8 END AS m FROM n),
    p AS (SELECT m.*, block, p, (k + p + block) % 3 = 0 AND (p + block) % 2 = 0 AS f1, (k + p + block) % 3 = 0 AND (p + block) % 2 = 1 AS f2
          FROM m, range(2) t(block), range(9) u(p) WHERE p < m),
    o AS (SELECT *, CASE WHEN f1 THEN s1 WHEN f2 THEN s2 ELSE 1 END AS r FROM p),
    q AS (SELECT *, c + row_number() OVER w - 1 AS place, c + coalesce(sum(r) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
          FROM o WINDOW w AS (PARTITION BY k ORDER BY block, p)),
    g AS (SELECT k, regime, place, CAST(start + CASE WHEN f1 THEN regime // s2 WHEN f2 THEN regime % s2 ELSE 0 END AS BIGINT) AS pos
          FROM q, range(6) t(regime) WHERE regime < s1 * s2
          UNION ALL SELECT k, regime, i, i FROM n, range(6) t(regime), range(9) u(i) WHERE regime < s1 * s2 AND i < c)
    SELECT vec_id AS id, regime, place, round(embedding[pos + 1]::DOUBLE, 9) AS value FROM embeddings JOIN g ON g.k = vec_id % 25""",
)
def regime_vectors(spark, sf_dir):
    """The parameter vector of every embedding in each regime of its nation's file."""
    sections, head = _nation_files(spark, sf_dir)
    v = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), (F.col("vec_id") % 25).cast("int").alias("nation"), F.col("embedding").cast("array<double>").alias("data")
    )
    draws = v.join(head.select("file", "nation"), "nation")
    rows = config.regime_vectors(draws, config.regime_positions(sections))
    return rows.select("id", F.col("regime").cast("long"), F.posexplode("data").alias("place", "value")).select(
        "id", "regime", F.col("place").cast("long"), rounded("value", 9).alias("value")
    )


_STREAMED_SQL = f"""WITH {RANKED}, looked AS (SELECT s.level,
        greatest(0, (SELECT count(*) FROM bounds b WHERE b.level = s.level AND b.lo <= s.energy) - 1) AS bin, s.weight FROM s)
    SELECT CAST(level AS BIGINT) AS level, CAST(bin AS BIGINT) AS bin, count(*) AS n, round(max(weight), 6) AS best
    FROM looked GROUP BY level, bin"""


def _streamed(spark, sf_dir, broken_off: bool):
    samples = order_samples(spark, sf_dir)
    bounds = equal_count_bounds(samples, BINS)
    schema = table(spark, sf_dir, "orders").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    arriving = stream.select(
        F.col("o_orderkey").alias("id"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("level"),
        F.array(F.col("o_totalprice")).alias("data"),
        (-F.col("o_totalprice") / 10000.0).alias("weight"),
    )
    store = SampleStore.in_shared_folder(spark, f"stream-{uuid.uuid4().hex}")
    checkpoint = staged_path(spark, "stream-checkpoint")
    if broken_off:
        # An attempt that wrote its rows and died before it was committed, and one that died with half of them.
        placed = assign_bins(samples.select("level", "id", F.array(-F.col("weight")).alias("data"), "weight"), bounds)
        store.write_attempt(placed, writer_name(checkpoint), 0)
        store.write_attempt(placed.where("id % 2 = 0"), writer_name(checkpoint), 0)
    stream_deposits(arriving, bounds, store, checkpoint).awaitTermination()
    return store.scan().groupBy(F.col("level").cast("long"), F.col("bin").cast("long")).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.max("weight")).alias("best")
    )


@query("streamed_deposits", _STREAMED_SQL)
def streamed_deposits(spark, sf_dir):
    """Orders streamed into the store, each batch binned by the energy bounds of its level."""
    return _streamed(spark, sf_dir, broken_off=False)


@query("deposits_after_a_crash", _STREAMED_SQL)
def deposits_after_a_crash(spark, sf_dir):
    """The same orders, streamed after two attempts at their epoch have broken off before the commit."""
    return _streamed(spark, sf_dir, broken_off=True)
