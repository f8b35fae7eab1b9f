"""Tagged-section files: ``//== name ==//`` followed by numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed value: a section header at the start of a line.
HEADER = r"(?m)^//==[ \t]*"
NAME = r"^([^\n]+?)[ \t]*==//"


def parse_sections(texts: DataFrame) -> DataFrame:
    """(file, text) to (file, section, ordinal, value); the first section of a name wins.

    Comments run from // or % to the end of the line; numbers are read up to
    the first word that is not one.
    """
    parts = texts.select("file", F.posexplode(F.split("text", HEADER)).alias("place", "part"))
    named = parts.where("place > 0").select(
        "file",
        "place",
        F.regexp_extract("part", NAME, 1).alias("section"),
        F.regexp_replace("part", r"^[^\n]*\n?", "").alias("body"),
    )
    first = named.where("section <> ''").groupBy("file", "section").agg(F.min_by("body", "place").alias("body"))
    clean = F.regexp_replace("body", r"(?m)(//|%|\*\*).*$", " ")
    words = F.filter(F.split(clean, r"\s+"), lambda w: F.length(w) > 0)
    values = first.select("file", "section", F.transform(words, lambda w: w.try_cast("double")).alias("v"))
    stop = F.array_position(F.transform("v", lambda x: x.isNull()), True)
    upto = F.when(stop > 0, stop - 1).otherwise(F.size("v").cast("long")).cast("int")
    numbers = values.select("file", "section", F.slice("v", F.lit(1), upto).alias("v"))
    return numbers.select("file", "section", F.posexplode("v").alias("ordinal", "value"))


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True)
    return parse_sections(files.select(F.input_file_name().alias("file"), F.col("value").alias("text")))


def vector_section(sections: DataFrame, name: str) -> DataFrame:
    """Elements of a section whose first number counts the rest."""
    inside = sections.where(F.col("section") == name)
    count = inside.where("ordinal = 0").select("file", F.col("value").alias("_count"))
    return (
        inside.join(count, "file")
        .where((F.col("ordinal") > 0) & (F.col("ordinal") <= F.col("_count")))
        .select("file", (F.col("ordinal") - 1).alias("pos"), "value")
    )


def panel_section(sections: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """A 'rows columns' matrix section, row-major with the date first, as a wide panel."""
    inside = sections.where(F.col("section") == name)
    width = len(columns) + 1
    cells = inside.where(F.col("ordinal") >= 2).select(
        "file", F.floor((F.col("ordinal") - 2) / width).alias("row"), ((F.col("ordinal") - 2) % width).alias("col"), "value"
    )
    shape = inside.where("ordinal = 0").select("file", F.col("value").alias("_rows"))
    wide = cells.join(shape, "file").where(F.col("row") < F.col("_rows")).groupBy("file", "row").agg(
        *[
            F.max(F.when(F.col("col") == j, F.col("value"))).alias(c)
            for j, c in enumerate(["dt", *columns])
        ]
    )
    return wide.drop("row")


def regime_flags(sections: DataFrame) -> DataFrame:
    """Per file: independent regime variables, grand regimes, and whether anything switches at all."""
    states = sections.where(
        F.col("section").startswith("Number of states for state_variable[") & (F.col("ordinal") == 0)
    )
    return states.groupBy("file").agg(
        F.count(F.lit(1)).alias("variables"),
        F.product("value").cast("long").alias("grand_regimes"),
        (F.max("value") <= 1).alias("constant"),
    )


# ---- Fixed values: sections that fix a parameter, by restriction code; all codes need the first ones ---------------------
ALWAYS_FIXED = ("ky", "ik", "qlLeOY", "qlLhOY", "nbar")
FIXED_BY_CODE = {
    1: ("glambdastar", "geta"), 2: ("gbeta",), 3: ("galpha", "geta"), 5: ("galpha", "geta"), 4: ("galpha", "glambdastar", "geta"),
    103: ("galpha", "geta", "gtheta"), 105: ("galpha", "geta", "gtheta"), 203: ("galpha", "geta", "gtheta"),
    205: ("galpha", "geta", "gtheta"), 207: ("galpha", "geta", "gtheta", "glambdaq", "glambdastar"),
}
OPTIONAL_FIXED = {"Iql": 1.0, "Iqk": 1.0, "gthetaK": 1.0}
CONSTANT_COUNT = "Number of free parameters not time varying"
VARYING = {"coefficient": "Time varying coefficient parameters", "variance": "Time varying variance parameters"}
STATES = r"^Number of states for state_variable\[(\d+)\]$"


def fixed_names(code: int) -> list[str]:
    """Sections that a parameter file has to have under a restriction code: the gross rate unless it is free (the codes
    ending in 5), the debt ratio below 100, where it is not derived."""
    rate = () if code % 100 == 5 else ("R",)
    debt = ("by",) if code < 100 else ()
    return [*rate, *debt, *ALWAYS_FIXED, *FIXED_BY_CODE.get(code, ())]


def fixed_parameters(sections: DataFrame, codes: DataFrame) -> DataFrame:
    """(file, code, name, value, missing) of every fixed parameter that the code of a file asks for.

    ``codes`` is (file, code). Optional parameters have their default where the file is silent; required ones are then
    ``missing`` with a null value, so that a caller can name them.
    """
    spark = sections.sparkSession
    known = sorted({*FIXED_BY_CODE, 0})
    asked = [(c, n, None) for c in known for n in fixed_names(c)] + [(c, n, v) for c in known for n, v in OPTIONAL_FIXED.items()]
    wanted = codes.join(spark.createDataFrame(asked, "code int, name string, otherwise double"), "code")
    found = sections.where("ordinal = 0").select("file", F.col("section").alias("name"), "value")
    filled = wanted.join(found, ["file", "name"], "left").withColumn("value", F.coalesce("value", "otherwise"))
    return filled.select("file", "code", "name", "value", F.col("value").isNull().alias("missing"))


def regime_layout(sections: DataFrame) -> DataFrame:
    """(file, place, block, param, uses, regimes, offset): where the values of every parameter lie in the free vector.

    The vector holds the constant parameters, then the values of each coefficient, then those of each variance, one after the
    other. A parameter has as many values as the state variables that its row of flags names have states together; ``uses``
    lists these variables with their number of states. Flags beyond the last state variable name none.
    """
    states = sections.where(F.rlike("section", F.lit(STATES)) & (F.col("ordinal") == 0)).select(
        "file", F.regexp_extract("section", STATES, 1).cast("int").alias("variable"), F.col("value").cast("int").alias("states")
    )
    blocks = F.create_map(*[x for b, (k, v) in enumerate(VARYING.items()) for x in (F.lit(v), F.struct(F.lit(b).alias("b"), F.lit(k).alias("k")))])
    cells = sections.where(F.col("section").isin(*VARYING.values()))
    counts = cells.groupBy("file", "section").agg(
        F.max(F.when(F.col("ordinal") == 0, F.col("value"))).cast("int").alias("params"), (F.count(F.lit(1)) - 1).alias("cells")
    )
    flags = cells.where("ordinal > 0").join(counts, ["file", "section"]).where("params > 0")
    wide = F.floor(F.col("cells") / F.col("params"))
    at = F.col("ordinal") - 1
    flags = flags.select(
        "file", blocks[F.col("section")].alias("block"), F.floor(at / wide).cast("int").alias("param"), (at % wide + 1).cast("int").alias("variable"),
        (F.col("value") != 0).alias("used"), "params",
    ).where(F.col("param") < F.col("params"))
    met = flags.join(states, ["file", "variable"], "left").withColumn("used", F.col("used") & F.col("states").isNotNull())
    one = F.when(F.col("used"), F.struct("variable", "states"))
    rows = met.groupBy("file", "block", "param").agg(F.sort_array(F.collect_list(one)).alias("uses"))
    regimes = F.aggregate("uses", F.lit(1), lambda n, u: n * u["states"])
    constant = sections.where((F.col("section") == CONSTANT_COUNT) & (F.col("ordinal") == 0)).select("file", F.col("value").cast("int").alias("constant"))
    order = Window.partitionBy("file").orderBy("block.b", "param")  # one row a parameter of a file
    before = F.coalesce(F.sum("regimes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("regimes", regimes).join(constant, "file").select(
        "file", (F.row_number().over(order) - 1).alias("place"), F.col("block.k").alias("block"), "param", "uses", "regimes",
        (F.col("constant") + before).cast("int").alias("offset"), "constant",
    )


def regime_positions(sections: DataFrame) -> DataFrame:
    """(file, regime, take): for every grand regime the positions of its parameters in the free vector, constants first.

    Grand regimes number the combinations of all state variables, the first one changing slowest.
    """
    states = sections.where(F.rlike("section", F.lit(STATES)) & (F.col("ordinal") == 0)).select(
        "file", F.struct(F.regexp_extract("section", STATES, 1).cast("int").alias("variable"), F.col("value").cast("int").alias("states")).alias("s")
    )
    grand = states.groupBy("file").agg(F.sort_array(F.collect_list("s")).alias("all"))
    total = F.aggregate("all", F.lit(1), lambda n, s: n * s["states"])
    grand = grand.withColumn("regime", F.explode(F.sequence(F.lit(0), total - 1)))
    # The state of a variable: what is left of the number once the faster variables are taken out.
    faster = lambda v: F.aggregate(F.filter("all", lambda s: s["variable"] > v), F.lit(1), lambda n, s: n * s["states"])
    layout = regime_layout(sections).join(grand, "file")
    state = lambda u: F.floor(F.col("regime") / faster(u["variable"])) % u["states"]
    own = F.aggregate("uses", F.lit(0).cast("long"), lambda n, u: n * u["states"] + state(u))
    placed = layout.withColumn("position", (F.col("offset") + own).cast("int"))
    taken = placed.groupBy("file", "regime", "constant").agg(F.sort_array(F.collect_list(F.struct("place", "position"))).alias("p"))
    constants = F.when(F.col("constant") > 0, F.sequence(F.lit(0), F.col("constant") - 1)).otherwise(F.array().cast("array<int>"))
    return taken.select("file", "regime", F.concat(constants, F.transform("p", lambda x: x["position"])).alias("take"))


def regime_vectors(draws: DataFrame, positions: DataFrame) -> DataFrame:
    """One parameter vector per draw (file, id, data) and regime of its file."""
    return draws.join(positions, "file").select("file", "id", "regime", F.transform("take", lambda p: F.get("data", p)).alias("data"))
