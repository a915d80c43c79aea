"""File readers with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from .shared import exists

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType()}


def _schema(text: str) -> T.StructType:
    """Fields given as ``name kind``, without need of a session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in text.split(", "))])


PREFLOP = _schema("prev_line string, hero_pos string, hero_holding string, correct_decision string, num_players int, num_bets int, available_moves string, pot_size double, hero_stack_bb double")
POSTFLOP = _schema("hero_pos string, hero_holding string, hero_stack_bb double, num_players int, pot_size double, street string, board string, prev_line string, available_moves string, correct_decision string")
PAIRS = _schema("instruction string, output string")
STREETS = ("flop", "turn", "river")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with a header whose columns may come in any order; columns of the schema that it lacks are null."""
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return raw.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Without the index columns that some writers add (``Unnamed: 0``, ``_c0``)."""
    return df.drop(*[c for c in df.columns if c.startswith("Unnamed") or c == "_c0"])


def read_preflop(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, PREFLOP)


def read_postflop(spark: SparkSession, path: str) -> DataFrame:
    """Postflop scenarios: an unknown street is the flop; rows with a malformed hand or position are dropped."""
    from ..functions import cards, lines

    df = read_csv(spark, path, POSTFLOP)
    street = F.lower(F.trim("street"))
    good = cards.is_valid_hole(F.trim("hero_holding")) & F.trim("hero_pos").isin(*lines.POSITIONS)
    return df.withColumn("street", F.when(street.isin(*STREETS), street).otherwise("flop")).where(good)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array, or JSON lines, of objects with ``instruction`` and ``output``; other keys are kept in ``meta``."""
    multi = path.endswith(".json")
    raw = spark.read.option("multiLine", multi).option("wholetext", False).json(path)
    return coerce_rows(raw)


def coerce_rows(raw: DataFrame) -> DataFrame:
    """row_id, instruction, output, meta: rows that have both texts; the id given, else the first 16 hex digits of the instruction's SHA-1."""
    from ..functions import prompts

    given = F.col("row_id").cast("string") if "row_id" in raw.columns else F.lit(None).cast("string")
    rest = [c for c in raw.columns if c not in ("row_id", "instruction", "output")]
    meta = F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    return raw.where("instruction is not null and output is not null").select(F.coalesce(F.nullif(given, F.lit("")), prompts.row_id(F.col("instruction"))).alias("row_id"), "instruction", "output", meta.alias("meta"))


#: Where a row stands: its file, the start of its split in the file, the task that reads it.
_CHUNK = ("_file", "_block", "_part")


def placed(df: DataFrame) -> DataFrame:
    """Rows of files with the place of each.  Tasks take splits by size and not in the order of files, so the number of a task says nothing about that order."""
    return df.withColumns({"_file": F.input_file_name(), "_block": F.input_file_block_start(), "_id": F.monotonically_increasing_id()}).withColumn("_part", F.shiftright("_id", 33))


def running(df: DataFrame, amount: Column, column: str, by_file: bool = False) -> DataFrame:
    """``column``: the sum of ``amount`` over all rows of ``placed`` before (``by_file``: in the same file), in the order of the rows in the files, these by name.

    Rows are added up within splits; the splits' sums, one row each, are added up before they are joined.
    """
    part = df.withColumn("_amount", amount)
    sums = part.groupBy(*_CHUNK).agg(F.sum("_amount").alias("_sum"))
    order = Window.partitionBy("_file").orderBy("_block", "_part") if by_file else Window.orderBy(*_CHUNK)
    before = F.coalesce(F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.coalesce(F.sum("_amount").over(Window.partitionBy(*_CHUNK).orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return part.join(F.broadcast(sums.select(*_CHUNK, before.alias("_before"))), list(_CHUNK)).withColumn(column, F.col("_before") + own).drop("_amount", "_before")


def read_array(spark: SparkSession, path: str, schema: T.StructType = PAIRS, column: str = "source_index") -> DataFrame:
    """The objects of a JSON array, with their numbers from 0, read by as many tasks as the file has splits; anything but an array is an error.

    The path may be a folder: its files by name, one after the other, are the array, and each of them holds whole objects.
    The file is read as pieces that end in a closing brace, which splits anywhere.  Running sums of quotes tell which pieces start inside a string, those of braces
    outside of strings which piece ends an object.
    """
    text = spark.read.option("lineSep", "}").text(path)
    firsts = (spark.read.option("lineSep", "}").text(f).first() for f in sorted(text.inputFiles()))
    start = next((row for row in firsts if row is not None), None)
    if start is None or not start["value"].lstrip("\ufeff \t\r\n").startswith("["):
        raise ValueError(f"{path} does not hold a JSON array")
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # without escapes
    pieces = running(placed(text).withColumn("_plain", plain), F.length("_plain") - F.length(F.replace("_plain", F.lit('"'), F.lit(""))), "_quotes", by_file=True)
    # What stands outside of strings, also if the piece starts or ends inside of one.
    inside = F.col("_quotes") % 2 == 1
    outside = F.regexp_replace(F.concat(F.when(inside, '"').otherwise(""), F.col("_plain")), '(?s)"[^"]*("|$)', "")
    ends_inside = (F.col("_quotes") + F.length("_plain") - F.length(F.replace("_plain", F.lit('"'), F.lit("")))) % 2 == 1
    opened = F.length(outside) - F.length(F.replace(outside, F.lit("{"), F.lit("")))
    pieces = pieces.select(*_CHUNK, "_id", "value", opened.alias("_open"), (~ends_inside).cast("int").alias("_close"))
    pieces = running(pieces, F.col("_open") - F.col("_close"), "_depth", by_file=True)
    # The first piece of an object is at depth 0 and opens one; the rest of the file after the last object opens none.
    starts = ((F.col("_depth") == 0) & (F.col("_open") > 0)).cast("int")
    pieces = running(pieces.withColumn("_starts", starts), F.col("_starts"), "_before_")
    element = (F.col("_before_") + F.col("_starts") - 1).alias("element")
    rows = pieces.where((F.col("_depth") > 0) | (F.col("_starts") == 1)).select(element, "_block", "_id", "value").groupBy("element").agg(F.array_sort(F.collect_list(F.struct("_block", "_id", "value"))).alias("p"))
    text = F.concat(F.array_join(F.transform("p", lambda x: x["value"]), "}"), F.lit("}"))
    parsed = F.from_json(F.regexp_replace(text, r"^[^{]*", ""), schema)
    return rows.select(F.col("element").alias(column), parsed.alias("r")).select(column, "r.*")


def with_index(df: DataFrame, column: str = "source_index") -> DataFrame:
    """Numbers from 0 in the order of the rows in the files, these by name, without one task for all: offsets of the files' splits are added up first."""
    part = placed(df)
    sizes = part.groupBy(*_CHUNK).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))  # one row a split
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*_CHUNK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*_CHUNK, (before - F.col("_first")).alias("_before"))
    return part.join(F.broadcast(offsets), list(_CHUNK)).withColumn(column, F.col("_before") + F.col("_id")).drop(*_CHUNK, "_id", "_before")


def zip_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row i of one beside row i of the other, as far as the shorter goes.

    Files of few bytes may hold very many rows, so neither side is broadcast.
    """
    return with_index(left).join(with_index(right).hint("merge"), "source_index")


SPLITS = ("train", "test")
#: Folders that are tried one after the other where none is named.
FOLDERS = ("data/raw/scenarios", "data/raw")


def resolve(spark: SparkSession, split: str, folders: tuple[str, ...] = FOLDERS) -> tuple[str, str]:
    """The CSV and the JSON file of a split, from the first folder that has both, on any file system that Spark reads."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}; one of {list(SPLITS)}")
    for folder in folders:
        names = tuple(f"{folder}/{split}.{kind}" for kind in ("csv", "json"))
        if all(exists(spark, n) for n in names):
            return names
    raise FileNotFoundError(f"no {split}.csv with {split}.json in any of {list(folders)}")


def split_files(spark: SparkSession, *folders: str) -> dict[str, tuple[str, str]]:
    """Splits of which both the CSV and the JSON file are in one of the folders."""
    found = {}
    for split in SPLITS:
        try:
            found[split] = resolve(spark, split, folders or FOLDERS)
        except FileNotFoundError:
            continue
    if not found:
        raise FileNotFoundError(f"no split with both files in {list(folders or FOLDERS)}")
    return found


def read_splits(spark: SparkSession, *folders: str, limit: int | None = None) -> DataFrame:
    """Scenarios of all splits with their prompts; ``limit``: only the first so many of each."""
    parts = []
    for split, (table, texts) in split_files(spark, *folders).items():
        rows = with_index(read_preflop(spark, table)).join(read_array(spark, texts), "source_index")
        parts.append((rows if limit is None else rows.where(F.col("source_index") < limit)).withColumn("split", F.lit(split)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
