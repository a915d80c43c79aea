"""The six tables and four views of the prompt database, as DataFrames over scenario rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import cards, labels, let, lines, prompts
from ..sources.shared import place

TABLES = ("prompt_templates", "label_taxonomy", "situations", "situation_positions", "situation_actions", "situation_available_moves")
#: Order of loading; dropping goes the other way.
LOAD_ORDER = TABLES


def parsed(raw: DataFrame) -> DataFrame:
    """Scenario rows with prompt slots, events, template shell and derived fields; a missing CSV value falls back to the prompt's slot.

    Fallbacks bind the prompt once and are looked up only where the value is missing: as columns of their own they would be worked out for every row, and
    a filter on them would repeat the prompt's expression so often that its code no longer compiles.
    """
    text = F.coalesce("instruction", F.lit(""))
    slot = lambda name: let(text, lambda t: prompts.slots(t)[name])
    df = raw.withColumns(prompts.slots(text)).withColumn("events", lines.events(F.col("prev_line")))
    if "shell" not in raw.columns:  # rows that were written with it keep it
        df = df.withColumn("shell", prompts.shell(text))
    filled = lambda c, name: F.coalesce(F.nullif(F.trim(c), F.lit("")), slot(name))
    raw_label = F.trim("correct_decision")
    return df.withColumns({
        "hero_pos": filled("hero_pos", "slot_hero_pos"),
        "hero_hole": filled("hero_holding", "slot_hero_hole"),
        "num_players": F.coalesce("num_players", slot("table_size")),
        "template_hash": prompts.shell_hash(F.col("shell")),
        "raw_label": raw_label,
        "canonical_label": labels.canonical(raw_label),
        "label_bet_bb": labels.bet_size(raw_label),
        "pot_bb": F.coalesce("pot_size", let(text, lambda t: prompts.slots(t)["pot_size_chips"] / let(prompts.slots(t)["big_blind_chips"], lambda b: F.when(b > 0, b).otherwise(1.0)))),
    })


def is_accepted(df: DataFrame) -> Column:
    """A position and a hand of four characters."""
    return F.coalesce((F.col("hero_pos") != "") & (F.length("hero_hole") == 4), F.lit(False))


def rejected(df: DataFrame) -> DataFrame:
    return df.where(~is_accepted(df))


def with_situation_id(df: DataFrame) -> DataFrame:
    """Dense ids from 1 in the order of split (train first) and source index.

    Rows are numbered within buckets of the index; offsets of buckets are added up over their counts, so no single task sorts all rows.
    """
    order = F.when(F.col("split") == "train", 0).otherwise(1)
    bucket = F.struct(order.alias("s"), F.floor(F.col("source_index") / 65536).alias("b"))
    df = df.withColumn("_bucket", bucket)
    sizes = df.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_bucket", before.alias("_before"))
    number = F.row_number().over(Window.partitionBy("_bucket").orderBy("source_index"))
    return df.withColumn("_row", number).join(offsets, "_bucket").withColumn("situation_id", (F.col("_before") + F.col("_row")).cast("long")).drop("_bucket", "_row", "_before", "_n")


def _order() -> Column:
    """What situations are numbered by: the split, train first, and the source index."""
    return F.struct(F.when(F.col("split") == "train", 0).otherwise(1).alias("s"), F.col("source_index").alias("i"))


def templates(df: DataFrame) -> DataFrame:
    """Distinct shells, numbered by first appearance in the order of situations.  There is one row for each way of writing prompts, so few."""
    seen = df.groupBy("template_hash", "shell").agg(F.min(_order()).alias("first"))
    return seen.select(F.row_number().over(Window.orderBy("first", "template_hash", "shell")).cast("long").alias("template_id"), "template_hash", "shell", prompts.n_slots(F.col("shell")).alias("n_slots"))


def taxonomy(df: DataFrame) -> DataFrame:
    key = F.lower(F.trim("raw_label"))
    return df.where("raw_label is not null").groupBy(key.alias("raw_label")).agg(F.count("*").alias("n_occurrences")).select("raw_label", F.coalesce(labels.canonical(F.col("raw_label")), F.lit("unknown")).alias("canonical_label"), labels.bet_size(F.col("raw_label")).alias("bet_size_bb"), "n_occurrences")


def situations(df: DataFrame) -> DataFrame:
    """One row an accepted scenario, with the hand's and the line's derived fields."""
    hole, ev = F.col("hero_hole"), F.col("events")
    flag = lambda c: c.cast("int")
    return df.select(
        "situation_id", "split", "source_index", "template_hash", "table_size", "hero_pos",
        labels.position_category(F.col("hero_pos")).alias("hero_position_category"),
        hole.alias("hero_hole"), cards.hand_class(hole).alias("hero_hand_class"),
        flag(cards.is_pair(hole)).alias("hero_is_pair"), flag(cards.is_suited(hole)).alias("hero_is_suited"), flag(cards.is_broadway(hole)).alias("hero_is_broadway"),
        "num_players", F.coalesce("num_bets", F.lit(0)).alias("num_bets"),
        "small_blind_chips", "big_blind_chips", "starting_stack_chips", "pot_size_chips", "pot_bb",
        lines.facing_bet(ev).alias("facing_bet_bb"), flag(lines.is_open(ev)).alias("is_open_pot"), lines.decision_type(ev).alias("decision_type"),
        "prev_line", "raw_label", "canonical_label", "label_bet_bb", F.col("instruction").alias("prompt_text"),
    )


#: A situation's columns in full.
FULL = (
    "situation_id split source_index prompt_text prompt_template_id table_size small_blind_chips big_blind_chips starting_stack_chips "
    "hero_pos hero_position_category hero_hole hero_hand_class hero_is_pair hero_is_suited hero_is_broadway "
    "prev_line num_players num_bets pot_size_chips pot_bb facing_bet_bb is_open_pot decision_type raw_label canonical_label label_bet_bb"
).split()


def full(tables: dict[str, DataFrame]) -> DataFrame:
    """Situations with the number of their template instead of its hash, all columns."""
    # A row for each way of writing prompts: few.
    first = tables["prompt_templates"].groupBy("template_hash").agg(F.min("template_id").alias("prompt_template_id"))
    return tables["situations"].join(F.broadcast(first), "template_hash").select(*FULL)


def _seats() -> Column:
    return F.array_distinct(F.coalesce(F.col("positions"), F.array().cast("array<string>")))


def _moves() -> Column:
    return F.array_distinct(F.transform(labels.moves(F.col("available_moves")), lambda m: F.lower(m)))


def positions(df: DataFrame) -> DataFrame:
    """Seats of each situation once; the order of the six known positions, others after them as they stand."""
    seen = df.select("situation_id", F.posexplode(_seats()).alias("i", "position"))
    return seen.select("situation_id", "position", F.coalesce(lines.position_index(F.col("position")), F.lit(100) + F.col("i")).alias("seat_order"))


def actions(df: DataFrame) -> DataFrame:
    one = df.select("situation_id", F.posexplode("events").alias("seq_index", "e"))
    return one.select("situation_id", "seq_index", F.col("e.position").alias("actor_pos"), F.col("e.action").alias("action_type"), F.col("e.amount_bb").alias("size_bb"))


def moves(df: DataFrame) -> DataFrame:
    """Each situation's moves, lower-cased, once."""
    return df.select("situation_id", F.explode(_moves()).alias("move"))


def build(raw: DataFrame, once: bool = False) -> dict[str, DataFrame]:
    """All six tables of scenario rows; ``once``: the numbered rows are written to the shared folder first, for callers that read several tables."""
    df = parsed(raw)
    df = df.where(is_accepted(df))
    if once:
        path = place(raw.sparkSession, "numbered")
        # The few shells take next to nothing in a column file, so texts are masked once.
        with_situation_id(df.select(*raw.columns)).withColumn("shell", prompts.shell(F.coalesce("instruction", F.lit("")))).write.parquet(path)
        df = parsed(raw.sparkSession.read.parquet(path))
    else:
        df = with_situation_id(df)
    return {"prompt_templates": templates(df), "label_taxonomy": taxonomy(df), "situations": situations(df), "situation_positions": positions(df), "situation_actions": actions(df), "situation_available_moves": moves(df)}


def table_counts(raw: DataFrame) -> DataFrame:
    """(name, n): the rows that each table of ``build`` has, in one pass over the scenarios without numbering or writing them."""
    df = parsed(raw)
    df = df.where(is_accepted(df))
    sizes = df.select("template_hash", "shell", F.lower(F.trim("raw_label")).alias("label"), F.size("events").alias("a"), F.size(_seats()).alias("p"), F.size(_moves()).alias("m"))
    # A row for each template and label: few.
    sums = sizes.groupBy("template_hash", "shell", "label").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "apm"])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    row = sums.agg(F.count_distinct("template_hash", "shell").alias("prompt_templates"), F.count_distinct("label").alias("label_taxonomy"), total("n").alias("situations"), total("p").alias("situation_positions"), total("a").alias("situation_actions"), total("m").alias("situation_available_moves"))
    return row.unpivot([], list(TABLES), "name", "n")


def summary_view(tables: dict[str, DataFrame]) -> DataFrame:
    """Situations with the numbers of their earlier actions and available moves; 0 where there are none."""
    n = lambda t, c: tables[t].groupBy("situation_id").agg(F.count("*").alias(c))
    s = tables["situations"].join(n("situation_actions", "n_prev_actions"), "situation_id", "left").join(n("situation_available_moves", "n_available_moves"), "situation_id", "left")
    columns = "situation_id split hero_pos hero_position_category hero_hand_class hero_is_pair hero_is_suited hero_is_broadway decision_type num_players num_bets pot_bb facing_bet_bb is_open_pot canonical_label label_bet_bb raw_label".split()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return s.select(*columns, zero("n_prev_actions"), zero("n_available_moves"))


def matrix_view(situations_: DataFrame, column: str) -> DataFrame:
    return situations_.where("canonical_label is not null").groupBy(column, "canonical_label").agg(F.count("*").alias("n"))


def register(spark, tables: dict[str, DataFrame]) -> None:
    """Temporary views of the tables and the four views, for ad-hoc SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    summary_view(tables).createOrReplaceTempView("v_situation_summary")
    for view, column in (("v_position_action_matrix", "hero_pos"), ("v_hand_class_action_matrix", "hero_hand_class"), ("v_decision_type_mix", "decision_type")):
        matrix_view(tables["situations"], column).createOrReplaceTempView(view)


def write(tables: dict[str, DataFrame], folder: str) -> None:
    """A full rebuild of the Parquet mirror; situations are partitioned by split."""
    for name in LOAD_ORDER:
        writer = tables[name].write.mode("overwrite")
        (writer.partitionBy("split") if name == "situations" else writer).parquet(f"{folder}/{name}")


def load(spark, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, n): rows against the keys and references that the tables promise; all 0 in a sound build."""
    def doubled(name: str, *key: str) -> DataFrame:
        rows = tables[name].groupBy(*key).count().where("count > 1")
        return rows.agg(F.count("*").alias("n")).select(F.lit(f"{name}: {', '.join(key)} repeated").alias("rule"), "n")

    known = tables["situations"].select("situation_id").distinct().withColumn("known", F.lit(True))

    def both(name: str, key: str) -> DataFrame:
        # Dealt by situation once, for the groups and the join.
        rows = tables[name].repartition("situation_id").groupBy("situation_id", key).count().join(known, "situation_id", "left")
        n = rows.agg(F.count_if(F.col("count") > 1).alias(f"{name}: situation_id, {key} repeated"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("count"))), F.lit(0)).alias(f"{name}: no situation"))
        return n.unpivot([], [F.col(f"`{c}`") for c in n.columns], "rule", "n")

    parts = [doubled("situations", "split", "source_index"), doubled("prompt_templates", "template_hash"), doubled("label_taxonomy", "raw_label"), both("situation_positions", "position"), both("situation_actions", "seq_index"), both("situation_available_moves", "move")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def ddl(tables: dict[str, DataFrame]) -> str:
    """CREATE TABLE statements of the tables' schemas."""
    return "\n".join(f"CREATE TABLE {n} ({tables[n].schema.toDDL()});" for n in LOAD_ORDER)
