"""Queries that make texts and records: rendering, reasoning, chat records, sinks."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from .. import labeling
from ..functions import labels, lines, prompts, reasoning
from ..operators import features, promptdb, rewards
from ..sources import bridge, readers, sinks
from ..sources.shared import place as _place, tasks_for
from . import duck, scenario
from .registry import ORACLES, query


@query("fn_render_prev_line", duck.with_(duck.RAW, duck.EVENTS) + """, p as (select source_index, seq, position || '/' || case when action = 'raise' then rtrim(rtrim(printf('%.2f', amount), '0'), '.') || 'bb' else action end as s from ev)
select source_index, string_agg(s, '/' order by seq) as line from p group by 1""")
def fn_render_prev_line(spark, sf):
    """Lines rendered from their events; grouped by hand, so a line is as long as a hand."""
    ev = features.samples(bridge.scenarios(spark, sf)).select("source_index", F.posexplode("events").alias("seq", "e")).select("source_index", "seq", "e.position", "e.action", "e.amount_bb")
    text = ev.withColumn("s", reasoning.render_line("position", "action", "amount_bb"))
    return spark.sql("select source_index, listagg(s, '/') within group (order by seq) as line from {t} group by 1", t=text)


@query("fn_render_prompt", duck.RAW.join(["with ", ""]) + "select source_index, 2 + source_index % 5 as table_size, hero_pos as slot_hero_pos, hero_holding as slot_hero_hole, pot_size as pot_size_chips, coalesce(nullif(hero_stack_bb, 0), 100) as starting_stack_chips from raw")
def fn_render_prompt(spark, sf):
    """A prompt is rendered from a scenario and read again: the slots come back."""
    s = features.samples(bridge.scenarios(spark, sf))
    seats = F.array(*[F.lit(p) for p in lines.POSITIONS])
    line = F.array_join(F.transform("events", lines.event_token), "/")
    text = reasoning.render_prompt(F.col("hero_pos"), F.col("hero_hole"), seats, F.col("num_players"), F.col("stack"), F.col("pot"), F.lit(1.0), line, F.col("moves"))
    read = prompts.slots(F.col("text"))
    keep = ("slot_hero_pos", "slot_hero_hole", "pot_size_chips", "starting_stack_chips")
    return s.select("source_index", text.alias("text")).select("source_index", read["table_size"].cast("long").alias("table_size"), *[read[k].alias(k) for k in keep])


_CALLER = "case when regexp_matches(lower(instruction), '3[- ]?bet|reraise') then 'Villain has 3-bet, so the pot is inflated and ranges are tighter.' when regexp_matches(lower(instruction), '\\ball[- ]?in\\b|shove') then 'With an all-in on the table this is a pot-odds vs equity decision.' when regexp_matches(lower(instruction), '\\bcall\\b|\\blimp\\b') then 'Because there is already a caller, our value threshold rises.' else 'The pot is un-opened relative to hero, so we lean on our opening range.' end"


_VERDICT = "case lower(string_split_regex(gold, '\\s+')[1]) " + " ".join(f"when '{k}' then '{v.replace(chr(39), chr(39) * 2)}'" for k, v in {**reasoning.VERDICTS, "bet": reasoning.VERDICTS["raise"]}.items()) + f" else '{reasoning.OTHER}' end"


@query("fn_template_reasoning", duck.RAW.join(["with ", ""]) + f", g as (select *, trim(coalesce(correct_decision, '')) as gold from raw) select source_index, concat('Hero is in UTG. ', {_CALLER}, ' ', {_VERDICT}, chr(10), 'Decision: ', gold) as text from g")
def fn_template_reasoning(spark, sf):
    return bridge.scenarios(spark, sf).select("source_index", reasoning.concise(F.col("instruction"), F.coalesce("correct_decision", F.lit(""))).alias("text"))


#: What the texts say of the action before, in turns.
_BEFORE = ("", " after a 3-bet", " after an all-in", " after a limp", " after a jam")
_SECOND = [reasoning.STANDARD, reasoning.RANGES[0][1], reasoning.RANGES[1][1], reasoning.STANDARD, reasoning.RANGES[1][1]]


def _by_verb(i: int) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "case verb " + " ".join(f"when '{k}' then {quoted(v[i])}" for k, v in {**reasoning.STRENGTH, "bet": reasoning.STRENGTH["raise"], "": reasoning.STRENGTH["check"]}.items()) + " end"


# Rows by their number: every third names no position (but for the unit of a bet, which reads like one), every fourth no numbers.
_STRUCTURED = duck.RAW.join(["with ", ""]) + f""", v as (
  select *, lower(split_part(trim(coalesce(correct_decision, '')), ' ', 1)) as verb, source_index % 3 > 0 as named, source_index % 4 > 0 as numbered from raw
), a as (
  select *, list_filter([case when named then '**Hero snapshot**: Hero is in BTN, holding AhKd.' when numbered then '**Hero snapshot**: Hero is in BB.' end, [{', '.join("'" + x.replace("'", "''") + "'" for x in _SECOND)}][cast(source_index % 5 + 1 as int)],
    '**Hand strength**: ' || {_by_verb(0)}, '**GTO strategy**: ' || {_by_verb(1)}], lambda x: x is not null) as said from v
)
select source_index, concat('### Strategic Analysis', chr(10), array_to_string(list_transform(said, lambda x, i: concat(i, '. ', x)), chr(10)), chr(10), chr(10), '### Mathematical Calculations', chr(10),
  case when numbered then concat('* Pot size: ', cast(pot_size as varchar), ' BB', chr(10), '* Bet to call: 4 BB', chr(10), '* Required equity: ', printf('%.1f', 4 / (pot_size + 4) * 100), '%', chr(10), '* SPR: ', printf('%.2f', 100 / pot_size), chr(10), '* Effective stack: 100 BB')
    else '{reasoning.NO_NUMBERS}' end, chr(10), chr(10), '### Action', chr(10),
  case source_index % 13 when 0 then 'FOLD' when 1 then 'CALL' when 2 then '3.0BB' when 3 then 'RAISE 13.1 BB' when 4 then 'ALLIN' when 5 then 'CHECK' when 6 then 'BET 24 BB' when 7 then 'FOLD' when 8 then 'ALLIN' when 9 then 'WTF' when 10 then 'RAISE 7.5 BB' when 11 then 'CHECK' else 'GOING ALL-IN' end) as text from a"""


@query("fn_template_structured", _STRUCTURED)
def fn_template_structured(spark, sf):
    before = F.get(F.array(*[F.lit(x) for x in _BEFORE]), (F.col("source_index") % 5).cast("int"))
    who = F.when(F.col("source_index") % 3 > 0, "position: BTN, AhKd, ").otherwise("nobody, ")
    figures = F.when(F.col("source_index") % 4 > 0, F.concat(F.lit("stack 100 bb, pot "), F.col("pot_size").cast("string"), F.lit(" bb, he bets 4 BB"))).otherwise("no figures")
    return bridge.scenarios(spark, sf).select("source_index", reasoning.structured(F.concat(who, figures, before), F.coalesce("correct_decision", F.lit(""))).alias("text"))


@query("fn_row_id", "select doc_id, substr(sha1(text), 1, 16) as row_id from documents where text is not null")
def fn_row_id(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").select("doc_id", prompts.row_id(F.col("text")).alias("row_id"))


@query("prj_messages", duck.RAW.join(["with ", ""]) + "select source_index, 3 as n, concat_ws('|', 'system', 'user', 'assistant') as roles, length(trim(instruction)) as user_chars from raw")
def prj_messages(spark, sf):
    m = prompts.messages(F.lit("s"), F.col("instruction"), F.coalesce("correct_decision", F.lit("")))
    return bridge.scenarios(spark, sf).select("source_index", m.alias("m")).select("source_index", F.size("m").alias("n"), F.array_join(F.transform("m", lambda x: x["role"]), "|").alias("roles"), F.length(F.get("m", F.lit(1))["content"]).cast("long").alias("user_chars"))


@query("prj_augmented", duck.RAW.join(["with ", ""]) + "select source_index, case when source_index % 2 = 0 then 'mine' else 'template' end as labeler, concat('Because.', chr(10), 'Decision: fold') as content from raw")
def prj_augmented(spark, sf):
    meta = F.when(F.col("source_index") % 2 == 0, F.create_map(F.lit("labeler"), F.lit("mine")))
    rows = bridge.scenarios(spark, sf).select(F.col("source_index").cast("string").alias("row_id"), "instruction", F.lit("Because.\nDecision: call").alias("reasoning"), F.lit("fold").alias("action"), F.lit("template").alias("labeler"), meta.alias("meta"))
    out = sinks.augmented(rows, "s")
    return out.select(F.element_at("metadata", "row_id").cast("long").alias("source_index"), F.element_at("metadata", "labeler").alias("labeler"), F.get("messages", F.lit(2))["content"].alias("content"))


@query("snk_instruction_json", duck.RAW.join(["with ", ""]) + "select concat('### Instruction:', chr(10), trim(instruction), chr(10), chr(10), '### Response:', chr(10), trim(correct_decision)) as text from raw where correct_decision is not null")
def snk_instruction_json(spark, sf):
    return sinks.instruction_text(bridge.scenarios(spark, sf).where("correct_decision is not null").withColumn("output", F.col("correct_decision")))


@query("snk_parquet_mirror", ORACLES["agg_table_counts"])
def snk_parquet_mirror(spark, sf):
    """The six tables are written and read again, and counted."""
    place = _place(spark, "mirror")
    promptdb.write(promptdb.build(bridge.scenarios(spark, sf), once=True), place)
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in promptdb.load(spark, place).items()]
    return functools.reduce(DataFrame.union, parts)


@query("snk_build_db", "select 'situations: split, source_index repeated' as rule, cast(0 as bigint) as n union all select 'prompt_templates: template_hash repeated', 0 union all select 'label_taxonomy: raw_label repeated', 0 union all select 'situation_positions: situation_id, position repeated', 0 union all select 'situation_actions: situation_id, seq_index repeated', 0 union all select 'situation_available_moves: situation_id, move repeated', 0 union all select 'situation_positions: no situation', 0 union all select 'situation_actions: no situation', 0 union all select 'situation_available_moves: no situation', 0")
def snk_build_db(spark, sf):
    place = _place(spark, "db")
    promptdb.write(promptdb.build(bridge.scenarios(spark, sf), once=True), place)
    return promptdb.violations(promptdb.load(spark, place))


@query("snk_stats_render", duck.BASE + """select 'split' as kind, split as name, count(*) as n from sit group by 2 union all select 'decision_type', decision_type, count(*) from sit group by 2 union all select 'canonical_label', canonical_label, count(*) from sit group by 2""")
def snk_stats_render(spark, sf):
    t = promptdb.build(bridge.scenarios(spark, sf))
    return sinks.stats(t).where("kind in ('split', 'decision_type', 'canonical_label')")


@query("src_csv_preflop", duck.RAW.join(["with ", ""]) + "select hero_pos, hero_holding, prev_line, num_players, pot_size from raw")
def src_csv_preflop(spark, sf):
    place = _place(spark, "csv")
    raw = bridge.scenarios(spark, sf)
    raw.select("pot_size", "prev_line", "hero_pos", "hero_holding", "num_players").write.option("header", True).csv(place)
    return readers.read_preflop(spark, place).select("hero_pos", "hero_holding", "prev_line", "num_players", "pot_size")


@query("src_csv_postflop", duck.RAW.join(["with ", ""]) + "select hero_pos, hero_holding, case when street = 'unknown' then 'flop' else street end as street, board from raw where source_index % 7 <> 0")
def src_csv_postflop(spark, sf):
    """Some rows are spoilt before they are written; the reader leaves them out."""
    place = _place(spark, "postflop")
    raw = bridge.scenarios(spark, sf)
    raw.select("hero_pos", F.when(F.col("source_index") % 7 == 0, "notcards").otherwise(F.col("hero_holding")).alias("hero_holding"), "num_players", "pot_size", "street", "board", "prev_line").write.option("header", True).csv(place)
    return readers.read_postflop(spark, place).select("hero_pos", "hero_holding", "street", "board")


@query("src_json_pairs", duck.RAW.join(["with ", ""]) + "select substr(sha1(instruction), 1, 16) as row_id, instruction, coalesce(correct_decision, 'none') as output from raw")
def src_json_pairs(spark, sf):
    place = _place(spark, "pairs")
    bridge.scenarios(spark, sf).select("instruction", F.coalesce("correct_decision", F.lit("none")).alias("output")).write.json(place)
    return readers.read_pairs(spark, place).drop("meta")


@query("src_row_coerce", "select event_id, case when event_id % 4 = 0 then concat('id', event_id) else substr(sha1(concat('text ', event_id)), 1, 16) end as row_id, event_type as extra from events where event_id % 5 <> 0")
def src_row_coerce(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    raw = e.select(F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("id"), "event_id")).otherwise("").alias("row_id"), F.concat(F.lit("text "), "event_id").alias("instruction"), F.when(F.col("event_id") % 5 != 0, "o").alias("output"), "event_type", "event_id")
    return readers.coerce_rows(raw).select(F.element_at("meta", "event_id").cast("long").alias("event_id"), "row_id", F.element_at("meta", "event_type").alias("extra"))


@query("src_parquet", "select event_type, count(*) as n from events where value is not null group by 1")
def src_parquet(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").where("value is not null").groupBy("event_type").agg(F.count("*").alias("n"))


@query("set_union_splits", duck.RAW.join(["with ", ""]) + "select split, count(*) as n from raw group by 1")
def set_union_splits(spark, sf):
    raw = bridge.scenarios(spark, sf)
    return raw.where("split = 'train'").unionByName(raw.where("split = 'test'")).groupBy("split").agg(F.count("*").alias("n"))


@query("fil_unparseable", duck.RAW.join(["with ", ""]) + "select count(*) filter (where source_index % 9 = 0) as rejected, count(*) filter (where source_index % 9 <> 0) as accepted from raw")
def fil_unparseable(spark, sf):
    """Hands are spoilt in every ninth row, in the table and in the prompt."""
    bad = F.col("source_index") % 9 == 0
    raw = bridge.scenarios(spark, sf).withColumns({"hero_holding": F.when(bad, "A").otherwise(F.col("hero_holding")), "instruction": F.when(bad, "nothing").otherwise(F.col("instruction"))})
    ok = promptdb.is_accepted(promptdb.parsed(raw))
    return promptdb.parsed(raw).agg(F.count_if(~ok).alias("rejected"), F.count_if(ok).alias("accepted"))


@query("fn_event_token", duck.with_(duck.RAW, duck.EVENTS) + "select source_index, string_agg(position || '_' || action || coalesce('_' || rtrim(rtrim(printf('%.2f', amount), '0'), '.') || 'bb', ''), ' ' order by seq) as tokens from ev group by 1")
def fn_event_token(spark, sf):
    s = features.samples(bridge.scenarios(spark, sf)).where(F.size("events") > 0)
    return s.select("source_index", F.array_join(F.transform("events", lines.event_token), " ").alias("tokens"))


@query("fn_facing_bet", duck.with_(duck.RAW, duck.EVENTS, duck.COUNTS) + "select raw.source_index, coalesce(max_bet, 0) as facing_bet, coalesce(n_raise + n_allin, 0) = 0 as is_open from raw left join cnt using (split, source_index)")
def fn_facing_bet(spark, sf):
    s = features.samples(bridge.scenarios(spark, sf))
    return s.select("source_index", lines.facing_bet(F.col("events")).alias("facing_bet"), lines.is_open(F.col("events")).alias("is_open"))


@query("fn_can_moves", duck.RAW.join(["with ", ""]) + "select source_index, source_index % 5 = 1 as can_check, source_index % 5 in (0, 1, 4) as can_fold, source_index % 5 = 0 as can_call from raw")
def fn_can_moves(spark, sf):
    low = F.transform(labels.moves(F.col("available_moves"), "whole"), lambda m: F.lower(m))
    return bridge.scenarios(spark, sf).select("source_index", *[F.array_contains(low, m).alias(f"can_{m}") for m in ("check", "fold", "call")])


@query("fn_card_english", duck.RAW.join(["with ", ""]) + "select source_index, regexp_extract(instruction, '\\[(.*?)\\]', 1) as english from raw")
def fn_card_english(spark, sf):
    from ..functions import cards

    h = F.col("hero_holding")
    return bridge.scenarios(spark, sf).select("source_index", F.concat(cards.english(cards.first(h)), F.lit(" and "), cards.english(cards.second(h))).alias("english"))


@query("join_self_roster", "select cast(i as integer) as seat_id, case i % 4 when 0 then 'heuristic' when 1 then 'tag' when 2 then 'lag' else 'random' end as player from range(9) t(i)")
def join_self_roster(spark, sf):
    """A roster of players repeated over the seats."""
    roster = F.array(*[F.lit(x) for x in ("heuristic", "tag", "lag", "random")])
    return spark.range(9).select(F.col("id").cast("int").alias("seat_id"), F.get(roster, (F.col("id") % 4).cast("int")).alias("player"))


class _Flaky:
    """A client that fails as many times for a row as its id says."""

    def __init__(self):
        self.tried = {}

    def __call__(self, row: dict) -> str:
        self.tried[row["row_id"]] = n = self.tried.get(row["row_id"], 0) + 1
        if n <= int(row["row_id"]) % 5:
            raise ConnectionError("try again")
        return f"Because {row['prompt'].strip()[:9]}"


def _no_sleep(seconds: float) -> None:
    pass


def _flaky_rows(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("row_id"), F.coalesce("text", F.lit("")).alias("instruction"), F.lit("call").alias("output"), "doc_id")
    return labeling.asked(rows)


def _flaky(df):
    return labeling.labelled(df, labeling.Labeler(_Flaky, "flaky"), retries=3, sleep=_no_sleep)


@query("agg_augment_result", "select name, n from (select count(*) as n_input, count(*) filter (where doc_id < 50 and doc_id % 5 < 3) as n_skipped, count(*) filter (where doc_id >= 50 and doc_id % 5 < 3) as n_written, count(*) filter (where doc_id % 5 >= 3) as n_failed, count(*) filter (where doc_id % 5 >= 3) as failed_rows from documents) unpivot (n for name in (n_input, n_skipped, n_written, n_failed, failed_rows))")
def agg_augment_result(spark, sf):
    """What a resumed run says of itself, after one over the first fifty ids; failed rows stay in a table of their own."""
    rows, out = _flaky_rows(spark, sf), _place(spark, "label-run")
    labeling.run(rows.where("doc_id < 50"), _flaky, out)
    result = labeling.run(rows, _flaky, out)
    figures = spark.createDataFrame([(k, int(getattr(result, k))) for k in ("n_input", "n_skipped", "n_written", "n_failed")], "name string, n long")
    return figures.union(labeling.failures(spark, out).agg(F.lit("failed_rows"), F.count_distinct("row_id")))


@query("stm_retry_backoff", "select cast(doc_id as varchar) as row_id, cast(least(doc_id % 5 + 1, 3) as integer) as attempts, doc_id % 5 >= 3 as failed, case when doc_id % 5 < 3 then 'Because Situation' end as reasoning from documents")
def stm_retry_backoff(spark, sf):
    """Rows labelled by a client that fails: two retries, then the row is a failure."""
    return _flaky(_flaky_rows(spark, sf)).select("row_id", "attempts", F.col("error").isNotNull().alias("failed"), "reasoning")


@query("fn_system_prompt", "select conv_id, turn, turn % 2 = 0 as structured, true as asked from conversations where role = 'user'")
def fn_system_prompt(spark, sf):
    """The request for each user turn, by turns in either style."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("instruction"), F.lit("fold").alias("output"))
    parts = [labeling.asked(rows.where(F.col("turn") % 2 == i), style) for i, style in enumerate(("structured", "concise"))]
    both = parts[0].unionByName(parts[1])
    return both.select("conv_id", "turn", F.contains("system", F.lit("### Action")).alias("structured"), (F.contains("prompt", F.trim("instruction")) & F.contains("prompt", F.lit("fold"))).alias("asked"))


@query("agg_latency", "select event_type, count(*) as n, round(avg(value), 6) as mean_latency from events group by 1")
def agg_latency(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_latency"))


@query("sim_fold_win", "with s as (select l_orderkey as hand_id, cast(l_suppkey % 6 as int) as seat_id, sum(l_quantity) as paid from lineitem group by 1, 2), f as (select hand_id, max(seat_id) as last, sum(paid) as pot from s group by 1) select hand_id, seat_id, case when seat_id = last then pot else 0 end - paid as delta from s join f using (hand_id)")
def sim_fold_win(spark, sf):
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    seats = line.groupBy(F.col("l_orderkey").alias("hand_id"), (F.col("l_suppkey") % 6).cast("int").alias("seat_id")).agg(F.sum("l_quantity").alias("paid"))
    last = seats.groupBy("hand_id").agg(F.max("seat_id").alias("last"))
    return rewards.fold_win(seats.join(last, "hand_id").withColumn("folded", F.col("seat_id") != F.col("last")).drop("last"))


@query("prj_preflop_sample", duck.RAW.join(["with ", ""]) + "select split, source_index, hero_pos, hero_holding as hero_hole, coalesce(nullif(hero_stack_bb, 0), 100) as stack, num_players, num_bets, pot_size as pot from raw")
def prj_preflop_sample(spark, sf):
    return features.samples(bridge.scenarios(spark, sf)).select("split", "source_index", "hero_pos", "hero_hole", "stack", "num_players", "num_bets", "pot")


@query("set_active_minus_folded", duck.with_(duck.RAW, duck.EVENTS) + ", l as (select source_index, position, arg_max(action, seq) as a from ev where position <> hero_pos group by 1, 2) select raw.source_index, coalesce(n, 0) as n_active from raw left join (select source_index, count(*) as n from l where a <> 'fold' group by 1) using (source_index)")
def set_active_minus_folded(spark, sf):
    s = features.samples(bridge.scenarios(spark, sf))
    return s.select("source_index", lines.active_opponents(F.col("events"), F.col("hero_pos")).cast("long").alias("n_active"))


@query("fn_action_pattern_hash", duck.with_(duck.RAW, duck.EVENTS, scenario.PATTERN) + "select source_index, pattern_hash as action_pattern_hash from pat")
def fn_action_pattern_hash(spark, sf):
    s = features.samples(bridge.scenarios(spark, sf)).select("source_index", lines.pattern(F.col("events")).alias("pattern"))
    return s.join(F.broadcast(lines.pattern_dimension(spark)), "pattern").select("source_index", "action_pattern_hash")


@query("set_distinct_shells", "select 1 as n_shells from (select count(*) from orders)")
def set_distinct_shells(spark, sf):
    return bridge.scenarios(spark, sf).select(prompts.shell_hash(prompts.shell(F.col("instruction"))).alias("h")).agg(F.count_distinct("h").cast("int").alias("n_shells"))


@query("srt_multi_key", duck.BASE + "select hero_pos, decision_type, count(*) as n from sit group by 1, 2 order by 1, 3 desc, 2")
def srt_multi_key(spark, sf):
    s = features.samples(bridge.scenarios(spark, sf)).select("hero_pos", lines.decision_type(F.col("events")).alias("decision_type"))
    return s.groupBy("hero_pos", "decision_type").agg(F.count("*").alias("n")).orderBy("hero_pos", F.desc("n"), "decision_type")


@query("src_jsonl_rows", duck.RAW.join(["with ", ""]) + "select substr(sha1(instruction), 1, 16) as row_id, correct_decision as output, cast(source_index as varchar) as meta_index from raw where correct_decision is not null and instruction is not null")
def src_jsonl_rows(spark, sf):
    """JSON lines with a key besides the two texts: it comes back as metadata, and rows without output are left out."""
    place = _place(spark, "jsonl")
    bridge.scenarios(spark, sf).select("instruction", F.col("correct_decision").alias("output"), "source_index").write.json(place)
    return readers.read_pairs(spark, place).select("row_id", "output", F.element_at("meta", "source_index").alias("meta_index"))


@query("snk_augment_jsonl", ORACLES["prj_augmented"])
def snk_augment_jsonl(spark, sf):
    """Chat records written as JSON lines and read again."""
    place = _place(spark, "augmented")
    meta = F.when(F.col("source_index") % 2 == 0, F.create_map(F.lit("labeler"), F.lit("mine")))
    rows = bridge.scenarios(spark, sf).select(F.col("source_index").cast("string").alias("row_id"), "instruction", F.lit("Because.\nDecision: call").alias("reasoning"), F.lit("fold").alias("action"), F.lit("template").alias("labeler"), meta.alias("meta"))
    sinks.augmented(rows, "s").write.json(place)
    back = spark.read.schema("messages array<struct<role:string,content:string>>, metadata map<string,string>").json(place)
    return back.select(F.element_at("metadata", "row_id").cast("long").alias("source_index"), F.element_at("metadata", "labeler").alias("labeler"), F.get("messages", F.lit(2))["content"].alias("content"))


@query("snk_query_render", duck.BASE + ", n as (select coalesce(canonical_label, '') as label, count(*) as n from sit group by 1), o as (select row_number() over (order by n desc, label) as i, concat(label, ',', n) as line from n) select i, line from o union all select 0, 'canonical_label,n'")
def snk_query_render(spark, sf):
    """A result rendered as CSV, line by line."""
    counts = scenario._light(spark, sf).groupBy("canonical_label").agg(F.count("*").alias("n"))  # a row a label
    text = sinks.render(counts.orderBy(F.desc("n"), F.coalesce("canonical_label", F.lit(""))), "csv")
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "i long, line string")


def _array_file(rows, path: str, tasks: int) -> None:
    """(instruction, output) in the order of source_index as one JSON array in a folder of files."""
    lines = rows.select("source_index", F.to_json(F.struct("instruction", "output")).alias("j"))
    first = lines.agg(F.min("source_index").alias("least"))
    lines = lines.crossJoin(F.broadcast(first)).select("source_index", F.concat(F.when(F.col("source_index") == F.col("least"), "[").otherwise(","), F.col("j")).alias("value"))
    end = lines.agg((F.max("source_index") + 1).alias("source_index")).withColumn("value", F.lit("]"))
    _in_order(lines.union(end), tasks).select("value").write.text(path)


def _in_order(rows, tasks: int):
    """Rows dealt to ``tasks`` by ranges of source_index, so that the files written by them are in its order by name."""
    return rows.repartitionByRange(tasks, "source_index").sortWithinPartitions("source_index")


@query("src_split_resolve", duck.RAW.join(["with ", ""]) + "select row_number() over (partition by split order by source_index) - 1 as source_index, split, hero_pos, round(pot_size, 6) as pot_size, length(instruction) as n_chars, correct_decision as output from raw where instruction is not null and correct_decision is not null")
def src_split_resolve(spark, sf):
    """Splits as pairs of a CSV and a JSON array, looked for in two folders and read side by side."""
    place = _place(spark, "splits")
    bridge.scenarios(spark, sf).where("instruction is not null and correct_decision is not null").write.parquet(f"{place}/rows")
    raw = spark.read.parquet(f"{place}/rows")
    tasks = tasks_for(raw)
    for split in readers.SPLITS:
        rows = raw.where(F.col("split") == split)
        _in_order(rows.select(*readers.PREFLOP.names, "source_index"), tasks).drop("source_index").write.option("header", True).option("escape", '"').csv(f"{place}/{split}.csv")
        _array_file(rows.select("source_index", "instruction", F.col("correct_decision").alias("output")), f"{place}/{split}.json", tasks)
    back = readers.read_splits(spark, f"{place}/none", place)
    return back.select("source_index", "split", "hero_pos", F.round("pot_size", 6).alias("pot_size"), F.length("instruction").alias("n_chars"), "output")
