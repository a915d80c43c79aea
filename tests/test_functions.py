import pytest
from pyspark.sql import functions as F

from riverdeck.functions import cards, labels, lines, prompts, reasoning
from riverdeck.operators import features, rewards


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("hole, chen", [("AhAd", 20), ("AhKh", 12), ("AhKd", 10), ("5h5d", 6), ("2h2d", 5), ("JhTh", 9), ("QhJh", 9), ("9h8h", 7.5), ("Ah5h", 7), ("7h2d", -1.5)])
def test_chen(spark, hole, chen):
    assert one(spark, cards.chen(F.col("h")), h=hole) == chen


@pytest.mark.parametrize("hole, index", [("AhAd", 0), ("AhKh", 1), ("AhKd", 13), ("KhKd", 14), ("7h2d", 163), ("2h2d", 168)])
def test_class_index(spark, hole, index):
    assert one(spark, cards.hand_class_index(F.col("h")), h=hole) == index


def test_all_classes_have_an_index_of_their_own(spark):
    rows = [(a + s + b + t,) for a in cards.RANKS for b in cards.RANKS for s, t in (("h", "h"), ("h", "d")) if (a, s) != (b, t)]
    df = spark.createDataFrame(rows, "h string").select(cards.hand_class(F.col("h")).alias("c"), cards.hand_class_index(F.col("h")).alias("i")).distinct()
    assert df.count() == df.select("i").distinct().count() == 169


def test_equity_falls_back_to_chen(spark):
    assert one(spark, cards.equity_vs_random(F.col("h")), h="Qh8d") == pytest.approx(0.30 + 0.40 * 4 / 21)


@pytest.mark.parametrize(
    "hand, score",
    [
        ("AhKhQhJhTh2c3d", [8, 14]),
        ("AhAsAd2h2c9d7s", [6, 14, 2]),
        ("Ah2s3d4c5h", [4, 5]),
        ("AhAsAdAc2c9d7s", [7, 14, 9]),
        ("AhKhQh9h2h3h4d", [5, 14, 13, 12, 9, 3]),
        ("AhAsKdKcQcQd2s", [2, 14, 13, 12]),
        ("AhAsAdKcKsKd2s", [6, 14, 13]),
        ("AhAs9d7c5s3d2s", [1, 14, 9, 7, 5]),
        ("AhQs9d7c5s3d2s", [0, 14, 12, 9, 7, 5]),
        ("7h7s7d9c5s3dKs", [3, 7, 13, 9]),
        ("Ah2h3h4h5h5d5s", [8, 5]),
    ],
)
def test_hand_score(spark, hand, score):
    df = spark.createDataFrame([(hand,)], "h string").select(cards.cards_of(F.col("h")).alias("c"))
    assert cards.with_score(df, "c").first()["score"] == score


@pytest.mark.parametrize(
    "line, found",
    [
        (None, []),
        ("", []),
        ("UTG/2.0bb/HJ/fold/CO/fold", [("UTG", "raise", 2.0), ("HJ", "fold", None), ("CO", "fold", None)]),
        ("UTG/2.0bb/BTN/call/SB/13.0bb/BB/allin/UTG/fold/BTN/fold", [("UTG", "raise", 2.0), ("BTN", "call", None), ("SB", "raise", 13.0), ("BB", "allin", None), ("UTG", "fold", None), ("BTN", "fold", None)]),
        ("garbage/UTG/2.0bb/xx/BTN/fold", [("UTG", "raise", 2.0), ("BTN", "fold", None)]),
        ("BB/allin/24bb/UTG", [("BB", "allin", 24.0)]),
        (" UTG / CALL //HJ/Bet", [("UTG", "call", None), ("HJ", "raise", None)]),
        ("utg/call", []),
    ],
)
def test_events(spark, line, found):
    got = one(spark, lines.events(F.col("l")), l=line)
    assert [tuple(e) for e in got] == found


def test_event_tokens(spark):
    got = one(spark, F.transform(lines.events(F.col("l")), lines.event_token), l="SB/13.0bb/BTN/fold/CO/2.25bb")
    assert got == ["SB_raise_13bb", "BTN_fold", "CO_raise_2.25bb"]


@pytest.mark.parametrize("line, answer", [("UTG/2bb/BTN/fold", 1), ("UTG/2bb/BTN/call", 0), ("UTG/2bb", -1), ("UTG/call", -1), ("UTG/2bb/HJ/check/BTN/fold", 1), ("UTG/2bb/BTN/8bb", -1), ("UTG/2bb/BTN/8bb/UTG/fold", 1)])
def test_villain_fold(spark, line, answer):
    assert one(spark, lines.villain_fold(lines.events(F.col("l"))), l=line) == answer


@pytest.mark.parametrize("label, want", [("fold", "fold"), ("Check", "check"), ("Call", "call"), ("bet 24", "raise"), ("Raise 3.0bb", "raise"), ("18.5bb", "raise"), ("allin", "allin"), ("all-in", "allin"), ("all in", "allin"), (None, None), ("", None), ("wtf", None)])
def test_canonical(spark, label, want):
    assert one(spark, labels.canonical(F.col("l")), l=label) == want


def test_legacy_label_has_a_sink(spark):
    assert one(spark, labels.canonical_or_unknown(F.col("l")), l="going all-in") == "unknown"
    assert one(spark, labels.canonical_or_unknown(F.col("l")), l=None) == "unknown"


@pytest.mark.parametrize("text, want", [("['fold', 'call']", ["fold", "call"]), ("fold, call,", ["fold", "call"]), (None, []), ("", [])])
def test_moves(spark, text, want):
    assert one(spark, labels.moves(F.col("t")), t=text) == want


PROMPT = (
    "You are playing a 6-handed game. The player positions involved in this game are UTG, HJ, BTN. The small blind is 0.5 chips and the big blind is 1 chips. "
    "Everyone started with 100 chips. In this hand, your position is BTN, and your holding is [Ten of Heart and Jack of Heart]. Before the flop, UTG/2.0bb. "
    "Assume that all other players that is not mentioned folded. The current pot size is 7.5 chips."
)


def test_slots(spark):
    df = spark.createDataFrame([(PROMPT,)], "p string")
    got = df.select(*[c.alias(k) for k, c in prompts.slots(F.col("p")).items()]).first().asDict()
    assert got == {"table_size": 6, "small_blind_chips": 0.5, "big_blind_chips": 1.0, "starting_stack_chips": 100.0, "positions": ["UTG", "HJ", "BTN"], "slot_hero_pos": "BTN", "slot_hero_hole": "ThJh", "pot_size_chips": 7.5}


def test_shell_hides_all_slots(spark):
    other = PROMPT.replace("7.5", "12").replace("UTG/2.0bb", "HJ/call").replace("Ten of Heart", "Ace of Spades").replace("BTN, and", "SB, and")
    df = spark.createDataFrame([(PROMPT,), (other,)], "p string").select(prompts.shell(F.col("p")).alias("s"))
    assert df.distinct().count() == 1
    assert len(df.select(prompts.shell_hash(F.col("s"))).first()[0]) == 16


def test_slots_of_nothing(spark):
    df = spark.createDataFrame([("nothing here",)], "p string")
    assert set(df.select(*[c.alias(k) for k, c in prompts.slots(F.col("p")).items()]).first()) == {None}


@pytest.mark.parametrize("x, want", [(8.5, "8.5"), (8.0, "8"), (100.0, "100"), (13.125, "13.125"), (0.5, "0.5"), (0.0, "0"), (1234.5678, "1234.57")])
def test_format_g(spark, x, want):
    assert one(spark, lines.format_g(F.col("x")), x=x) == want == f"{x:g}"


@pytest.mark.parametrize("text, kind, amount", [("fold.", "fold", None), ("raise 999bb", "raise", 50.0), ("raise 1", "raise", 3.0), ("raise", "raise", 3.0), ("all in", "allin", None), ("", "fold", None), ("I will call.", "call", None), ("check then raise to 8", "raise", 8.0)])
def test_parse_answer(spark, text, kind, amount):
    got = one(spark, prompts.parse_answer(F.col("t"), F.lit(False), F.lit(True), F.lit(3.0), F.lit(50.0), F.lit(True)), t=text)
    assert tuple(got) == (kind, amount)


def test_enforce(spark):
    assert one(spark, prompts.enforce_decision(F.col("t"), F.lit("call")), t="Well.\nDecision: fold") == "Well.\nDecision: call"
    assert one(spark, prompts.enforce_structured(F.col("t"), F.lit("raise 8.0bb")), t="x\n\n### Action\nFOLD") == "x\n\n### Action\nRAISE 8.0 BB"


def test_population_counts_first_actions_only(spark):
    df = spark.createDataFrame([(1, "UTG/2.5bb/CO/8bb/BTN/fold/UTG/fold")], "source_index long, l string").select("source_index", lines.events(F.col("l")).alias("events"))
    got = {r["position"]: r for r in features.population(df, ("source_index",)).collect()}
    assert got["UTG"]["vpip"] == got["UTG"]["pfr"] == 1
    assert got["CO"]["three_bet_pct"] == 1 and got["BTN"]["fold_to_raise_pct"] == 1


def test_pattern_dimension(spark):
    dim = {tuple(r[0]): r[1] for r in lines.pattern_dimension(spark).collect()}
    assert len(dim) == 55987 and [dim[k] for k in ((), (3,), (3, 2), (3, 3, 2, 4))] == [187, 164, 442, 558]


def _seats(spark, rows):
    return spark.createDataFrame(rows, "hand_id long, seat_id int, paid double, folded boolean, score array<int>")


def test_side_pots(spark):
    seats = _seats(spark, [(1, 0, 8.0, False, [5]), (1, 1, 20.0, False, [4]), (1, 2, 50.0, False, [3])])
    assert sorted(r["amount"] for r in rewards.side_pots(seats).collect()) == [24.0, 24.0, 30.0]
    deltas = {r["seat_id"]: r["delta"] for r in rewards.settle(seats).collect()}
    assert deltas == {0: 16.0, 1: 4.0, 2: -20.0}


def test_split_pot_and_conservation(spark):
    seats = _seats(spark, [(1, 0, 10.0, False, [5]), (1, 1, 10.0, False, [5]), (1, 2, 10.0, True, [9])])
    deltas = {r["seat_id"]: r["delta"] for r in rewards.settle(seats).collect()}
    assert deltas == {0: 5.0, 1: 5.0, 2: -10.0} and sum(deltas.values()) == 0


def test_advantage(spark):
    df = spark.createDataFrame([("BTN", 10.0), ("BTN", 2.0), ("SB", -5.0)], "position string, reward_bb double")
    assert sorted(r["advantage"] for r in rewards.advantage(df).collect()) == [-4.0, 0.0, 4.0]


def test_heads_up_button_is_small_blind(spark):
    df = spark.range(2).select(rewards.seat_position(F.col("id"), F.lit(1), 2).alias("p"))
    assert [r["p"] for r in df.collect()] == ["BB", "SB"]


def test_prompts_are_scanned_once_for_the_cards(spark):
    """Cards in English, in any case, with the regular expression over the whole prompt written once; sizes as six significant digits say."""
    df = spark.createDataFrame([("so [Ace of Heart and TWO of clubs] x",), ("[King of spades and Foo of heart]",), ("none",), (None,)], "t string")
    out = df.select(prompts.holding(F.col("t")).alias("h"))
    assert [r.h for r in out.collect()] == ["Ah2c", None, None, None]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(t#") == 1
    sizes = [1.0, 2.5, -3.25, 13.1, 99.9999, 99.99999, 100000.0, 999999.0, 12345.5, 12345.67, 0.5, 0.0, 1.00001, 1.000001, 20.0, 0.1234567]
    got = [r.s for r in spark.createDataFrame([(x,) for x in sizes], "x double").select(lines.format_g(F.col("x")).alias("s")).collect()]
    assert got == [f"{x:.6g}" for x in sizes]


def test_reasoning_scans_only_texts_that_may_match(spark):
    """Guards by plain words change nothing, in any case of the letters; the expressions that need a word stand behind it."""
    import re

    texts = ["A 3-BET here", "3 bet", "reRaise", "all-IN now", "ball in", "ALL IN", "ShoVe", "caller", "a Call", "LIMP", "blimp", "Stack of 40.5BB, POT 7 bb", "position= btn", "Position: sb", "in CO with AhKd", "pot 5 chips", "", None]
    cases = [*reasoning.SITUATIONS, *reasoning.RANGES]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[reasoning._by(F.col("t"), (c,), "no").alias(f"c{i}") for i, c in enumerate(cases)], *[v.alias(k) for k, v in reasoning.facts(F.col("t")).items()])
    for r in out.collect():
        t = r.t or ""
        assert [r[f"c{i}"] for i in range(len(cases))] == [said if re.search(p, t) else "no" for p, said in cases]
        for name, p in (("stack", r"(?i)stack[^0-9]*([0-9]+(?:\.[0-9]+)?)\s*bb"), ("pot", r"(?i)pot[^0-9]*([0-9]+(?:\.[0-9]+)?)\s*bb"), ("hole", r"\b([2-9TJQKA][shdc][2-9TJQKA][shdc])\b")):
            found = re.search(p, t)
            assert r[name] == (found.group(1) if found else None)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("contains(lower(t") >= 10
