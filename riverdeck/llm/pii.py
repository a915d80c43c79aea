"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust a score.

Only DataFrame functions are used.  A kind's spans are found by cutting the text at the
expression (``split`` gives what stands between, ``regexp_extract_all`` the matches themselves) and adding up
lengths in code points.  Base kinds are email, ip, card (Luhn) and phone; the method adds iban (mod 97).

The expressions are written so that they match the same spans as the plain ones but in linear time: a possessive
quantifier where nothing that follows could take back what it holds, and a start only where a run of the first class begins
(or where the last match ended).

Defined cases: a null text is an empty text and has no spans; repeated rows are answered alike; an empty table gives an empty
result; a null doc_id stays null; extra columns are carried and never read, but for those named like a result, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]

#: Length of an IBAN and the countries that have it (fixed values of the public registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # A whole run of digits with single blanks or hyphens between, if it has 12 to 19 digits; others can't pass.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # A country's letters, and as many characters as its account numbers have, with single blanks between.
    "iban": r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])",
}
#: A text without this can hold no match.
HINTS = {"email": "@", "phone": "+"}
#: Nor can one in which this finds nothing; cheaper than the whole expression where that starts with many choices.
FIRST = {"iban": "[A-Z]{2}[0-9]{2}"}
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|debit|payment|account",
    "phone": "phone|tel|call|mobile|fax|contact",
    "iban": "iban|bank|account|transfer",
}
#: Score of a confirmed span without and with a context word within ``NEAR`` code points on either side.
PLAIN, WITH_CONTEXT, NEAR = 0.6, 0.9, 40
#: Spans are added up in runs of ``RUN``, and a long text is read in pieces of ``PIECE`` code points, so that many spans in one text don't cost their square.
RUN, PIECE = 256, 4096


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _mod97(span: Column) -> Column:
    """The remainder of an IBAN whose letters stand for 10 to 35, taken digit by digit."""
    s = F.regexp_replace(span, " ", "")
    turned = F.concat(F.substring(s, 5, 100), F.substring(s, 1, 4))

    def step(left: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v < 65, (left * 10 + v - 48) % 97).otherwise((left * 100 + v - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


def valid(kind: str, span: Column) -> Column:
    if kind == "ip":
        return F.rlike(span, F.lit(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"))
    if kind == "card":
        return F.call_function("luhn_check", _digits(span))
    if kind == "phone":
        return F.length(_digits(span)).between(9, 15)
    if kind == "iban":
        return _mod97(span) == 1
    return F.lit(True)


def _hinted(kind: str, text: Column) -> Column:
    """Whether the expression is worth applying; cheap where no match is possible."""
    return F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else F.rlike(text, F.lit(FIRST.get(kind, PATTERNS[kind])))


def spans_of(kind: str, text: Column) -> Column:
    """array<struct<start, end, kind, ok>> of the proposed spans, in order; ``ok`` says that the check passed."""
    pattern = F.lit(PATTERNS[kind])
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    runs = lambda p: F.transform(F.sequence(F.lit(1), F.size(p), F.lit(RUN)), lambda i: F.slice(p, i, RUN))
    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,ok:boolean>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(s: Column, p: Column) -> Column:
        a = s["at"] + F.length(p["gap"])
        b = a + F.length(p["hit"])
        one = F.struct(a.alias("start"), b.alias("end"), F.coalesce(valid(kind, p["hit"]), F.lit(False)).alias("ok"))
        return F.struct(F.coalesce(b, a).alias("at"), F.when(p["hit"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(one))).alias("out"))

    # Places within each run, then where each run begins.
    parts = _let(pairs, lambda p: F.transform(runs(p), lambda r: F.aggregate(r, start, step)))
    zero = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), "array<int>").alias("out"))
    begins = lambda ps: F.aggregate(ps, zero, lambda s, p: F.struct((s["at"] + p["at"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
    moved = lambda p, by: F.transform(p["out"], lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["ok"].alias("ok")))
    whole = lambda ps: F.when(F.size(ps) == 1, F.get(ps, F.lit(0))["out"]).otherwise(F.flatten(F.zip_with(ps, begins(ps), moved)))
    found = _let(parts, whole)
    return F.when(_hinted(kind, text), found).otherwise(none)


def find(docs: DataFrame, text: str = "text", to: str = "pii") -> DataFrame:
    """``docs`` with ``to``: array<struct<start, order, kind, end, score>> of the confirmed spans, by start, then kind as listed."""
    t = F.coalesce(F.col(text), F.lit(""))
    held = {k: fresh(docs, f"_{k}") for k in KINDS}
    df = docs.withColumns({held[k]: spans_of(k, t) for k in KINDS})
    any_found = sum((F.size(held[k]) for k in KINDS), F.lit(0)) > 0
    pieces = fresh(docs, "_pieces")
    df = df.withColumn(pieces, F.when(any_found & (F.length(t) > PIECE), F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).otherwise(F.array(t)))

    def between(a: Column, b: Column) -> Column:
        """The text from a to b, at most ``NEAR`` code points, taken from the one or two pieces that hold it."""
        k = F.floor(a / PIECE).cast("int")
        two = F.concat(F.coalesce(F.get(pieces, k), F.lit("")), F.coalesce(F.get(pieces, k + 1), F.lit("")))
        return F.substring(two, a - k * PIECE + 1, b - a)

    def confirmed(i: int, kind: str) -> Column:
        ok = F.filter(F.col(held[kind]), lambda x: x["ok"])

        def shaped(x: Column) -> Column:
            a = F.greatest(x["start"] - NEAR, F.lit(0))
            around = F.lower(F.concat(between(a, x["start"]), F.lit(" "), between(x["end"], x["end"] + NEAR)))
            score = F.when(F.rlike(around, F.lit(rf"\b(?:{CONTEXT[kind]})")), WITH_CONTEXT).otherwise(PLAIN)
            return F.struct(x["start"].alias("start"), F.lit(i).alias("order"), F.lit(kind).alias("kind"), x["end"].alias("end"), score.alias("score"))

        return F.transform(ok, shaped)

    every = F.array_sort(F.concat(*[confirmed(i, k) for i, k in enumerate(KINDS)]))
    none = F.from_json(F.lit("[]"), "array<struct<start:int,order:int,kind:string,end:int,score:double>>")
    return df.withColumn(to, F.when(any_found, every).otherwise(none)).drop(pieces, *held.values())


def listed(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, text: str = "text") -> DataFrame:
    found = find(docs.select("doc_id", text), text)
    base = F.filter("pii", lambda x: x["order"] < len(BASE))
    count = lambda i: F.size(F.filter("pii", lambda x: x["order"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("pii")).alias("spans"),
        F.coalesce(F.array_max(F.transform("pii", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each confirmed span replaced by its kind in brackets; of overlapping spans, the first hides what it covers.

    A null text stays null.
    """
    pii = fresh(docs, "_pii")
    found = find(docs, text, pii)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        covered = x["start"] < s["at"]
        piece = F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, x["start"] - s["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(covered, s["out"]).otherwise(piece).alias("out"))

    clean = F.aggregate(pii, start, step, lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.length(text))))
    return found.withColumn(text, F.when(F.size(pii) > 0, clean).otherwise(F.col(text))).drop(pii)
