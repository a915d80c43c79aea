"""One query for each numbered operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import decontaminate, hpylm, licenses, packing, periodic, pii, quality, repeats, sentencepieces, simhash, spelling, toolcalls, toxicity
from .common import table


def remainder(n: int) -> Column:
    """crc32 of the doc_id as text, modulo n; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n, F.lit(0))


def _first(df: DataFrame, names: str) -> DataFrame:
    """These columns in their order, then all others."""
    names = names.split()
    return df.select(*names, *[c for c in df.columns if c not in names])


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(spark, docs, table(spark, sf_dir, "labels"), remainder(4) != 2)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_tokens", "max_segment", "evidence", "segments")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = sentencepieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces).drop("text")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first(pii.report(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id n_email n_ip n_card n_phone base_sha256 spans")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(names, 256).alias("items_sha256"), "contaminated")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(7) == 2).alias("held_out"))
    return hpylm.fit_and_score(docs)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(spark, docs, table(spark, sf_dir, "labels"))
    return _first(quality.score(docs, model).drop("text"), "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.drop("text").withColumn("expressions", F.array_join("expressions", "; "))


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations")
    return toolcalls.link(toolcalls.messages_to_calls(messages), toolcalls.messages_to_results(messages), [toolcalls.REPLY], toolcalls.messages_to_schemas(messages))


def planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a tenth of the texts, by crc32 of the doc_id, made periodic from some word on; a null doc_id leaves its text alone."""
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.expr(r"filter(split(text, '[ \\t-\\r]+'), x -> x <> '')")).alias("w"))
    docs = docs.select("*", F.size("w").alias("n"), F.expr("h div 10").alias("g"))
    docs = docs.select("*", F.when(F.col("n") > 0, F.expr("int(g % n)")).alias("a"))
    docs = docs.select("*", F.expr("int(1 + (n - a) div (3 + g % 8))").alias("p"))
    periodic_text = F.expr("array_join(slice(concat(slice(w, 1, a), flatten(array_repeat(slice(w, a + 1, p), int(ceil((n - a) / p))))), 1, n), ' ')")
    return docs.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), periodic_text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.with_runs(planted_runs(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    runs = F.when(F.col("n_runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(runs, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


def planted_misspelling(doc: str, word: str) -> str:
    """The word, without one code point where crc32 of document and word is a multiple of 199."""
    h = zlib.crc32(f"{doc}:{word}".encode())
    if h % 199:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), planted_misspelling))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("passages").alias("n_passages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_packing, op3_sentencepiece, op4_pii, op5_decontamination, op6_lm_scoring, op7_simhash, op8_quality, op9_licenses, op10_tool_calls, op11_periodic_runs, op12_spelling_variants, op13_substring_dedup, pipeline)}

_OP5 = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), item_words as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where item_id is not null and text is not null
), windows as (
  select distinct item_id, least(13, len(w)) as n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as k
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from item_words where len(w) > 0)
), sizes as (select distinct n from windows
), places as (
  select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as k
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, sizes where len(w) >= n)
), hits as (select p.doc_id, p.i, p.n, item_id from places p join windows using (n, k)
), hit_words as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(i, i + n)) as place from (select distinct doc_id, i, n from hits)) group by 1
), items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as s from hits group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from words left join hit_words using (doc_id) left join items using (doc_id)
"""

_OP10 = """
with u as (
  select conv_id, turn, text, concat(conv_id, ':', turn) as call_id from conversations where role = 'user'
), chains as (
  select *, turn % 2 as parity, (turn - turn % 2) / 2 as step from u
), islands as (
  select *, cast(step as bigint) - row_number() over (partition by conv_id, parity order by turn) as island from chains
)
select i.conv_id, i.turn, i.call_id, 'reply' as name,
  cast(row_number() over (partition by i.conv_id, i.parity, i.island order by i.turn) - 1 as integer) as level,
  true as valid, a.turn is not null as linked, a.turn as result_turn,
  concat('{"arguments":"{\\"chars\\":', length(coalesce(i.text, '')), ',\\"turn\\":', i.turn, '}","call_id":"', i.call_id, '","name":"reply"',
    case when a.turn is null then '' else concat(',"result":', cast(to_json(coalesce(a.text, '')) as varchar)) end, '}') as record
from islands i left join (select conv_id, turn, text from conversations where role = 'assistant') a on a.conv_id = i.conv_id and a.turn = i.turn + 1
"""

#: crc32 by a table of 256 remainders, in ``crc`` as lists ``t``.
_CRC = """crc as (
  select list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
)"""


def _crc32(text: str) -> str:
    codes = f"list_transform(range(octet_length(encode({text}))), lambda i: cast(concat('0x', substr(hex(encode({text})), cast(2 * i + 1 as bigint), 2)) as bigint))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


# A run of 12 words or more holds 6 places or more in a row with the word of one lag later: places that share their next six words are paired, and islands of them are the runs.
_OP11 = rf"""
with {_CRC}, hashed as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as o, {_crc32("cast(doc_id as varchar)")} as h from documents, crc
), sized as (
  select *, len(o) as n, h // 10 as g from hashed
), planned as (
  select *, case when h % 10 = 0 and n > 0 then g % n end as a from sized
), periods as (
  select *, 1 + (n - a) // (3 + g % 8) as p from planned
), docs as (
  select doc_id, n, case when a is null then o else list_transform(range(n), lambda i: o[case when i < a then i else a + (i - a) % p end + 1]) end as w from periods
), places as (
  select doc_id, i, hash(w[i + 1 : i + 6]) as k, w[i + 1 : i + 6] as s from (select doc_id, w, unnest(range(n - 5)) as i from docs)
), pairs as (
  select x.doc_id, x.i, y.i - x.i as q from places x join places y on x.doc_id = y.doc_id and x.k = y.k and x.i < y.i and x.s = y.s
), islands as (
  select doc_id, q, min(i) as start, count(*) + 5 + q as length
  from (select *, i - row_number() over (partition by doc_id, q order by i) as island from pairs) group by doc_id, q, island
), runs as (
  select doc_id, start, length, min(q) as period from islands where length >= greatest(12, 2 * q) group by all
), told as (
  select doc_id, count(*) as n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' order by start, period) as s,
    first(struct_pack(start, length, period) order by length desc, start, period) as best from runs group by doc_id
), gone as (
  select distinct doc_id, unnest(range(start + period, start + length)) as i from runs
), left_ as (
  select doc_id, string_agg(word, ' ' order by i) as s
  from (select doc_id, unnest(w) as word, unnest(range(n)) as i from docs) anti join gone using (doc_id, i) group by doc_id
)
select doc_id, coalesce(n_runs, 0) as n_runs, best.start as start, cast(best.length as bigint) as length, best.period as period, cast(1000 * best.length // best.period as bigint) as exponent_milli,
  sha256(coalesce(told.s, '')) as runs_sha256, sha256(coalesce(left_.s, '')) as collapsed_sha256, cast(n as bigint) as n_words
from docs left join told using (doc_id) left join left_ using (doc_id)
"""

_OP12 = rf"""
with recursive {_CRC}, found as (
  select doc_id, word, count(*) as n from (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as word from documents
  ) where length(word) >= 6 group by all
), hashed as (
  select word, n, {_crc32("concat(doc_id, ':', word)")} as h from found, crc
), edited as (
  select case when h % 199 = 0 then concat(substr(word, 1, cast(h % length(word) as bigint)), substr(word, cast(h % length(word) as bigint) + 2)) else word end as word, n from hashed
), words as materialized (
  select word, cast(sum(n) as bigint) as n from edited where length(word) >= 6 group by word having sum(n) >= 5
), less as materialized (
  select word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)
), near as materialized (
  select x.word, y.word as other, y.n from less x join less y on x.i = y.i and x.rest = y.rest and x.word <> y.word
  union select x.word, y.word, y.n from less x join words y on x.rest = y.word
  union select y.word, x.word, x.n from less x join words y on x.rest = y.word
), best as (
  select word, count(*) as n_near, first(struct_pack(form := other, n) order by n desc, other collate c) as top from near group by word
), forms as materialized (
  select word, case when top.n >= 5 * words.n then top.form end as form, words.n, coalesce(n_near, 0) as n_near, case when top.n >= 5 * words.n then top.n end as form_n
  from words left join best using (word)
), chains as (
  select word, word as root, 0 as steps from forms
  union all select c.word, f.form, c.steps + 1 from chains c join forms f on f.word = c.root where f.form is not null
)
select word, form, root, n, n_near, form_n from forms join (select word, arg_max(root, steps) as root from chains group by word) using (word)
"""

_OP13 = r"""
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), windows as materialized (
  select doc_id, i, array_to_string(w[i : i + 12], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from words where len(w) >= 13)
), firsts as (
  select k, min(doc_id) as lo from windows group by k
), hits as (
  select doc_id, i from windows join firsts using (k) where lo < doc_id
), gone as materialized (
  select distinct doc_id, unnest(range(i, i + 13)) as i from hits
), stretches as (
  select doc_id, count(*) as n from (select *, i - row_number() over (partition by doc_id order by i) as island from gone) group by doc_id, island
), passages as (
  select doc_id, sum(n) as n_removed, count(*) as n_passages from stretches group by doc_id
), kept as (
  select doc_id, string_agg(word, ' ' order by i) as s
  from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from words) anti join gone using (doc_id, i) group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(s, '')) as kept_sha256, cast(coalesce(n_passages, 0) as integer) as n_passages
from words left join passages using (doc_id) left join kept using (doc_id)
"""

ORACLES = {"op11_periodic_runs": _OP11, "op12_spelling_variants": _OP12, "op13_substring_dedup": _OP13, "op5_decontamination": _OP5, "op10_tool_calls": _OP10}
