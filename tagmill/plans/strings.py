"""Queries on further text functions and validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagmill.functions import text as t
from tagmill.functions import validators as v
from tagmill.plans import Item
from tagmill.plans.derived import documents
from tagmill.sources import table


def _splitters(spark, d):
    c = table(spark, d, "conversations", "conv_id", "turn", "text")
    say = lambda w: F.md5(F.array_join(w, "\n"))
    x = F.replace("text", F.lit("e s"), F.lit("e's"))
    return c.select("conv_id", "turn", say(t.char_words(x)).alias("chars"), say(t.low_words(x)).alias("low"), say(t.clitic_words(x)).alias("clitics"))


_SPLITTERS = rf"""with x as (select conv_id, turn, replace(text, 'e s', 'e''s') as t from conversations)
select conv_id, turn, md5(array_to_string(regexp_extract_all(t, '[A-Za-z0-9@._\-+]+|\S'), chr(10))) as chars, md5(array_to_string(list_transform(regexp_extract_all(t, '{t.WORD.replace("'", "''")}'), lambda y: lower(y)), chr(10))) as low,
  md5(array_to_string(regexp_extract_all(t, '[^\s''’][^\s''’]*|[''’]\S*'), chr(10))) as clitics from x"""


def _cases(spark, d):
    """Part names in Turkish cases, and keys and file names made of them."""
    p = table(spark, d, "part", "p_partkey", "p_name", "p_type")
    name = F.translate("p_name", "oc", "ıI")
    description = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("  "), name)).otherwise("")
    return p.select("p_partkey", t.tr_upper(name).alias("upper"), t.tr_title(name).alias("title"), t.document_type(F.concat(F.lit(" A  "), "p_type", F.lit("\t"))).alias("kind"), t.brief_key(description, F.col("p_type")).alias("brief"), t.file_name(F.concat_ws("/", "p_name", "p_type")).alias("file"))


_CASES = r"""with n as (select *, translate(p_name, 'oc', 'ıI') as n from part), w as (select *, list_transform(string_split(trim(regexp_replace(n, '[ \t]+', ' ', 'g')), ' '), lambda x: upper(translate(left(x, 1), 'iı', 'İI')) || lower(translate(substr(x, 2), 'İI', 'iı'))) as w from n)
select p_partkey, upper(translate(n, 'iı', 'İI')) as upper, array_to_string(w, ' ') as title, lower('A ' || trim(regexp_replace(p_type, '[ \t]+', ' ', 'g'))) as kind, md5(lower(trim(case when p_partkey % 3 <> 0 then '  ' || n else p_type end))) as brief, regexp_replace(p_name || '/' || p_type, '[^A-Za-z0-9\-_.]', '_', 'g') as file from w"""


def _fences(spark, d):
    c = table(spark, d, "conversations", "conv_id", "turn", "text")
    raw = F.concat(F.lit("```json\n"), F.col("text"), F.lit("\n```\n"), F.when(F.col("turn") % 2 == 0, "==END==").otherwise(""))
    text, done = t.without_fences(raw, "==END==")
    return c.select("conv_id", "turn", F.md5(F.regexp_replace(text, r"\s", "")).alias("md5"), done.alias("complete"))


def _junk(spark, d):
    m = documents(spark, d, "doc_id", "text").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f\x0B]+(?: [A-Z][a-z]+)?"), F.lit(0))).alias("m"))
    return m.groupBy(F.coalesce(t.junk_reason(F.col("m")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("m").alias("mentions"))


_JUNK = r"""with m as (select unnest(regexp_extract_all(text, '[^ \t\n\r\f\v]+(?: [A-Z][a-z]+)?')) as m from documents), c as (select m, replace(m, ' ', '') as c from m),
r as (select m, case when length(regexp_replace(c, '\p{P}', '', 'g')) = 0 then 'punctuation' when c = m and length(regexp_replace(c, '[^\p{L}]', '', 'g')) < 4 then 'short' when 1 - length(regexp_replace(c, '\p{P}', '', 'g')) / length(c) > 0.3 then 'noisy' else 'kept' end as reason from c)
select reason, count(*) as n, count(distinct m) as mentions from r group by 1"""


def _context(spark, d):
    """The first number in a document: what stands around it, whether its first word is said right before, and which pronoun prevails there."""
    docs = documents(spark, d, "doc_id", "text").withColumn("hit", F.regexp_extract("text", "[0-9]+", 0)).filter("hit <> ''")
    at = docs.withColumn("start", F.expr("locate(hit, text) - 1"))
    around = t.near(F.col("text"), F.col("start"), F.col("start") + F.length("hit"))
    return at.select("doc_id", F.md5(around).alias("around"), t.repeated_before(F.concat(F.substring("text", F.lit(1), F.col("start")), F.col("hit"), F.lit(" "), F.col("hit")), F.col("start") + F.length("hit") + 1, F.col("hit")).alias("repeated"), t.votes(around, {"the": "the ", "a": " a "}).alias("vote"))


_CONTEXT = r"""with h as (select doc_id, text, regexp_extract(text, '[0-9]+') as hit from documents), s as (select *, instr(text, hit) - 1 as s from h where hit <> ''),
n as (select *, substr(text, greatest(s - 60, 0) + 1, s + length(hit) + 60 - greatest(s - 60, 0)) as a from s), v as (select *, len(regexp_extract_all(a, 'the ')) as the, len(regexp_extract_all(a, ' a ')) as an from n)
select doc_id, md5(a) as around, length(hit) between 3 and 39 and not regexp_matches(rtrim(substr(text, greatest(s + length(hit) + 1 - 40, 0) + 1, s - greatest(s + length(hit) + 1 - 40, 0))), '[:\-]$') as repeated, case when the > an then 'the' when an > the then 'a' end as vote from v"""


def _devices(spark, d):
    """Device numbers, postal codes and plates made of order keys, and machine-readable lines."""
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    k = F.col("o_orderkey")
    digits = F.lpad((k * 7919).cast("string"), 15, "3")
    plate = F.concat(F.lpad((k % 97).cast("string"), 2, "0"), F.lit(" ABC "), F.lpad((k % 1000).cast("string"), 3, "0"))
    date = F.date_format(F.col("o_orderdate").cast("date"), "yyMMdd")
    return o.select("o_orderkey", v.imei(digits).alias("imei"), F.coalesce(v.province(plate), F.lit(0)).alias("plate"), F.coalesce(v.province(F.lpad((k * 37 % 100000).cast("string"), 5, "0")), F.lit(0)).alias("post"), v.mrz_line(F.concat(F.lit("a-"), (k % 10000).cast("string")), date, F.lit("300101")).alias("line"))


_VALUE = "lambda c: case when c = '<' then 0 when c between '0' and '9' then ascii(c) - 48 else ascii(c) - 55 end"
_DIGIT = lambda f: f"cast(list_sum(list_transform(range(1, length({f}) + 1), lambda i: [7, 3, 1][(i - 1) % 3 + 1] * list_transform(string_split({f}, ''), {_VALUE})[i])) % 10 as int)"
_DEVICES = f"""with k as (select o_orderkey as k, lpad(cast(o_orderkey * 7919 as varchar), 15, '3') as dg, lpad(cast(o_orderkey * 37 % 100000 as varchar), 5, '0') as post, rpad(upper('a<' || o_orderkey % 10000), 9, '<') as f1, strftime(cast(o_orderdate as date), '%y%m%d') as f2 from orders),
l as (select *, f1 || {_DIGIT('f1')} || f2 || {_DIGIT('f2')} || '300101' || {_DIGIT("'300101'")} as line from k), x as (select *, list_transform(string_split(dg, ''), lambda c: cast(c as int)) as ds from l)
select k as o_orderkey, list_sum(list_transform(range(1, 16), lambda i: case when i % 2 = 1 then ds[i] when ds[i] > 4 then ds[i] * 2 - 9 else ds[i] * 2 end)) % 10 = 0 as imei, case when k % 97 between 1 and 81 then cast(k % 97 as int) else 0 end as plate,
  case when cast(left(post, 2) as int) between 1 and 81 then cast(left(post, 2) as int) else 0 end as post, line || {_DIGIT('line')} as line from x"""

_RULES = {"BUILDING": (r"^Customer#[0-9]+$", 1, 18, 1, 1), "MACHINERY": (r"0", 5, 40, 1, 2), "AUTOMOBILE": (r"^C", 19, 40, 1, 9)}


def _kinds(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment")
    value = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(" "), "c_name", F.lit(" x"))).otherwise(F.col("c_name"))
    return c.groupBy("c_mktsegment").agg(F.count(F.when(v.fits_rule(value, F.col("c_mktsegment"), _RULES), 1)).alias("fit"), F.count("*").alias("n"))


def _heat(spark, d):
    p = F.round((F.col("quality") * 3 + F.col("doc_id") % 5) / 10, 4)
    return table(spark, d, "labels", "doc_id", "quality").select("doc_id", F.round(v.tempered(p, 2.0), 9).alias("p"))


ITEMS = {
    "word_splitters": Item(_splitters, _SPLITTERS),
    "text_cases": Item(_cases, _CASES),
    "fence_strip": Item(_fences, r"select conv_id, turn, md5(regexp_replace(text, '\s', '', 'g')) as md5, turn % 2 = 0 as complete from conversations"),
    "junk_mentions": Item(_junk, _JUNK),
    "mention_context": Item(_context, _CONTEXT),
    "device_numbers": Item(_devices, _DEVICES),
    "value_rules": Item(_kinds, "with v as (select c_mktsegment as k, trim(case when c_custkey % 4 = 0 then ' ' || c_name || ' x' else c_name end) as v from customer) select k as c_mktsegment, count(*) filter (case k when 'BUILDING' then regexp_matches(v, '^Customer#[0-9]+$') and length(v) <= 18 when 'MACHINERY' then contains(v, '0') and length(v) between 5 and 40 when 'AUTOMOBILE' then starts_with(v, 'C') and length(v) between 19 and 40 else false end) as fit, count(*) as n from v group by 1"),
    "temperature_scaled": Item(_heat, "with p as (select doc_id, round((quality * 3 + doc_id % 5) / 10, 4) as p from labels) select doc_id, round(case when p <= 0 or p >= 1 then p else 1 / (1 + exp(-(ln(p) - ln(1 - p)) / 2)) end, 9) as p from p"),
}
