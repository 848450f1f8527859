"""Queries on text functions and validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagmill.functions import text as t
from tagmill.functions import validators as v
from tagmill.operators.spans import chunk_windows
from tagmill.plans import Item
from tagmill.plans.derived import documents
from tagmill.sources import table

_WORD_SQL = t.WORD.replace("'", "''")
_WS = r"[ \t\n\r\f\v]"


def _token_counts(spark, d):
    w = t.words(F.col("text"))
    return documents(spark, d).select("doc_id", F.size(w).alias("tokens"), F.size(F.array_distinct(w)).alias("distinct_tokens"), F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).alias("token_chars"))


def _sentences(spark, d):
    s = t.sentences(F.col("text"))
    return documents(spark, d).select("doc_id", F.size(s).alias("sentences"), F.coalesce(F.array_max(F.transform(s, lambda x: F.length(x))), F.lit(0)).alias("longest"))


# Without lookaround: the white space and what follows are marked first, then the text is cut at the mark.
_SENTENCES = rf"""with s as (select doc_id, list_filter(string_split(regexp_replace(text, '([.!?]){_WS}+([A-ZÇĞİÖŞÜ0-9"(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x) <> '') as s from documents)
select doc_id, cast(len(s) as int) as sentences, cast(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) as int) as longest from s"""


def _sentence_rows(spark, d):
    return _sentences(spark, d)


def _chunks(spark, d):
    n = F.when(F.trim("text") == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " ")), " ")))
    docs = documents(spark, d).select("doc_id", n.alias("words"))
    return chunk_windows(docs, "words").select("doc_id", "chunk", "start_word", "end_word")


_CHUNKS = rf"""with w as (select doc_id, case when trim(text) = '' then 0 else len(string_split(trim(regexp_replace(text, '{_WS}+', ' ', 'g')), ' ')) end as n from documents),
s as (select doc_id, n, unnest(range(0, greatest(n - 64 - 1, 0) + 1, 320)) as start_word from w)
select doc_id, cast(start_word // 320 as int) as chunk, cast(start_word as int) as start_word, cast(least(start_word + 384, n) as int) as end_word from s"""


def _numbers(spark, d):
    """Identity numbers built from order keys; some get a wrong last digit."""
    o = table(spark, d, "orders", "o_orderkey")
    nine = F.lpad((F.col("o_orderkey") * 7919 % 900000000 + 100000000).cast("string"), 9, "0")
    return o.select("o_orderkey", nine.alias("nine"), (F.col("o_orderkey") % 3 == 0).alias("wrong"))


_NUMBERS = "n as (select o_orderkey, cast(o_orderkey * 7919 % 900000000 + 100000000 as varchar) as nine, o_orderkey % 3 = 0 as wrong from orders)"


def _tckn(spark, d):
    n = _numbers(spark, d)
    at = lambda i: F.substring("nine", i + 1, 1).cast("int")
    odd, even = at(0) + at(2) + at(4) + at(6) + at(8), at(1) + at(3) + at(5) + at(7)
    d9 = F.pmod(odd * 7 - even, F.lit(10))
    d10 = (odd + even + d9) % 10
    number = F.concat("nine", d9.cast("string"), ((d10 + F.col("wrong").cast("int")) % 10).cast("string"))
    return n.select("o_orderkey", number.alias("number")).withColumn("valid", v.tckn(F.col("number")))


_TCKN = f"""with {_NUMBERS}, d as (select *, [cast(x as int) for x in string_split(nine, '')] as d from n),
a as (select *, ((7 * (d[1] + d[3] + d[5] + d[7] + d[9]) - (d[2] + d[4] + d[6] + d[8])) % 10 + 10) % 10 as d9, list_sum(d) as s from d)
select o_orderkey, nine || d9 || cast((s + d9 + case when wrong then 1 else 0 end) % 10 as int) as number, not wrong as valid from a"""


def _vkn(spark, d):
    n = _numbers(spark, d)
    number = F.concat("nine", ((v.vkn_check_digit(F.col("nine")) + F.col("wrong").cast("int")) % 10).cast("string"))
    return n.select("o_orderkey", number.alias("number")).withColumn("valid", v.vkn(F.col("number")))


_VKN = f"""with {_NUMBERS}, d as (select *, list_transform(range(0, 9), lambda i: (cast(substr(nine, cast(i + 1 as int), 1) as int) + 9 - i) % 10) as t from n),
e as (select *, list_transform(range(1, 10), lambda i: case when t[i] <> 0 and t[i] * (2 ** (10 - i)) % 9 = 0 then 9 else t[i] * (2 ** (10 - i)) % 9 end) as w from d)
select o_orderkey, nine || cast((((10 - cast(list_sum(w) as int) % 10) % 10) + case when wrong then 1 else 0 end) % 10 as varchar) as number, not wrong as valid from e"""


def _iban(spark, d):
    n = _numbers(spark, d)
    body = F.concat(F.lit("0006100"), F.lpad("nine", 15, "0"))
    check = F.lit(98) - F.concat(body, F.lit("292700")).cast("decimal(38,0)") % 97
    shown = F.concat(F.lit("tr"), F.lpad((check + F.col("wrong").cast("int")).cast("int").cast("string"), 2, "0"), F.lit(" "), body)
    return n.select("o_orderkey", shown.alias("iban")).withColumn("valid", v.iban_tr(F.col("iban")))


_IBAN = f"""with {_NUMBERS}, b as (select *, '0006100' || lpad(nine, 15, '0') as body from n),
c as (select *, cast(98 - cast(body || '292700' as hugeint) % 97 as int) as chk from b)
select o_orderkey, 'tr' || lpad(cast(chk + case when wrong then 1 else 0 end as varchar), 2, '0') || ' ' || body as iban, not wrong as valid from c"""


def _mrz(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_name")
    field = F.rpad(F.upper(F.regexp_replace("c_name", "[^A-Za-z0-9]", "<")), 24, "<")
    return c.select("c_custkey", field.alias("field")).withColumn("check_digit", v.mrz_check_digit(F.col("field")))


_MRZ = """with f as (select c_custkey, rpad(upper(regexp_replace(c_name, '[^A-Za-z0-9]', '<', 'g')), 24, '<') as field from customer)
select c_custkey, field, cast(list_sum(list_transform(range(1, 25), lambda i: [7, 3, 1][(i - 1) % 3 + 1] * case when substr(field, cast(i as int), 1) = '<' then 0 when substr(field, cast(i as int), 1) between '0' and '9' then ascii(substr(field, cast(i as int), 1)) - 48 else ascii(substr(field, cast(i as int), 1)) - 55 end)) % 10 as int) as check_digit from f"""


def _normal(spark, d):
    s = t.squeeze(F.col("text"))
    return documents(spark, d).select("doc_id", F.md5(s).alias("squeezed_md5"), F.length(s).alias("chars"), F.md5(t.closed(F.col("text"))).alias("closed_md5"), F.md5(t.ascii_fold(F.col("text"))).alias("folded_md5"))


_NORMAL = rf"""with s as (select *, trim(regexp_replace(text, '{_WS}+', ' ', 'g')) as s from documents)
select doc_id, md5(s) as squeezed_md5, cast(length(s) as int) as chars, md5(case when right(text, 1) in ('.', '!', '?') then text else text || '.' end) as closed_md5,
md5(translate(text, 'çğıöşüÇĞİÖŞÜ', 'cgiosuCGIOSU')) as folded_md5 from s"""


def _ages(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    birth = F.date_format(F.col("o_orderdate").cast("date"), "dd.MM.yyyy")
    age = F.when(F.col("o_orderkey") % 7 == 0, F.lit("unknown")).otherwise((F.col("o_orderkey") % 40).cast("string"))
    return o.select("o_orderkey", age.alias("age"), birth.alias("birth")).withColumn("contradicts", v.age_contradicts(F.col("age"), F.col("birth")))


_AGES = """with a as (select o_orderkey, case when o_orderkey % 7 = 0 then 'unknown' else cast(o_orderkey % 40 as varchar) end as age, strftime(cast(o_orderdate as date), '%d.%m.%Y') as birth from orders)
select *, coalesce(abs(2026 - try_cast(right(birth, 4) as int) - try_cast(age as int)) > 2, false) as contradicts from a"""

ITEMS = {
    "token_counts": Item(_token_counts, f"with w as (select doc_id, regexp_extract_all(text, '{_WORD_SQL}') as w from documents) select doc_id, cast(len(w) as int) as tokens, cast(len(list_distinct(w)) as int) as distinct_tokens, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as int) as token_chars from w"),
    "sentence_split": Item(_sentence_rows, _SENTENCES),
    "chunk_windows": Item(_chunks, _CHUNKS),
    "tckn_valid": Item(_tckn, _TCKN),
    "vkn_valid": Item(_vkn, _VKN),
    "iban_mod97": Item(_iban, _IBAN),
    "mrz_check": Item(_mrz, _MRZ),
    "text_normal_forms": Item(_normal, _NORMAL),
    "age_contradiction": Item(_ages, _AGES),
}
