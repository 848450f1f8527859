"""Queries on graph checks, harmony, addresses and predicates on rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagmill.functions import text as t
from tagmill.functions import turkish as tr
from tagmill.operators import bundles as b
from tagmill.plans import Item
from tagmill.plans.derived import documents, u_sql
from tagmill.sources import table
from tagmill.written import cut, new_folder


def _problems(spark, d):
    """Orders as graphs: lines are entities, edges go to the next line; some skip, some point at themselves or at nothing."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").filter("l_orderkey is not null")
    key, n = F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long")
    ents = li.select(key, n.alias("id"), F.col("l_returnflag").alias("label"))
    k = F.col("doc")
    target = F.when(k % 7 == 0, F.col("id") + 2).when((k % 11 == 0) & (F.col("id") == 1), F.col("id")).otherwise(F.col("id") + 1)
    ids = ents.select("doc", F.col("id").alias("tail")).distinct()
    rels = ents.groupBy("doc", "id").agg(F.min("label").alias("relation")).select("doc", "relation", F.col("id").alias("head"), target.alias("tail"))
    rels = rels.join(ids, ["doc", "tail"], "left_semi").unionByName(rels.filter("doc % 13 = 0 and head = 1").withColumn("tail", F.lit(99).cast("long")))
    kinds = ents.sparkSession.range(1).select(F.inline(F.array(*(F.struct(F.lit(r).alias("relation"), F.lit(s).alias("side"), F.lit(x).alias("label")) for r in "ANR" for s in ("head", "tail") for x in ("ANR" if r != "R" else "AR")))))
    out = b.bundle_problems(ents, rels, kinds, ents.select("doc", F.lit(1).cast("long").alias("id")).distinct(), "doc")
    return out.groupBy("problem").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("docs"))


_PROBLEMS = """with recursive e as (select l_orderkey as doc, cast(l_linenumber as bigint) as id, l_returnflag as label from lineitem), l as (select doc, id, min(label) as label from e group by all),
r0 as (select doc, label as relation, id as head, case when doc % 7 = 0 then id + 2 when doc % 11 = 0 and id = 1 then id else id + 1 end as tail from l),
r as (select r0.* from r0 join l on l.doc = r0.doc and l.id = r0.tail union all select doc, relation, head, 99 from r0 where doc % 13 = 0 and head = 1),
x as (select r.*, h.label as hl, t.label as tl from r left join l h on h.doc = r.doc and h.id = head left join l t on t.doc = r.doc and t.id = tail),
m as (select distinct doc, cast(1 as bigint) as id from e union select m.doc, case when r.head = m.id then r.tail else r.head end from m join r on r.doc = m.doc and (r.head = m.id or r.tail = m.id)),
p as (select doc, 'duplicate id' as problem, cast(id as varchar) as detail from e group by doc, id having count(*) > 1 union select doc, 'missing end', relation from x where hl is null or tl is null union select doc, 'self-relation', relation from x where head = tail
  union select doc, 'head label', relation || '/' || hl from x where relation = 'R' and hl = 'N' union select doc, 'tail label', relation || '/' || tl from x where relation = 'R' and tl = 'N'
  union select doc, 'not connected', cast(id as varchar) from l where not exists (select 1 from m where m.doc = l.doc and m.id = l.id))
select problem, count(*) as n, count(distinct doc) as docs from p group by problem"""


def _fields(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    fields = F.array_compact(F.array(F.lit("head"), F.when(F.col("l_orderkey") % 50 != 7, F.lit("tail")), F.when(F.col("l_linestatus") == "X", F.lit("when"))))
    return b.field_inconsistencies(li.select(F.concat("l_returnflag", "l_linestatus").alias("relation"), fields.alias("fields"), "l_orderkey"), "l_orderkey")


_FIELDS = """with x as (select l_returnflag || l_linestatus as relation, l_orderkey as k, case when l_orderkey % 50 <> 7 then 'head,tail' else 'head' end as f from lineitem), a as (select relation, arg_min(f, k) as f, min(k) as k from x group by 1)
select a.relation, a.k as first, a.f as fields, min(x.k) as other, arg_min(x.f, x.k) as other_fields from x join a on a.relation = x.relation and a.f <> x.f group by a.relation, a.k, a.f"""


def _flags(spark, d):
    docs = documents(spark, d, "doc_id", "text", "n_chars").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("old"))).alias("flags"), F.when(F.col("doc_id") % 5 == 0, "rejected").otherwise("accepted").alias("bucket"), "n_chars", "text")
    out = b.late_flags(docs, {"long": F.col("n_chars") > 4000, "symbols": F.contains("text", F.lit("%")), "unknown": F.lit(None).cast("boolean")})
    return out.groupBy("bucket", F.array_join("flags", ",").alias("flags")).agg(F.count("*").alias("n"))


_FLAGS = """with x as (select doc_id % 5 = 0 as r, array_to_string(list_filter([case when doc_id % 4 = 0 then 'old' end, case when n_chars > 4000 then 'long' end, case when contains(text, '%') then 'symbols' end], lambda v: v is not null), ',') as flags from documents)
select case when r then 'rejected' when flags <> '' then 'flagged' else 'accepted' end as bucket, flags, count(*) as n from x group by all"""


def _cache(spark, d):
    """Sentences scored once each, however often they stand, into a table that a second run finds; and what is left to do after a first block that passed a gate."""
    sentences = documents(spark, d, "doc_id", "text").select("doc_id", F.explode(t.sentences(F.col("text"))).alias("s"))
    s, path = cut(sentences, "sentences", "zstd"), new_folder(spark, "scores")
    vowels = lambda c: F.length(F.regexp_replace(c, "[^aeiou]", ""))
    b.cached_each(s.filter("doc_id % 2 = 0"), "s", vowels, "score", path)
    found, _ = b.cached_each(s, "s", vowels, "score", path)
    scored = cut(found.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum("score").alias("score")), "scored")
    first, rest = b.gated(scored, ["sentences", "doc_id"], 50, lambda f: f.filter("sentences > 0").count() == 50)
    return first.withColumn("part", F.lit("first")).unionByName(rest.withColumn("part", F.lit("rest")) if rest is not None else first.limit(0).withColumn("part", F.lit("rest")))


_CACHE = r"""with s as (select doc_id, unnest(list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+([A-ZÇĞİÖŞÜ0-9"(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x) <> '')) as s from documents),
n as (select doc_id, count(*) as sentences, cast(sum(length(regexp_replace(s, '[^aeiou]', '', 'g'))) as bigint) as score from s group by 1)
select *, case when row_number() over (order by sentences, doc_id) <= 50 then 'first' else 'rest' end as part from n"""


def _harmony(spark, d):
    """Customers' segments and keys with a suffix each, in one text; only wrong ones change."""
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment")
    k = F.col("c_custkey")
    suffix = F.element_at(F.array(*(F.lit(x) for x in ("de", "dan", "nin", "ye", "yi", "dir", "ler", "daki", "xyz"))), (k % 9 + 1).cast("int"))
    word = F.when(k % 3 == 0, F.lower("c_mktsegment")).when(k % 3 == 1, k.cast("string")).otherwise(F.substring("c_mktsegment", 1, 2))
    docs = c.select("c_custkey", F.concat(F.lit("é "), word, F.lit("'"), suffix, F.lit(" ve "), word, F.lit("’"), suffix, F.lit(".")).alias("text"), F.length(word).alias("n"))
    spans = docs.select("c_custkey", F.inline(F.array(F.struct(F.lit(2).alias("start"), (F.col("n") + 2).alias("end")), F.struct((F.instr("text", " ve ") + 3).alias("start"), (F.instr("text", " ve ") + 3 + F.col("n")).alias("end")))))
    return tr.fix_suffixes(docs.select("c_custkey", "text"), spans, "c_custkey")


def _addresses(spark, d):
    """Suppliers at made-up places: quarters cleaned, streets told apart, addresses in all shapes."""
    s = table(spark, d, "supplier", "s_suppkey", "s_name", "s_nationkey")
    k = F.col("s_suppkey")
    raw = F.concat(F.lit("yeni "), F.lower("s_name"), F.when(k % 3 == 0, " mah").when(k % 3 == 1, " (eski köyü)").otherwise(" yayla"))
    name, rural = tr.neighbourhood(raw)
    street = F.concat(F.col("s_name"), F.element_at(F.array(*(F.lit(x) for x in (" Sk.", " caddesi", " Blv", " küme evleri", " yolu"))), (k % 5 + 1).cast("int")))
    part = {"quarter": name, "street": street, "no": k, "flat": k % 9, "floor": k % 4, "town": F.lit("Town"), "city": F.concat(F.lit("City"), F.col("s_nationkey").cast("string")), "zip": F.lpad(F.col("s_nationkey").cast("string"), 5, "0")}
    return s.select("s_suppkey", rural.alias("rural"), tr.street_kind(street).alias("kind"), tr.address((k % 5 + 1).cast("int"), part, k % 2 == 0).alias("address"))


_ADDRESSES = """with x as (select s_suppkey as k, s_nationkey as c, 'Yeni ' || array_to_string(list_transform(string_split(lower(s_name), ' '), lambda w: upper(translate(left(w, 1), 'iı', 'İI')) || substr(w, 2)), ' ') || case k % 3 when 0 then ' Mah.' when 1 then '' else ' Yayla' end as q,
  s_name || [' Sk.', ' caddesi', ' Blv', ' küme evleri', ' yolu'][s_suppkey % 5 + 1] as s, lpad(cast(s_nationkey as varchar), 5, '0') as z, s_suppkey % 5 + 1 as h, s_suppkey % 2 = 0 as w from (select *, s_suppkey as k from supplier))
select k as s_suppkey, k % 3 > 0 as rural, ['sokak', 'cadde', 'bulvar', 'kume', 'other'][k % 5 + 1] as kind, case h
  when 1 then q || ' ' || s || ' No:' || k || ' D:' || k % 9 || ' ' || case when w then z || ' ' else '' end || 'Town/City' || c when 2 then q || ' ' || s || ' No:' || k || ' Daire:' || k % 9 || ' ' || case when w then z || ' ' else '' end || 'Town/City' || c
  when 3 then s || ' No:' || k || '/' || k % 9 || ', ' || q || ', Town, City' || c || case when w then ' ' || z else '' end when 4 then q || ', ' || s || ', No: ' || k || ', Kat: ' || k % 4 || ', Daire: ' || k % 9 || ', ' || case when w then z || ' ' else '' end || 'Town / City' || c
  else q || ' ' || s || ' ' || k || '/' || k % 9 || ' Town City' || c end as address from x"""


def _star(spark, d):
    """A nation and then a customer drawn for each supplier's region, by weight."""
    n = table(spark, d, "nation", "n_nationkey", "n_regionkey").withColumn("weight", F.col("n_nationkey") % 4)
    c = table(spark, d, "customer", "c_custkey", "c_nationkey").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), (F.col("c_custkey") % 3 + 1).alias("weight"))
    s = table(spark, d, "supplier", "s_suppkey").withColumn("n_regionkey", (F.col("s_suppkey") % 5).cast("int"))
    return b.star_pick([(n, "n_nationkey", "n_regionkey"), (c, "c_custkey", "n_nationkey")], s, ["s_suppkey"]).select("s_suppkey", "n_regionkey", "n_nationkey", "c_custkey")


_STAR = f"""with n as (select n_nationkey, n_regionkey, n_nationkey % 4 as w, sum(n_nationkey % 4) over (partition by n_regionkey order by n_nationkey) as upto, sum(n_nationkey % 4) over (partition by n_regionkey) as total from nation where n_nationkey % 4 > 0),
c as (select c_custkey, c_nationkey, c_custkey % 3 + 1 as w, sum(c_custkey % 3 + 1) over (partition by c_nationkey order by c_custkey) as upto, sum(c_custkey % 3 + 1) over (partition by c_nationkey) as total from customer),
a as (select s_suppkey, n_regionkey, n_nationkey from (select *, {u_sql(42, "s_suppkey || '|n_nationkey'")} * total as t from supplier join n on n_regionkey = s_suppkey % 5) where upto - w <= t and t < upto)
select s_suppkey, n_regionkey, n_nationkey, c_custkey from (select *, {u_sql(42, "s_suppkey || '|c_custkey'")} * total as t from a join c on c_nationkey = n_nationkey) where upto - w <= t and t < upto"""


def _predicates(spark, d):
    """Why a turn is left out, the first reason that holds: repeated text, few words, many words; and which stay in a sample."""
    c = table(spark, d, "conversations", "conv_id", "turn", "text")
    n = F.when(F.trim("text") == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " ")), " ")))
    first = c.groupBy(F.md5(F.lower("text")).alias("m")).agg(F.min(F.struct("conv_id", "turn")).alias("f"))
    rows = c.withColumn("m", F.md5(F.lower("text"))).join(first, "m").withColumn("n", n)
    reason = F.when(F.struct("conv_id", "turn") != F.col("f"), "repeated").when(F.col("n") < 8, "few words").when(F.col("n") > 60, "many words")
    return rows.select("conv_id", "turn", "n", F.coalesce(reason, F.lit("kept")).alias("outcome"))


_PREDICATES = r"""with x as (select conv_id, turn, text, case when trim(text) = '' then 0 else len(string_split(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')), ' ')) end as n, row_number() over (partition by md5(lower(text)) order by conv_id, turn) as k from conversations)
select conv_id, turn, cast(n as int) as n, case when k > 1 then 'repeated' when n < 8 then 'few words' when n > 60 then 'many words' else 'kept' end as outcome from x"""

ITEMS = {
    "bundle_problems": Item(_problems, _PROBLEMS),
    "field_inconsistencies": Item(_fields, _FIELDS),
    "late_flags": Item(_flags, _FLAGS),
    "sentence_cache": Item(_cache, _CACHE),
    "suffix_harmony": Item(_harmony),
    "address_shapes": Item(_addresses, _ADDRESSES),
    "star_lookup": Item(_star, _STAR),
    "row_predicates": Item(_predicates, _PREDICATES),
}
