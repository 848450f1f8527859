"""Queries on vocabularies, guards, verdicts, bound tags and results built from scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagmill.functions.hashing import hash_uniform
from tagmill.functions.text import find_all
from tagmill.operators import gates as g
from tagmill.operators import guards as gd
from tagmill.operators import structures as st
from tagmill.operators import vocabulary as vo
from tagmill.plans import Item
from tagmill.plans.derived import MENTIONS_SQL, documents, gold, u_sql
from tagmill.sources import table
from tagmill.written import cut


def _bridge(spark, d):
    names = table(spark, d, "nation", "n_name", "n_nationkey").select(F.col("n_nationkey").alias("old"), F.lower("n_name").alias("new"))
    c = table(spark, d, "customer", "c_custkey", "c_nationkey").select("c_custkey", F.col("c_nationkey").cast("long").alias("label"))
    said = vo.bridge(c.withColumn("label", F.col("label").cast("string")), names.withColumn("old", F.col("old").cast("string")), "label")
    some = vo.bridge(c.withColumn("label", F.col("label").cast("string")), names.filter("old % 2 = 0").withColumn("old", F.col("old").cast("string")), "label", strict=False)
    return said.groupBy("label").agg(F.count("*").alias("n")).join(some.groupBy("label").agg(F.count("*").alias("even")), "label", "left").na.fill(0, ["even"])


def _vocabulary(spark, d):
    """Nations and regions as one vocabulary, with names that collide, and part types numbered apart."""
    n = table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    first = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"))
    second = n.filter("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), ((F.col("n_nationkey") + 1) % 25).cast("string")).alias("id"), F.lower("n_name").alias("name"))
    both, clash = vo.merge_vocabularies(first, second)
    return both.select("id", F.coalesce("name_a", F.lit("")).alias("name"), F.coalesce("name_b", F.lit("")).alias("other")).unionByName(clash.select(F.lit("clash").alias("id"), "name", F.array_join("ids", ",").alias("other")))


_VOCABULARY = """with a as (select 'n' || n_nationkey as id, n_name as name from nation), b as (select 'n' || (n_nationkey + 1) % 25 as id, lower(n_name) as name from nation where n_nationkey % 2 = 0),
e as (select * from a union all select * from b)
select coalesce(a.id, b.id) as id, coalesce(a.name, '') as name, coalesce(b.name, '') as other from a full join b on a.id = b.id
union all select 'clash', lower(name), array_to_string(list_sort(list(distinct id)), ',') from e group by lower(name) having count(distinct id) > 1"""


def _unique(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_type")
    return vo.unique_names(p, "p_partkey", "p_type").select("p_partkey", "unique_name")


def _canonical(spark, d):
    li = table(spark, d, "lineitem", "l_linestatus", "l_returnflag", "l_quantity")
    offers = li.groupBy(F.col("l_quantity").cast("int").alias("label"), F.concat("l_returnflag", "l_linestatus").alias("relation")).agg(F.count("*").alias("n")).withColumn("priority", (F.col("relation") == "NO").cast("int"))
    return vo.canonical_relations(offers)


_CANONICAL = """with o as (select cast(l_quantity as int) as label, l_returnflag || l_linestatus as relation, count(*) as n from lineitem group by all)
select label, relation from (select *, row_number() over (partition by label order by relation = 'NO', n desc, relation) as k from o) where k = 1"""


def _taxonomy(spark, d):
    """Regions' and nations' names as a taxonomy with planted faults."""
    n = table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    k = F.col("n_nationkey")
    labels = n.select(F.when(k % 6 == 0, F.col("n_name")).otherwise(F.regexp_replace(F.lower("n_name"), " ", "_")).alias("label"))
    low = F.regexp_replace(F.lower("n_name"), " ", "_")
    aliases = n.select(F.when(k % 5 == 0, F.lit("shared")).when(k == 7, F.lit("france")).otherwise(F.concat(F.lit("a_"), low)).alias("alias"), F.when(k % 6 == 0, F.col("n_name")).when(k == 8, F.lit("nowhere")).otherwise(low).alias("label"))
    relations = n.filter(k % 2 == 1).select(F.concat(F.lit("r"), k.cast("string")).alias("relation"), low.alias("head"), F.when(k == 9, F.lit("gone")).otherwise(low).alias("tail"), F.when(k == 11, F.lit(" ")).when(k != 13, F.lit("{head} {tail}")).alias("template"))
    return vo.taxonomy_problems(labels, aliases, relations)


_TAXONOMY = """with n as (select n_nationkey as k, n_name as nm, replace(lower(n_name), ' ', '_') as low from nation), l as (select distinct case when k % 6 = 0 then nm else low end as label from n),
a as (select case when k % 5 = 0 then 'shared' when k = 7 then 'france' else 'a_' || low end as alias, case when k % 6 = 0 then nm when k = 8 then 'nowhere' else low end as label from n),
r as (select 'r' || k as relation, low as head, case when k = 9 then 'gone' else low end as tail, case when k = 11 then ' ' when k <> 13 then '{head} {tail}' end as template from n where k % 2 = 1), e as (select relation, head as label from r union all select relation, tail from r)
select distinct * from (select 'label format' as problem, label as name from l where not regexp_full_match(label, '[a-z][a-z0-9_]*') union all select 'alias of several', lower(alias) from a group by lower(alias) having count(distinct label) > 1
  union all select 'alias is a label', alias from a where alias in (select label from l) and alias <> label union all select 'broken reference', relation || ':' || label from e where label not in (select label from l) union all select 'broken reference', alias || ':' || label from a where label not in (select label from l)
  union all select 'no template', relation from r where trim(coalesce(template, '')) = '' union all select 'uncovered', label from l where label not in (select label from e))"""


#: What is added to documents by turns, so that every guard has something to find; half of it is a known value of the document.
_TAILS = (
    "", "\nCall 0532 111 22 33 or 14.05.2025 09:30, 1.148.600.000 TL, 255.255.255.0", "\nPlate 34 ABC 123, WVWZZZ1JZXW000001 x34 AB 12", "\nYeni Mahallesi Gül Sokak No: 12", "\nAnadolu Gıda San. Tic. ve Kuzey A.Ş.",
    "\nMedeni Durum: evli, Yaş: 40", "\nsee [1]", "\nTek yönlü olarak etiket", "\nHolder: kisisinin tam adinin ilki", "\nthe phone_number of ipv4", "\nTR33 0006 1005 1978 6457 8413 26",
)
_GUARDED = (*gd.GUARDS, gd.label_guard(["phone_number", "ipv4"]))


def _guarded(spark, d):
    tail = F.element_at(F.array(*(F.lit(t) for t in _TAILS)), (F.col("doc_id") % len(_TAILS) + 1).cast("int"))
    return documents(spark, d, "doc_id", "text").withColumn("text", F.concat("text", tail))


def _guards(spark, d):
    """The first open match of each of the nine guards, with every other recognised mention as a span or as a known value."""
    spans = cut(gold(spark, d).select("doc_id", "start", "end", "surface"), "spans")
    known = spans.filter("start % 2 = 1").select("doc_id", F.col("surface").alias("value"))
    planted = table(spark, d, "documents", "doc_id").filter("doc_id % 2 = 0").select("doc_id", F.explode(F.array(F.lit("0532-111-22-33"), F.lit("34 ABC 123"), F.lit("TR33 0006 1005 1978 6457 8413 26"))).alias("value"))
    return gd.guard_problems(_guarded(spark, d), spans.filter("start % 2 = 0"), known.unionByName(planted), "doc_id", _GUARDED).select("doc_id", "problem", F.md5("surface").alias("surface"), "start")


def _guard_sql(g) -> str:
    text = "lower(text)" if g.folded else "text"
    q = g.pattern.replace("'", "''")
    where = [f"not regexp_matches(surface, '^{g.spared}')"] if g.spared else []
    word = r"[\p{L}\p{N}_]"
    where += [f"not regexp_matches(case when s > 0 then substr({text}, s, 1) else '' end, '{word}') and not regexp_matches(substr({text}, s + length(surface) + 1, 1), '{word}')"] if g.edges else []
    if g.closed_by == "inside":
        where.append("not exists (select 1 from sp where sp.doc_id = h.doc_id and sp.s <= h.s and sp.e >= h.s + length(surface))")
    if g.closed_by == "value":
        where.append(r"not exists (select 1 from sp where sp.doc_id = h.doc_id and sp.s <= h.s + length(regexp_extract(surface, '^[^:]*:[ \t]*')) and sp.e > h.s + length(regexp_extract(surface, '^[^:]*:[ \t]*')))")
    num = lambda c: f"regexp_replace({c}, '[^0-9]', '', 'g')"
    if g.explained_by == "digits":
        where.append(f"not exists (select 1 from kn where kn.doc_id = h.doc_id and {num('value')} <> '' and (contains({num('value')}, {num('surface')}) or contains({num('surface')}, {num('value')})))")
    if g.explained_by == "text":
        where.append("not exists (select 1 from kn where kn.doc_id = h.doc_id and contains(value, trim(surface)))")
    return f"""select doc_id, '{g.problem}' as problem, surface, s from (select doc_id, text, ms[i] as surface, cast(coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) as int) as s
  from (select *, unnest(range(1, len(ms) + 1)) as i from (select doc_id, text, regexp_extract_all({text}, '{q}') as ms, string_split_regex({text}, '{q}') as ps from docs))) h{' where ' + ' and '.join(where) if where else ''}"""


_TAILS_SQL = "[" + ", ".join("'" + t.replace("\n", "' || chr(10) || '") + "'" for t in _TAILS) + "]"
_GUARDS = f"""with recursive {MENTIONS_SQL}, docs as (select doc_id, text || {_TAILS_SQL}[cast(doc_id % {len(_TAILS)} as int) + 1] as text from documents),
sp as (select doc_id, "start" as s, "end" as e from mentions where "start" % 2 = 0), kn as (select doc_id, surface as value from mentions where "start" % 2 = 1 union all select doc_id, unnest(['0532-111-22-33', '34 ABC 123', 'TR33 0006 1005 1978 6457 8413 26']) from documents where doc_id % 2 = 0),
open as ({" union all ".join(_guard_sql(g) for g in _GUARDED)})
select doc_id, problem, md5(surface) as surface, s as "start" from (select *, row_number() over (partition by doc_id, problem order by s, surface) as k from open) where k = 1"""


def _zero(spark, d):
    """Documents as ones that must hold no personal data: how many fail, and why."""
    spans = gold(spark, d).select("doc_id", "start", "end")
    return gd.zero_problems(_guarded(spark, d), spans, "doc_id").groupBy(F.array_join("problems", "/").alias("problems")).agg(F.count("*").alias("docs"))


def _bare(g):
    return g._replace(closed_by="", explained_by="")


_ZERO = f"""with recursive {MENTIONS_SQL}, docs as (select doc_id, text || {_TAILS_SQL}[cast(doc_id % {len(_TAILS)} as int) + 1] as text from documents),
p as (select distinct doc_id, problem from ({" union all ".join(_guard_sql(_bare(g)) for g in gd.GUARDS if g.problem in gd.ZERO)}) union select distinct doc_id, 'tagged span' from mentions)
select problems, count(*) as docs from (select doc_id, string_agg(problem, '/' order by problem) as problems from p group by doc_id) group by 1"""


def _verdicts(spark, d):
    """Order lines as claims; some have no verdict, some a failed judge, some two verdicts."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber").distinct()
    u = F.round(hash_uniform(91, F.col("l_orderkey"), F.col("l_linenumber")), 6)
    v = li.withColumn("u", u).filter("u >= 0.1")
    verdict = F.when(F.col("u") < 0.2, None).when(F.col("u") < 0.6, "yes").otherwise("no")
    second = v.filter("u > 0.9").select("l_orderkey", "l_linenumber", F.lit("yes").alias("verdict"), F.lit("late").alias("evidence"))
    verdicts = v.select("l_orderkey", "l_linenumber", verdict.alias("verdict"), F.lit("early").alias("evidence")).unionByName(second)
    out = g.verdict_gate(li, verdicts, ["l_orderkey", "l_linenumber"])
    return out.groupBy("outcome", F.coalesce("evidence", F.lit("none")).alias("evidence")).agg(F.count("*").alias("n"))


_VERDICTS = f"""with l as (select distinct l_orderkey, l_linenumber from lineitem), u as (select round({u_sql(91, "l_orderkey || '|' || l_linenumber")}, 6) as u from l)
select case when u < 0.1 then 'dropped' when u < 0.2 then 'flagged' when u < 0.6 or u > 0.9 then 'kept' else 'dropped' end as outcome, case when u < 0.1 then 'none' when u > 0.9 then 'late' else 'early' end as evidence, count(*) as n from u group by all"""


def _answers(spark, d):
    """Judges' answers: JSON inside prose, some without, some out of range, some with a field less."""
    o = table(spark, d, "orders", "o_orderkey")
    k = F.col("o_orderkey")
    body = F.concat(F.lit('{"fit": '), (k % 7).cast("string"), F.when(k % 5 == 0, F.lit("}")).otherwise(F.concat(F.lit(', "tone": '), (k % 4 + 1).cast("string"), F.lit("}"))))
    answer = F.when(k % 11 == 0, F.lit("no idea")).otherwise(F.concat(F.lit("Well:\n"), body, F.lit("\nBye")))
    v = g.parse_verdict(answer, ["fit", "tone"])
    return o.select("o_orderkey", v.alias("v")).groupBy(F.coalesce(F.col("v.fit"), F.lit(0)).alias("fit"), F.coalesce(F.col("v.tone"), F.lit(0)).alias("tone")).agg(F.count("*").alias("n"))


_ANSWERS = """with x as (select o_orderkey as k, o_orderkey % 11 <> 0 and o_orderkey % 5 <> 0 and o_orderkey % 7 between 1 and 5 as ok from orders)
select cast(case when ok then k % 7 else 0 end as int) as fit, cast(case when ok then k % 4 + 1 else 0 end as int) as tone, count(*) as n from x group by all"""


def _tags(spark, d):
    """Customers of a nation as its entities; tags name them rightly, under another label, not at all, or name nobody."""
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    e = c.select(F.col("c_nationkey").alias("doc"), F.col("c_custkey").alias("id"), F.col("c_name").alias("value"), F.col("c_mktsegment").alias("label"))
    k = F.col("c_custkey")
    t = c.filter(k % 4 != 0).select(F.col("c_nationkey").alias("doc"), F.when(k % 5 == 0, F.concat("c_name", F.lit("?"))).otherwise(F.concat(F.lit(" "), F.upper("c_name"))).alias("value"), F.when(k % 7 == 0, F.lit("OTHER")).otherwise(F.col("c_mktsegment")).alias("label"))
    return g.bind_tags(t, e, "doc").groupBy("doc", F.coalesce("problem", F.lit("bound")).alias("problem")).agg(F.count("*").alias("n"), F.coalesce(F.sum("id"), F.lit(0)).alias("ids"))


_TAGS = """with x as (select c_nationkey as doc, c_custkey as k, case when c_custkey % 4 = 0 then 'missing' when c_custkey % 5 = 0 then 'unknown value' when c_custkey % 7 = 0 then 'label mismatch' else 'bound' end as p from customer),
y as (select doc, p as problem, case when p in ('missing', 'bound') then k end as id from x union all select doc, 'missing', k from x where p in ('unknown value', 'label mismatch'))
select doc, problem, count(*) as n, cast(coalesce(sum(id), 0) as bigint) as ids from y group by all"""


def _findings(spark, d):
    """A scan's quotes: some stand in a recognised mention, some elsewhere, some nowhere; and repairs that may be tried."""
    m = cut(gold(spark, d).select("doc_id", "start", "end", "surface"), "mentions")
    docs = documents(spark, d, "doc_id", "text")
    q = m.select("doc_id", F.explode(F.array(F.substring("surface", 2, 4), F.concat(F.substring("surface", 1, 3), F.lit("#")))).alias("quote")).unionByName(docs.select("doc_id", F.substring("text", 5, 6).alias("quote"))).distinct()
    found = g.outside_entities(q, docs, m, "doc_id")
    problems = found.select("doc_id", F.when(F.col("start") > 20, F.concat(F.lit("late: "), "quote")).otherwise(F.concat(F.lit("early: "), "quote")).alias("problem"))
    return found.groupBy("doc_id").agg(F.count("*").alias("found"), F.min("start").alias("first")).join(g.unfixable_left_out(problems, "doc_id", ["late"]).select("doc_id", F.size("problems").alias("repair")), "doc_id", "left").na.fill(0, ["repair"])


_FINDINGS = f"""with recursive {MENTIONS_SQL}, q as (select doc_id, substr(surface, 2, 4) as q from mentions union select doc_id, left(surface, 3) || '#' from mentions union select doc_id, substr(text, 5, 6) from documents),
a as (select q.*, instr(text, q) - 1 as s from q join documents using (doc_id) where q <> '' and instr(text, q) > 0),
o as (select * from a where not exists (select 1 from mentions m where m.doc_id = a.doc_id and m."start" <= s and s + length(q) <= m."end"))
select doc_id, count(*) as found, cast(min(s) as int) as first, case when max(s) > 20 then 0 else cast(count(*) as int) end as repair from o group by doc_id"""


def _candidate_spans(spark, d):
    """Numbers of documents as scored candidates of two labels, with thresholds of their own; one label gives its best alone."""
    docs = documents(spark, d, "doc_id", "text")
    hits = docs.select("doc_id", F.inline(find_all(F.col("text"), "[0-9]+"))).select("doc_id", "start", "end")
    logit = F.round(hash_uniform(95, F.col("doc_id"), F.col("start")) * 6 - 3, 6)
    s = hits.withColumn("label", F.when(F.col("start") % 3 == 0, "year").otherwise("amount")).withColumn("logit", logit)
    wide = s.withColumn("end", F.col("end") + 2).withColumn("logit", F.col("logit") - 0.5)
    out = st.decode_candidates(s.unionByName(wide), ["doc_id"], {"year": 0.3}, 0.6, "Confidence", scalar=("year",))
    return out.select("doc_id", "label", "start", "end", F.col("rank").cast("bigint").alias("rank"))


# A wide candidate overlaps its own narrow one, which scores more, and at most the next number's.
_CANDIDATE_SPANS = rf"""with recursive p as (select doc_id, regexp_extract_all(text, '[0-9]+') as ms, string_split_regex(text, '[0-9]+') as ps from documents where regexp_matches(text, '[0-9]')),
i as (select *, unnest(range(1, len(ms) + 1)) as i from p), h as (select doc_id, cast(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) as int) as s, length(ms[i]) as n from i),
l as (select doc_id, s, s + n as e, case when s % 3 = 0 then 'year' else 'amount' end as label, round({u_sql(95, "doc_id || '|' || s")} * 6 - 3, 6) as z from h),
b as (select * from l union all select doc_id, s, e + 2, label, z - 0.5 from l), c as (select *, round(1 / (1 + exp(-z)), 9) as c from b), f as (select * from c where c >= case label when 'year' then 0.3 else 0.6 end),
r as (select *, row_number() over (partition by doc_id, label order by c desc, e - s desc, s) as k from f),
w as (select doc_id, label, 0 as k, cast([] as struct(s bigint, e bigint, k bigint)[]) as kept from (select distinct doc_id, label from r)
  union all select w.doc_id, w.label, w.k + 1, case when len(list_filter(w.kept, lambda q: q.s < r.e and r.s < q.e)) > 0 then w.kept else list_append(w.kept, {{'s': r.s, 'e': r.e, 'k': r.k}}) end from w join r on r.doc_id = w.doc_id and r.label = w.label and r.k = w.k + 1),
o as (select r.* from r join (select doc_id, label, unnest(arg_max(kept, k)).k as k from w group by doc_id, label) x using (doc_id, label, k)),
y as (select *, row_number() over (partition by doc_id, label order by c desc, s, e) as n from o)
select doc_id, label, cast(s as int) as "start", cast(e as int) as "end", row_number() over (partition by doc_id order by c desc, s, e, label) as rank from y where label <> 'year' or n = 1"""


def _gated_spans(spark, d):
    """The same candidates with amounts shut for every fourth document and years that must have four digits at most, counted by document and label."""
    docs = documents(spark, d, "doc_id", "text")
    s = docs.select("doc_id", F.inline(find_all(F.col("text"), "[0-9]+"))).withColumn("label", F.when(F.col("start") % 3 == 0, "year").otherwise("amount")).withColumn("logit", F.round(hash_uniform(95, F.col("doc_id"), F.col("start")) * 6 - 3, 6))
    wide = s.withColumn("end", F.col("end") + 2).withColumn("text", F.concat("text", F.lit("00000"))).withColumn("logit", F.col("logit") + 0.5)
    gates = docs.select("doc_id", F.lit("amount").alias("label"), (F.col("doc_id") % 4 != 0).alias("open"))
    out = st.decode_candidates(s.unionByName(wide), ["doc_id"], {"year": 0.3}, 0.6, "allow", gates=gates, valid={"year": F.length("text") <= 4})
    return out.groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))


_GATED_SPANS = rf"""with p as (select doc_id, regexp_extract_all(text, '[0-9]+') as ms, string_split_regex(text, '[0-9]+') as ps from documents where regexp_matches(text, '[0-9]')), i as (select *, unnest(range(1, len(ms) + 1)) as i from p),
h as (select doc_id, cast(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) as int) as s, length(ms[i]) as n from i),
l as (select doc_id, n, n as digits, case when s % 3 = 0 then 'year' else 'amount' end as label, round({u_sql(95, "doc_id || '|' || s")} * 6 - 3, 6) as z from h), b as (select * from l union all select doc_id, n + 2, digits + 5, label, z + 0.5 from l)
select doc_id, label, count(*) as n, cast(sum(n) as bigint) as chars from b where not (label = 'amount' and doc_id % 4 = 0) and not (label = 'year' and digits > 4) and round(1 / (1 + exp(-z)), 9) >= case label when 'year' then 0.3 else 0.6 end group by all"""


def _attributes(spark, d):
    """Parts as spans of their brand; size class is one of three, marks are any of two; marks are asked of some brands only."""
    p = table(spark, d, "part", "p_partkey", "p_brand")
    z = lambda s: F.round(hash_uniform(s, F.col("p_partkey")) * 4 - 2, 6)
    c = lambda a, ch, s: F.struct(F.lit(a).alias("attribute"), F.lit(ch).alias("choice"), z(s).alias("logit"))
    s = p.select("p_partkey", F.col("p_brand").alias("label"), F.inline(F.array(c("size", "big", 101), c("size", "mid", 102), c("size", "tiny", 103), c("mark", "new", 104), c("mark", "rare", 105))))
    out = st.attributes(s, ["p_partkey"], {"size": True, "mark": False}, {"size": [f"Brand#{i}" for i in range(1, 56)], "mark": ["Brand#11", "Brand#22", "Brand#33"]}, 0.6)
    return out.withColumn("p", F.round("p", 5))


_ATTRIBUTES = f"""with z as (select p_partkey, p_brand, {", ".join(f"round({u_sql(s, 'p_partkey')} * 4 - 2, 6) as z{s}" for s in range(101, 106))} from part), t as (select *, exp(z101) + exp(z102) + exp(z103) as t, greatest(z101, z102, z103) as m from z)
select p_partkey, 'size' as attribute, case when z101 = m then 'big' when z102 = m then 'mid' else 'tiny' end as choice, round(round(exp(m) / t, 9), 5) as p from t
union all select p_partkey, 'mark', 'new', round(round(1 / (1 + exp(-z104)), 9), 5) from t where p_brand in ('Brand#11', 'Brand#22', 'Brand#33') and round(1 / (1 + exp(-z104)), 9) >= 0.6 union all select p_partkey, 'mark', 'rare', round(round(1 / (1 + exp(-z105)), 9), 5) from t where p_brand in ('Brand#11', 'Brand#22', 'Brand#33') and round(1 / (1 + exp(-z105)), 9) >= 0.6"""


def _structures(spark, d):
    """Orders as structures: line numbers are instances, parts and suppliers extracted, the return flag a choice; of equal flags the table's first.

    As in the SQL, a line with a null key has no scores, and fields without an instance don't meet.
    """
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    scored = li.dropna(subset=["l_orderkey", "l_partkey", "l_suppkey"])
    f = lambda name, v, s: F.struct(F.lit(name).alias("field"), F.col(v).cast("string").alias("value"), F.round(hash_uniform(s, F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")), 6).alias("p"))
    told = F.inline(F.array(f("part", "l_partkey", 111), f("flag", "l_returnflag", 112), f("supplier", "l_suppkey", 113)))
    rows = scored.select("l_orderkey", F.col("l_linenumber").cast("int").alias("instance"), "file", "row", told)
    out = st.structures(rows.withColumn("alone", F.when(F.col("instance").isNull(), F.col("field"))), ["l_orderkey", "alone"], {"flag": False}, 0.7, ["file", "row"])
    said = lambda name: F.coalesce(F.array_join(F.try_element_at("values", F.lit(name)), ","), F.lit(""))
    return out.select("l_orderkey", "instance", said("part").alias("parts"), said("supplier").alias("suppliers"), said("flag").alias("flag"))


_LP = "l_orderkey || '|' || l_partkey || '|' || l_suppkey"
_TOLD = "(select l_orderkey, instance, string_agg({0}, ',' order by p desc, {0}) as {1} from (select l_orderkey, instance, {0}, max({2}) as p from x where {2} >= 0.7 group by all) group by all)"
_STRUCTURES = f"""with x as (select l_orderkey, l_linenumber as instance, cast(l_partkey as varchar) as part, l_returnflag as flag, cast(l_suppkey as varchar) as supplier, {", ".join(f"round({u_sql(s, _LP)}, 6) as {n}" for s, n in ((111, "pp"), (112, "pf"), (113, "ps")))} from lineitem),
a as {_TOLD.format("part", "parts", "pp")}, b as (select l_orderkey, instance, arg_max(flag, pf) as flag from x where pf >= 0.7 group by all), c as {_TOLD.format("supplier", "suppliers", "ps")}
select l_orderkey, cast(instance as int) as instance, coalesce(parts, '') as parts, coalesce(suppliers, '') as suppliers, coalesce(flag, '') as flag from a full join b using (l_orderkey, instance) full join c using (l_orderkey, instance)"""


def _classified(spark, d):
    docs = documents(spark, d, "doc_id")
    z = lambda s: F.round(hash_uniform(s, F.col("doc_id")) * 4 - 2.5, 6)
    s = docs.select("doc_id", F.inline(F.array(*(F.struct(F.lit(n).alias("label"), z(k).alias("logit")) for k, n in ((121, "a"), (122, "b"), (123, "c"))))))
    many = st.classification(s, ["doc_id"], False, 0.5, F.when(F.size("selected") > 2, "too many"))
    one = st.classification(s, ["doc_id"], True).select("doc_id", F.array_join("selected", ",").alias("top"), F.round("confidence", 7).alias("top_p"))
    return many.join(one, "doc_id").select("doc_id", F.array_join("selected", ",").alias("selected"), F.round("confidence", 7).alias("confidence"), F.round("utility", 6).alias("utility"), F.coalesce("violations", F.lit("")).alias("violations"), "top", "top_p")


_CLASSIFIED = f"""with z as (select doc_id, {", ".join(f"round({u_sql(s, 'doc_id')} * 4 - 2.5, 6) as z{s}" for s in (121, 122, 123))} from documents), m as (select *, greatest(z121, z122, z123) as m from z),
s as (select *, list_filter(['a', 'b', 'c'], lambda l: case when m < 0 then case l when 'a' then z121 = m when 'b' then z122 = m else z123 = m end else case l when 'a' then z121 >= 0 when 'b' then z122 >= 0 else z123 >= 0 end end) as s from m),
v as (select *, list_transform(s, lambda l: case l when 'a' then z121 when 'b' then z122 else z123 end) as v from s)
select doc_id, array_to_string(s, ',') as selected, round(round(1 / (1 + exp(-list_min(v))), 9), 7) as confidence, round(list_sum(v), 6) as utility, case when len(s) > 2 then 'too many' else '' end as violations, case when z121 = m then 'a' when z122 = m then 'b' else 'c' end as top, round(round(exp(m) / (exp(z121) + exp(z122) + exp(z123)), 9), 7) as top_p from v"""

def _copies(spark, d):
    """Hints of a document: words four to eleven of its own text, and of the text of the document before; its third word is a value."""
    words = lambda parts: F.filter(parts, lambda x: x != "")
    texts, gap = documents(spark, d, "doc_id", "text"), r"[^a-z0-9]+"
    docs = texts.select("doc_id", F.array_join(words(F.split(F.lower("text"), gap, -1)), " ").alias("text"))
    # eleven words are in the first twelve parts, of which only the first may be empty; the thirteenth is the rest of the text
    begins = texts.select("doc_id", words(F.slice(F.split(F.lower("text"), gap, 13), 1, 12)).alias("w"))
    value = F.when(F.size("w") > 5, F.concat(F.lit(" "), F.try_element_at("w", F.lit(6)), F.lit(" ")))
    said = cut(begins.select("doc_id", F.array_join(F.slice("w", 4, 8), " ").alias("hint"), value.alias("value")), "hints")
    hints = said.select("doc_id", "hint").unionByName(said.select((F.col("doc_id") + 1).alias("doc_id"), "hint"))
    values = said.filter("value is not null").select("doc_id", "value")
    return g.copied_hints(docs, hints, values, "doc_id").groupBy("doc_id").agg(F.count("*").alias("copied"))


_COPIES = """with d as (select doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') as w from documents),
h as (select doc_id, array_to_string(w[4:11], ' ') as h from d union select doc_id + 1, array_to_string(w[4:11], ' ') from d), v as (select doc_id, ' ' || w[6] || ' ' as v from d where len(w) > 5),
b as (select h.doc_id, h.h, list_filter(string_split_regex(replace(h.h, coalesce(v, chr(1)), ' '), '[^a-z0-9]+'), lambda x: x <> '') as w, ' ' || trim(regexp_replace(replace(array_to_string(d.w, ' '), coalesce(v, chr(1)), ' '), '[^a-z0-9]+', ' ', 'g')) || ' ' as t from h join d using (doc_id) left join v using (doc_id))
select doc_id, count(*) as copied from b where len(w) > 4 and len(list_filter(range(1, len(w) - 3), lambda i: contains(t, ' ' || array_to_string(w[i:i + 4], ' ') || ' '))) > 0 group by doc_id"""


def _lines(spark, d):
    """Which benchmark lines stand in no document, by their length."""
    missing = g.lines_missing(table(spark, d, "benchmark", "text"), documents(spark, d, "text"))
    return missing.groupBy((F.length("line") % 10).alias("class")).agg(F.count("*").alias("n"))


ITEMS = {
    "label_bridge": Item(_bridge, "select lower(n_name) as label, count(*) as n, case when n_nationkey % 2 = 0 then count(*) else 0 end as even from customer join nation on c_nationkey = n_nationkey group by n_name, n_nationkey"),
    "vocabulary_merge": Item(_vocabulary, _VOCABULARY),
    "unique_names": Item(_unique, "select p_partkey, case when k = 1 then p_type else p_type || ' ' || k end as unique_name from (select *, row_number() over (partition by lower(p_type) order by p_partkey) as k from part)"),
    "canonical_relations": Item(_canonical, _CANONICAL),
    "taxonomy_validate": Item(_taxonomy, _TAXONOMY),
    "document_guards": Item(_guards, _GUARDS),
    "zero_data_gate": Item(_zero, _ZERO),
    "verdict_gate": Item(_verdicts, _VERDICTS),
    "verdict_parse": Item(_answers, _ANSWERS),
    "tag_binding": Item(_tags, _TAGS),
    "scan_findings": Item(_findings, _FINDINGS),
    "gated_decode": Item(_gated_spans, _GATED_SPANS),
    "candidate_decode": Item(_candidate_spans, _CANDIDATE_SPANS),
    "span_attributes": Item(_attributes, _ATTRIBUTES),
    "structure_assembly": Item(_structures, _STRUCTURES),
    "ngram_copy_guard": Item(_copies, _COPIES),
    "lines_missing": Item(_lines, "with b as (select distinct unnest(string_split(text, chr(10))) as l from benchmark), d as (select distinct unnest(string_split(text, chr(10))) as l from documents) select cast(length(l) % 10 as int) as class, count(*) as n from b where l not in (select l from d) group by 1"),
    "classification_result": Item(_classified, _CLASSIFIED),
}
