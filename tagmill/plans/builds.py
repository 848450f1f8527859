"""Queries on event structures, sparse scores, frozen builds, readers of any format and rows for review."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagmill.functions.kinds import FORMS, PLACEHOLDER_PHRASES, PLACEHOLDERS, by_words, refusal
from tagmill.functions.text import WORD, find_all
from tagmill.operators import events as ev
from tagmill.operators import reviewing as rv
from tagmill.operators import sparse as sp
from tagmill.operators.building import token_spans
from tagmill.operators.corpus import keep_first
from tagmill.operators.spans import priority_merge
from tagmill.plans import Item
from tagmill.plans.derived import CANDIDATES_SQL, MENTIONS_SQL, documents, found, gold
from tagmill.sources import frozen, readers, table
from tagmill.written import cut, new_folder


def _events(spark, d):
    """Odd order lines as events, even ones near by as their parts; a part belongs to one event only, flags to all they fit."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").repartition("l_orderkey")
    lines = li.groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("n")).agg(F.min("l_quantity").cast("double").alias("q"), F.min("l_extendedprice").cast("double").alias("p"))
    orders = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("n", "q", "p")).alias("lines"))
    odd, even = F.filter("lines", lambda x: x["n"] % 2 == 1), F.filter("lines", lambda x: x["n"] % 2 == 0)
    offer = lambda a, m, field, c: F.struct(a["n"].alias("anchor"), F.lit(field).alias("field"), m["n"].alias("mention"), F.round(1 / (1 + F.abs(a[c] - m[c])), 6).alias("score"))
    near = lambda a: F.filter("even", lambda m: F.abs(a["n"] - m["n"]) <= 3)
    offers = F.flatten(F.transform("odd", lambda a: F.flatten(F.transform(near(a), lambda m: F.array(offer(a, m, "part", "q"), offer(a, m, "flag", "p"))))))
    sides = orders.select("l_orderkey", odd.alias("odd"), even.alias("even"))
    rows = sides.select("l_orderkey", F.transform("odd", lambda a: a["n"]).alias("anchors"), F.when(F.col("l_orderkey").isNotNull(), offers).alias("offers"))
    out = ev.bind_rows(rows, ["l_orderkey"], [ev.Field("part", 1, 1), ev.Field("flag", 0, 2, exclusive=False)])
    items = lambda f: F.coalesce(F.array_join(F.transform(F.try_element_at("fields", F.lit(f)), lambda x: x["mention"].cast("string")), ","), F.lit(""))
    return out.select("l_orderkey", "anchor", items("part").alias("part"), items("flag").alias("flags"), F.array_join("missing", ",").alias("missing"), "complete")


_EVENTS = """with recursive li as (select l_orderkey, cast(l_linenumber as bigint) as n, cast(min(l_quantity) as double) as q, cast(min(l_extendedprice) as double) as p from lineitem group by all),
o as (select a.l_orderkey, a.n as anchor, b.n as mention, round(1 / (1 + abs(a.q - b.q)), 6) as s, round(1 / (1 + abs(a.p - b.p)), 6) as f from li a join li b on a.l_orderkey = b.l_orderkey and a.n % 2 = 1 and b.n % 2 = 0 and abs(a.n - b.n) <= 3),
r as (select *, row_number() over (partition by l_orderkey order by s desc, anchor, mention) as k from o),
walk as (select l_orderkey, 0 as k, cast([] as struct(a bigint, m bigint)[]) as kept from (select distinct l_orderkey from r)
  union all select w.l_orderkey, w.k + 1, case when len(list_filter(w.kept, lambda z: z.a = r.anchor or z.m = r.mention)) > 0 then w.kept else list_append(w.kept, {'a': r.anchor, 'm': r.mention}) end from walk w join r on r.l_orderkey = w.l_orderkey and r.k = w.k + 1),
part as (select l_orderkey, z.a as anchor, z.m as mention from (select l_orderkey, unnest(arg_max(kept, k)) as z from walk group by l_orderkey)),
flag as (select l_orderkey, anchor, string_agg(mention, ',' order by k) as flags from (select *, row_number() over (partition by l_orderkey, anchor order by f desc, mention) as k from o) where k <= 2 group by all)
select l_orderkey, n as anchor, coalesce(cast(mention as varchar), '') as part, coalesce(flags, '') as flags, case when mention is null then 'part' else '' end as missing, mention is not null as complete
from li left join part on part.l_orderkey = li.l_orderkey and part.anchor = li.n left join flag on flag.l_orderkey = li.l_orderkey and flag.anchor = li.n where n % 2 = 1""".replace("select l_orderkey, n as anchor, coalesce(cast", "select li.l_orderkey, n as anchor, coalesce(cast")


def _sparse(spark, d):
    """Mention counts as scores of labels, with planted duplicates, strangers and scores out of range; probabilities among all labels."""
    m = cut(gold(spark, d).groupBy("doc_id", "label").agg(F.count("*").alias("n")), "counts")
    k = F.col("doc_id")
    vocabulary = m.select(F.lit("pii").alias("task"), "label").distinct().unionByName(spark.range(3).select(F.lit("pii").alias("task"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("label")))
    told = m.select("doc_id", F.lit("pii").alias("task"), "label", F.when((k % 11 == 0) & (F.col("label") == "card"), 99.0).otherwise(F.log1p(F.col("n").cast("double"))).alias("logit"))
    more = m.filter((k % 9 == 0) & (F.col("label") == "email")).select("doc_id", F.lit("pii").alias("task"), "label", F.lit(0.5).alias("logit"))
    ghosts = m.filter(k % 10 == 0).select("doc_id").distinct().select("doc_id", F.lit("pii").alias("task"), F.lit("ghost").alias("label"), F.lit(0.1).alias("logit"))
    good, problems = sp.checked_scores(told.unionByName(more).unionByName(ghosts), vocabulary, ["doc_id"], -20, 20)
    p = sp.implied_softmax(cut(good, "good"), vocabulary, ["doc_id"], -1.0)
    return p.select("doc_id", "label", F.lit("").alias("problem"), F.round("p", 7).alias("p"), F.round("implied_p", 7).alias("implied_p")).unionByName(problems.select("doc_id", "label", "problem", F.lit(0.0).alias("p"), F.lit(0.0).alias("implied_p")))


_SPARSE = f"""with recursive {MENTIONS_SQL}, m as (select doc_id, label, count(*) as n from mentions group by all), v as (select count(distinct label) + 3 as k from m),
b as (select doc_id, label, case when doc_id % 9 = 0 and label = 'email' then 'duplicate' when doc_id % 11 = 0 and label = 'card' then 'out of range' else '' end as problem, ln(1 + n) as l from m),
s as (select doc_id, sum(exp(l)) as s, count(*) as told from b where problem = '' group by doc_id)
select doc_id, label, '' as problem, round(exp(l) / (s + (k - told) * exp(-1.0)), 7) as p, round(exp(-1.0) / (s + (k - told) * exp(-1.0)), 7) as implied_p from b join s using (doc_id), v where problem = ''
union all select doc_id, label, problem, 0.0, 0.0 from b where problem <> '' union all select distinct doc_id, 'ghost', 'unknown label', 0.0, 0.0 from m where doc_id % 10 = 0"""

_SUBSETS = {"contact": ["email", "phone"], "number": ["card", "ipv4"], "any": ["email", "phone", "card", "ipv4"]}


def _frozen(spark, d):
    """Subsets of documents by label as a frozen build: its manifest, and how many partitions a second build of the same rows, and one of other rows, writes."""
    docs = documents(spark, d, "doc_id", "lang", "source")
    m = cut(gold(spark, d).select("doc_id", "label"), "mentions")
    rows, path = cut(frozen.label_subsets(docs, m, "doc_id", _SUBSETS), "rows"), new_folder(spark, "frozen")
    rules = {
        "a document once in a subset": lambda r, _: r.groupBy("subset", "doc_id").count().filter("count > 1"),
        "contact and number are parts of any": lambda r, _: r.filter("subset <> 'any'").join(r.filter("subset = 'any'").select("doc_id"), "doc_id", "left_anti"),
    }
    frozen.publish(rows, path, "subset", rules)
    again = frozen.publish(rows.orderBy("source"), path, "subset", rules)
    later = frozen.publish(rows.filter("subset <> 'number' or doc_id % 2 = 0"), path, "subset", rules)
    counted = spark.read.parquet(later.data).groupBy("subset").agg(F.count("*").alias("there"))
    manifest = spark.read.parquet(later.manifest).join(counted, "subset")
    return manifest.select("subset", "rows", "checksum", "there", F.lit(len(again.changed)).alias("again"), F.lit(",".join(later.changed)).alias("later"))


_IN = lambda labels: ", ".join(f"'{x}'" for x in labels)
_FROZEN = f"""with recursive {MENTIONS_SQL}, s as ({" union all ".join(f"select '{n}' as subset, doc_id, lang, source from documents where doc_id in (select doc_id from mentions where label in ({_IN(ls)}))" for n, ls in _SUBSETS.items())}),
k as (select * from s where subset <> 'number' or doc_id % 2 = 0), c as (select subset, count(*) as n from s group by subset having n > (select count(*) from k where k.subset = s.subset))
select subset, count(*) as rows, cast(sum(('0x' || substr(md5(concat_ws(chr(31), doc_id, lang, source, subset)), 1, 8))::bigint) as bigint) as checksum, count(*) as there, 0 as again, coalesce((select string_agg(subset, ',' order by subset) from c), '') as later from k group by subset"""


def _formats(spark, d):
    """Customers written in each format and read by its ending; all give the same rows."""
    c = table(spark, d, "customer", "c_custkey", "c_name")
    schema, out = "c_custkey long, c_name string", None
    for ending in ("parquet", "jsonl", "ndjson", "json", "csv", "tsv"):
        path = f"{new_folder(spark, 'customers')}.{ending}"
        if ending == "parquet":
            c.write.parquet(path)
        elif ending in ("csv", "tsv"):
            c.write.option("header", True).option("sep", "\t" if ending == "tsv" else ",").csv(path)
        elif ending == "json":  # whole documents: an array of records each, a file each
            c.groupBy((F.col("c_custkey") % 7).alias("g")).agg(F.to_json(F.collect_list(F.struct("c_custkey", "c_name"))).alias("value")).write.partitionBy("g").text(path)
        else:
            c.write.json(path)
        part = readers.read_any(spark, path, schema).agg(F.lit(ending).alias("ending"), F.count("*").alias("n"), F.sum("c_custkey").alias("keys"), F.sum(F.length("c_name")).alias("chars"))
        out = part if out is None else out.unionByName(part)
    return out


_FORMATS = "select unnest(['parquet', 'jsonl', 'ndjson', 'json', 'csv', 'tsv']) as ending, count(*) as n, cast(sum(c_custkey) as bigint) as keys, cast(sum(length(c_name)) as bigint) as chars from customer"


def _dimensions(spark, d):
    """Nations by region as JSON arrays, a folder each, read as one dimension; a name that several hold is the first one's."""
    path = new_folder(spark, "dims")
    n = table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("file"), F.col("n_nationkey").cast("long").alias("id"), F.lower("n_name").alias("name"))
    shared = n.groupBy("file").agg((F.max("id") + 1000).alias("id")).withColumn("name", F.lit("shared"))
    arrays = n.unionByName(shared).groupBy("file").agg(F.to_json(F.sort_array(F.collect_list(F.struct("id", "name")))).alias("value"))
    arrays.write.partitionBy("file").text(path)
    rows = readers.read_dimensions(spark, path, "id long, name string, file string")
    return keep_first(rows, [F.col("name")], ["file", "_file", "id"]).select("name", "id", "file")


_DIMENSIONS = """with n as (select 'r' || n_regionkey as file, cast(n_nationkey as bigint) as id, lower(n_name) as name from nation), a as (select * from n union all select file, max(id) + 1000, 'shared' from n group by file)
select name, id, file from (select *, row_number() over (partition by name order by file, id) as k from a) where k = 1"""

_WORD_SQL = WORD.replace("'", "''")


def _token_spans(spark, d):
    """Numbers and capitalised words of turns as first and last token of their place."""
    c = table(spark, d, "conversations", "conv_id", "turn", "text")
    spans = F.transform(find_all(F.col("text"), "[A-Z][a-z]+ [a-z]+"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("pair").alias("label")))
    placed = c.select("conv_id", "turn", token_spans(spans, find_all(F.col("text"), WORD)).alias("s"))
    return placed.select("conv_id", "turn", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["first"].cast("string"), x["last"].cast("string"))), ",").alias("spans"))


def _places(pattern: str, name: str) -> str:
    return f"""{name}m as (select conv_id, turn, regexp_extract_all(text, '{pattern}') as ms, string_split_regex(text, '{pattern}') as ps from conversations),
{name} as (select conv_id, turn, i - 1 as i, cast(coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) as int) as s, length(ms[i]) as n from (select *, unnest(range(1, len(ms) + 1)) as i from {name}m))"""


_TOKEN_SPANS = f"""with {_places(_WORD_SQL, "t")}, {_places("[A-Z][a-z]+ [a-z]+", "p")},
x as (select p.conv_id, p.turn, p.i, min(t.i) as a, max(t.i) as b from p join t on t.conv_id = p.conv_id and t.turn = p.turn and t.s < p.s + p.n and p.s < t.s + t.n group by all)
select conv_id, turn, coalesce((select string_agg(a || ':' || b, ',' order by i) from x where x.conv_id = c.conv_id and x.turn = c.turn), '') as spans from conversations c"""


def _merged(spark, d):
    """E-mail mentions first, then whatever other or longer candidate fits beside them."""
    m = cut(found(spark, d).select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "label", "surface"), "found")
    wide = m.select("doc_id", F.greatest(F.col("start") - 4, F.lit(0)).alias("start"), (F.col("end") + 6).alias("end"), F.lit("wide").alias("label"), "surface")
    return priority_merge(m.filter("label = 'email'"), m.filter("label <> 'email'").unionByName(wide), ["doc_id"])


_MERGED = f"""with recursive {CANDIDATES_SQL}, e as (select 0 as p, doc_id, "start" as s, "end" as e, label, surface from cands where label = 'email' union all select 1, doc_id, "start", "end", label, surface from cands where label <> 'email' union all select 1, doc_id, greatest("start" - 4, 0), "end" + 6, 'wide', surface from cands),
o as (select *, row_number() over (partition by doc_id order by p, s, e, label, surface) as k from e),
walk as (select doc_id, 0 as k, cast([] as struct(s int, e int, k bigint)[]) as kept from (select distinct doc_id from o)
  union all select w.doc_id, w.k + 1, case when o.p = 1 and len(list_filter(w.kept, lambda z: z.s < o.e and o.s < z.e)) > 0 then w.kept else list_append(w.kept, {{'s': o.s, 'e': o.e, 'k': o.k}}) end from walk w join o on o.doc_id = w.doc_id and o.k = w.k + 1)
select o.doc_id, o.s as "start", o.e as "end", label, surface from o join (select doc_id, unnest(arg_max(kept, k)).k as k from walk group by doc_id) f on f.doc_id = o.doc_id and f.k = o.k"""


def _review_rows(spark, d):
    """Documents for review: recognised entities, labels as a judge's verdicts, sensitive where an entity is a card."""
    docs = documents(spark, d, "doc_id", "text")
    bundles = gold(spark, d).select("doc_id", "label", F.col("surface").alias("value"), F.when(F.col("label") == "card", "kept apart: sensitive").otherwise("plain").alias("sensitivity"))
    labels = table(spark, d, "labels", "doc_id", "quality", "toxic")
    verdicts = labels.select("doc_id", F.inline(F.array(F.struct(F.lit("good").alias("claim"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("verdict")), F.struct(F.lit("clean").alias("claim"), F.when(F.col("toxic") == 0, "yes").otherwise("no").alias("verdict")))))
    r = rv.review_rows(docs, bundles, verdicts, "doc_id", "sensitive").select("doc_id", "review.*")
    return r.select("doc_id", F.col("chars").cast("long").alias("chars"), F.size("entities").cast("long").alias("entities"), F.md5(F.array_join(F.transform("entities", lambda e: F.concat_ws("=", e["label"], e["value"])), "|")).alias("said"), "labels", "sensitive", F.array_join(F.transform("verdicts", lambda v: F.concat_ws("=", v["claim"], v["verdict"])), ",").alias("verdicts"), "refused")


_REVIEW_ROWS = f"""with recursive {MENTIONS_SQL}, e as (select doc_id, count(*) as n, string_agg(label || '=' || surface, '|' order by label, surface) as said, count(distinct label) as labels, bool_or(label = 'card') as sensitive from mentions group by doc_id),
v as (select doc_id, string_agg('clean=' || case when toxic = 0 then 'yes' else 'no' end, ',') || ',' || string_agg('good=' || case when quality = 1 then 'yes' else 'no' end, ',') as verdicts, cast(sum(case when quality = 1 then 0 else 1 end + case when toxic = 0 then 0 else 1 end) as bigint) as refused from labels group by doc_id)
select d.doc_id, length(d.text) as chars, coalesce(n, 0) as entities, md5(coalesce(said, '')) as said, coalesce(labels, 0) as labels, coalesce(sensitive, false) as sensitive, coalesce(verdicts, '') as verdicts, coalesce(refused, 0) as refused from documents d left join e on e.doc_id = d.doc_id left join v on v.doc_id = d.doc_id"""


def _told(spark, d):
    """Customers' kinship to the next customer in a sentence by relation and sex; a pair without a template has none."""
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey")
    k = F.col("c_custkey")
    rows = c.select("c_custkey", F.when(k % 3 == 0, "parent").when(k % 3 == 1, "sibling").otherwise("spouse").alias("relation"), F.when(k % 5 == 0, None).when(k % 2 == 0, "f").otherwise("m").alias("sex"), F.col("c_name").alias("head"), F.concat(F.lit("Customer "), (k + 1).cast("string")).alias("tail"))
    said = [("parent", "f", "{head} is the mother of {tail}."), ("parent", "m", "{head} is the father of {tail}."), ("sibling", "f", "{head} is a sister of {tail}."), ("sibling", "m", "{head} is a brother of {tail}."), ("parent", None, "{head} is a parent of {tail}.")]
    templates = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(r).alias("relation"), F.lit(s).cast("string").alias("sex"), F.lit(t).alias("template")) for r, s, t in said))))
    return rv.told_by_template(rows, templates, ["relation", "sex"], {"head": "head", "tail": "tail"}).select("c_custkey", F.coalesce("sentence", F.lit("")).alias("sentence"))


_TOLD = """with c as (select c_custkey, c_name, c_custkey % 3 as r, case when c_custkey % 5 = 0 then '-' when c_custkey % 2 = 0 then 'f' else 'm' end as s from customer),
w as (select *, case r || s when '0f' then 'is the mother of' when '0m' then 'is the father of' when '1f' then 'is a sister of' when '1m' then 'is a brother of' when '0-' then 'is a parent of' end as v from c)
select c_custkey, case when v is null then '' else c_name || ' ' || v || ' Customer ' || (c_custkey + 1) || '.' end as sentence from w"""


#: Values by turns for customers: what a writer might add, good and bad, of kinds told by form or by words.
_OFFERED = (
    ("nickname", "Deli Ali"), ("nickname", "one two three four"), ("salary_info", "45.000 TL"), ("salary_info", "12000 lira"), ("salary_info", "much"), ("workplace_location", "Levent Plaza"), ("workplace_location", "Plaza No: 4"),
    ("medical_condition", "Hastalık"), ("medical_condition", "migren"), ("medication", "5 mg"), ("medication", "Parol"), ("job_title", "kıdemli mühendis"), ("job_title", "mühendis 2"), ("work_history", "2015-2019 depo"), ("work_history", "kısaca iş"),
    ("company_name", "Kuzey Gıda"), ("company_name", "küçük yer"), ("company_name", "demir Holding"), ("tax_office_name", "Kadıköy vergi dairesi"), ("tax_office_name", "vergi"), ("union", "Memur Sendikası üyesi"), ("union", "yok"), ("ghost", "what"),
    ("nickname", "xxx"), ("nickname", "12345"), ("nickname", " "), ("company_name", "<firma>"), ("medical_procedure", "CUSTOMER"), ("medical_procedure", "test"), ("mental_health_info", None), ("medical_procedure", "cus"), ("medical_procedure", "ameliyat"),
)
_UNION = ("Sendika", "-iş")


def _kinds(spark, d):
    """Offered values with why they are refused; a customer's own name is known already."""
    c = table(spark, d, "customer", "c_custkey", "c_name")
    offered = F.element_at(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(v).cast("string").alias("value")) for k, v in _OFFERED)), (F.col("c_custkey") % len(_OFFERED) + 1).cast("int"))
    rows = c.withColumn("o", offered)
    why = refusal(F.col("o.value"), F.col("o.kind"), F.array("c_name"), FORMS | {"union": by_words(_UNION)}, lowered=("union",))
    return rows.select("c_custkey", F.col("o.kind").alias("kind"), F.coalesce(why, F.lit("ok")).alias("outcome"))


def _kinds_sql() -> str:
    rows = ", ".join(f"({i}, '{k}', {'null' if v is None else repr(v)})" for i, (k, v) in enumerate(_OFFERED))
    read = {"union": "low"}
    fits = []
    for name, k in (FORMS | {"union": by_words(_UNION)}).items():
        q = lambda p: p.replace("'", "''")
        own = [f"length(v) between {k.least} and {k.most}", f"len(ws) <= {k.words}"]
        own += [f"regexp_matches({read.get(name, 'v')}, '{q(k.pattern)}')"] if k.pattern else []
        own += [f"not regexp_matches(v, '{q(k.unlike)}')"] if k.unlike else []
        own += [f"low not in ({', '.join(repr(n) for n in k.never)})"] if k.never else []
        fits.append(f"when kind = '{name}' then {' and '.join(own)}")
    odd = f"len(list_filter(ws, lambda w: w in ({', '.join(repr(p) for p in PLACEHOLDERS)}) or regexp_full_match(w, 'x{{3,}}|[?]{{2,}}|[.]{{3,}}'))) > 0 or regexp_matches(v, '\\[[^\\]]*\\]|<[^>]*>')" + "".join(f" or contains(low, '{p}')" for p in PLACEHOLDER_PHRASES)
    return f"""with o(i, kind, value) as (values {rows}), x as (select c_custkey, lower(c_name) as known, kind, trim(coalesce(value, '')) as v, lower(trim(coalesce(value, ''))) as low, string_split_regex(lower(trim(coalesce(value, ''))), ' +') as ws from customer join o on i = c_custkey % {len(_OFFERED)}),
y as (select *, case {' '.join(fits)} end as fits from x)
select c_custkey, kind, case when fits is null then 'unknown kind' when v = '' or length(v) > 160 then 'length' when {odd} then 'placeholder' when regexp_full_match(v, '[0-9]+') then 'digits only' when known = low or (length(v) > 3 and contains(known, low)) then 'known value' when not fits then 'format' else 'ok' end as outcome from y"""


def _rules_left(spark, d):
    """Pairs of event types that users have as rules, under a schema cut to some of the types; spans of the rest stripped to what was asked for."""
    e = table(spark, d, "events", "user_id", "event_type", "value").filter("value > 40")
    rules = e.groupBy(F.col("user_id").alias("rule")).agg(F.array_sort(F.collect_set("event_type")).alias("tasks"))
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    return rv.surviving_rules(rules, kinds).groupBy("fate").agg(F.count("*").alias("rules"), F.sum(F.size("tasks")).alias("tasks"))


_RULES_LEFT = """with v as (select * from events where value > 40), k as (select distinct event_type from v order by event_type limit 2), r as (select user_id, count(distinct event_type) as n, count(distinct event_type) filter (event_type in (select event_type from k)) as there from v group by user_id)
select case when there = n then 'keep' when there = 0 then 'drop' else 'mixed' end as fate, count(*) as rules, cast(sum(n) as bigint) as tasks from r group by 1"""


def _stripped(spark, d):
    """Mentions as spans with a payload and without, stripped to texts, and to texts with confidence."""
    m = gold(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", F.col("surface").alias("text"), "confidence"))).alias("spans"), F.sort_array(F.collect_list(F.struct("start", "end", F.col("surface").alias("text"), "confidence", F.upper("label").alias("kind")))).alias("kinds"))
    texts = F.array_join(rv.stripped(m, "spans"), "|")
    sure = F.array_join(F.transform(rv.stripped(m, "kinds", confidence=True), lambda s: F.concat_ws("/", s["text"], F.round(s["confidence"] * 100).cast("int").cast("string"), s["kind"])), "|")
    return m.select("doc_id", F.md5(texts).alias("texts"), F.md5(sure).alias("sure"))


_STRIPPED = f"""with recursive {MENTIONS_SQL} select doc_id, md5(string_agg(surface, '|' order by "start")) as texts, md5(string_agg(surface || '/' || cast(round(confidence * 100) as int) || '/' || upper(label), '|' order by "start")) as sure from mentions group by doc_id"""

ITEMS = {
    "event_structures": Item(_events, _EVENTS),
    "sparse_scores": Item(_sparse, _SPARSE),
    "frozen_build": Item(_frozen, _FROZEN),
    "read_formats": Item(_formats, _FORMATS),
    "json_dimensions": Item(_dimensions, _DIMENSIONS),
    "token_spans": Item(_token_spans, _TOKEN_SPANS),
    "priority_merge": Item(_merged, _MERGED),
    "review_rows": Item(_review_rows, _REVIEW_ROWS),
    "kinship_sentences": Item(_told, _TOLD),
    "value_kinds": Item(_kinds, _kinds_sql()),
    "surviving_rules": Item(_rules_left, _RULES_LEFT),
    "stripped_spans": Item(_stripped, _STRIPPED),
}
