"""Queries through files: given tables are written in each format to the shared folder and read back by the package's readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagmill.operators.tokens import space_join
from tagmill.plans import Item
from tagmill.plans.derived import documents
from tagmill.sources import readers, table, writers
from tagmill.written import new_folder


def _jsonl(spark, d):
    path = new_folder(spark, "docs.jsonl")
    documents(spark, d, "doc_id", "lang", "text").write.json(path)
    back = readers.normalise_shape(readers.read_jsonl(spark, [path], "doc_id long, lang string, text string").withColumn("schema", F.col("lang")))
    return back.groupBy("output").agg(F.count("*").alias("n"), F.sum(F.length("input")).alias("chars"), F.min(F.md5("input")).alias("least"))


def _quarantine(spark, d):
    """Orders as JSON lines, of which some are cut short and some have a word for a number."""
    path = new_folder(spark, "orders")
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice")
    line = F.when(F.col("o_orderkey") % 10 == 3, F.concat(F.lit('{"key": '), F.col("o_orderkey").cast("string"))).when(F.col("o_orderkey") % 10 == 5, F.lit('{"key": "five", "price": 1}')).when(F.col("o_orderkey") % 10 == 7, F.lit("  ")).otherwise(F.concat(F.lit('{"key": '), F.col("o_orderkey").cast("string"), F.lit("}")))
    o.select(line.alias("value")).write.text(path)
    good, bad = readers.read_jsonl_quarantine(spark, path, "key long, price double")
    return good.agg(F.lit("good").alias("kind"), F.count("*").alias("n"), F.sum("key").alias("keys")).unionByName(bad.agg(F.lit("bad").alias("kind"), F.count("*").alias("n"), F.coalesce(F.sum(F.length("line")), F.lit(0)).alias("keys")))


_QUARANTINE = """select 'good' as kind, count(*) as n, cast(sum(o_orderkey) as bigint) as keys from orders where o_orderkey % 10 not in (3, 5, 7)
union all select 'bad', count(*), cast(sum(case when o_orderkey % 10 = 3 then 8 + length(cast(o_orderkey as varchar)) else 27 end) as bigint) from orders where o_orderkey % 10 in (3, 5)"""


def _weights(spark, d):
    path = new_folder(spark, "names")
    c = table(spark, d, "customer", "c_custkey", "c_name")
    c.select(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 7).alias("weight")).write.option("header", True).csv(path)
    return readers.read_weighted(spark, path)


def _dump(spark, d):
    """Nations and suppliers as lines of an SQL dump, with quotes, commas, brackets and NULL inside."""
    path = new_folder(spark, "dump")
    n = table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    said = F.concat(F.lit("("), F.col("n_nationkey").cast("string"), F.lit(", 'O''"), "n_name", F.lit(r" (a, b\')', "), F.when(F.col("n_regionkey") == 2, "NULL").otherwise(F.col("n_regionkey").cast("string")), F.lit(")"))
    lines = n.withColumn("row", said).groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("row")), ",").alias("rows"))
    lines.select(F.concat(F.lit("INSERT INTO `nation` VALUES "), "rows", F.lit(",(1,2);")).alias("value")).write.text(path)
    return readers.read_dump(spark, path, ["key", "name", "region"])


def _splits(spark, d):
    """Documents in split files, and in review files of ten a language, counted as read back."""
    docs = documents(spark, d, "doc_id", "lang").withColumn("split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train"))
    one, two = new_folder(spark, "splits"), new_folder(spark, "files")
    writers.write_splits(docs, one)
    writers.write_files_of(docs.select("doc_id", "lang"), two, 10, "lang", "doc_id")
    a = spark.read.schema("doc_id long, lang string, split string").json(one).groupBy("split", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    b = spark.read.schema("doc_id long, lang string, file int").json(two).groupBy(F.concat(F.lit("file "), F.col("file").cast("string")).alias("split"), "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return a.unionByName(b)


_SPLITS = """select case when doc_id % 5 = 0 then 'test' else 'train' end as split, lang, count(*) as n, min(doc_id) as first from documents group by all
union all select 'file ' || f, lang, count(*), min(doc_id) from (select doc_id, lang, cast(floor((row_number() over (partition by lang order by doc_id) - 1) / 10) as int) as f from documents) group by f, lang"""


def _gold(spark, d):
    """Turns as gold spans and as predictions told twice, the second time moved: both read back and compared by place."""
    g, p = new_folder(spark, "gold"), new_folder(spark, "pred")
    c = table(spark, d, "conversations", "conv_id", "turn", "role").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("docname"), (F.col("turn") * 10).cast("int").alias("start"), (F.col("turn") * 10 + 5).cast("int").alias("end"), F.nullif(F.col("role"), F.lit("system")).alias("label"))
    spans = c.groupBy("docname").agg(F.sort_array(F.collect_list(F.struct("start", "end", "label"))).alias("spans"))
    spans.write.json(g)
    told = spans.select("docname", "spans", F.explode(F.array(F.lit(1), F.lit(2))).alias("line"))
    told.select("docname", "line", F.transform("spans", lambda s: F.struct((s["start"] + F.when(s["start"] % 20 == 0, F.lit(0)).otherwise(F.col("line"))).alias("start"), s["end"].alias("end"), s["label"].alias("label"))).alias("spans")).write.json(p)
    pred = readers.last_predictions(readers.read_jsonl(spark, p, "docname string, line int, spans array<struct<start:int,end:int,label:string>>")).select("docname", F.inline("spans"))
    gold = readers.read_gold(spark, g)
    return gold.join(pred.select("docname", "start").distinct().withColumn("hit", F.lit(1)), ["docname", "start"], "left").groupBy("label").agg(F.count("*").alias("gold"), F.count("hit").alias("hits"))


def _appended(spark, d):
    """Flags of even and then of odd users appended to one place, as a graph's edges besides."""
    path, graph = new_folder(spark, "flags"), new_folder(spark, "graph")
    e = table(spark, d, "events", "user_id", "event_type").distinct()
    for half in (0, 1):
        writers.append_flags(e.filter(F.col("user_id") % 2 == half), path)
    writers.graph_tables(e.select(F.col("user_id").cast("string").alias("a"), F.col("event_type").alias("b")), graph)
    flags = spark.read.schema("user_id long, event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("flags"))
    return flags.join(spark.read.parquet(f"{graph}/vertices").select(F.col("id").alias("event_type"), "degree"), "event_type")


def _joined(spark, d):
    """Words of turns joined by single spaces: where each ends, summed."""
    c = table(spark, d, "conversations", "conv_id", "turn", "text").select(F.concat_ws(":", "conv_id", "turn").alias("k"), F.posexplode(F.regexp_extract_all("text", F.lit(r"[A-Za-z]+"), F.lit(0))).alias("pos", "token"))
    return space_join(c, "k").groupBy("k").agg(F.max("end").alias("chars"), F.sum("start").alias("starts"))


ITEMS = {
    "jsonl_round_trip": Item(_jsonl, "select lang as output, count(*) as n, cast(sum(length(text)) as bigint) as chars, min(md5(text)) as least from documents group by 1"),
    "jsonl_quarantine": Item(_quarantine, _QUARANTINE),
    "csv_weights": Item(_weights, "select c_name as name, cast(c_custkey % 7 as double) as weight from customer where c_custkey % 4 <> 0 and c_custkey % 7 > 0"),
    "sql_dump": Item(_dump, "select cast(n_nationkey as varchar) as key, 'O''' || n_name || ' (a, b'')' as name, case when n_regionkey <> 2 then cast(n_regionkey as varchar) end as region from nation"),
    "split_files": Item(_splits, _SPLITS),
    "gold_files": Item(_gold, "select role as label, count(*) as gold, count(*) filter (turn % 2 = 0) as hits from conversations where role <> 'system' group by 1"),
    "appended_flags": Item(_appended, "select event_type, count(distinct user_id) as flags, count(distinct user_id) as degree from events group by 1"),
    "space_join": Item(_joined, "with t as (select conv_id || ':' || turn as k, unnest(regexp_extract_all(text, '[A-Za-z]+')) as t, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) as i from conversations), e as (select k, t, sum(length(t) + 1) over (partition by k order by i) - 1 as e from t) select k, cast(max(e) as int) as chars, cast(sum(e - length(t)) as bigint) as starts from e group by k"),
}
