"""Sources bound to driver tables: the tables' rows are written as files of the source's kind and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.plans.catalog import query, t
from evalspark.operators.sequence import global_index
from evalspark.session import cut_lineage, drop_folder, scratch_folder
from evalspark.sinks.writers import write_shards
from evalspark.sources.json_array import read_json_array


@query("json_arrays", """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id, source, text) - 1 AS pos,
       md5(text) AS text_md5, source, n_chars
FROM documents
""")
def q_json_arrays(spark, sf):
    """A JSON array file per thousand document ids, whole texts in it, read by byte ranges."""
    docs = t(spark, sf, "documents")
    element = F.struct("doc_id", "source", "text", "n_chars")
    arrays = (docs.groupBy(F.floor(F.col("doc_id") / 1000).alias("bucket"))  # a thousand documents
              .agg(F.to_json(F.sort_array(F.collect_list(element))).alias("value")))
    path = scratch_folder(spark, "json-arrays")
    arrays.write.partitionBy("bucket").text(path)
    record = F.from_json("raw", "doc_id long, source string, text string, n_chars long")
    back = cut_lineage(read_json_array(spark, path, "*.txt").select("pos", record.alias("r"))
                       .select("r.doc_id", "pos", F.md5("r.text").alias("text_md5"), "r.source", "r.n_chars"))
    drop_folder(spark, path)
    return back


@query("sharded_items", """
WITH i AS (
  SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS item_no, count(*) AS turns, sum(length(text)) AS chars FROM conversations GROUP BY conv_id)
SELECT CAST(item_no % 7 AS INTEGER) AS shard, count(*) AS n_items, CAST(sum(turns) AS BIGINT) AS n_turns, CAST(sum(chars) AS BIGINT) AS n_chars,
       CAST(sum(sum(turns)) OVER () AS BIGINT) AS counted
FROM i GROUP BY ALL
""")
def q_sharded_items(spark, sf):
    """SNK-5: conversations dealt over seven shards, read back; ``counted`` is what the write itself returned."""
    c = t(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    items = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("conversational_turns"))
    path = scratch_folder(spark, "shards")
    counted = write_shards(global_index(items, ["conv_id"], out="item_no"), path, 7)
    back = spark.read.schema("shard int, conv_id long, conversational_turns array<struct<text:string>>").json(path)
    chars = F.aggregate(F.transform("conversational_turns", lambda x: F.length(x["text"])), F.lit(0).cast("long"), lambda a, n: a + F.coalesce(n, F.lit(0)))
    out = cut_lineage(back.groupBy("shard").agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.size("conversational_turns")).alias("n_turns"),
                                                F.sum(chars).alias("n_chars")).withColumn("counted", F.lit(counted).cast("long")))
    drop_folder(spark, path)
    return out
