"""A third of all rows on one key: the joins of the operators are split by the runtime."""

import pytest
from pyspark.sql import functions as F

from epicell.llm import components, line_templates, warc
from epicell.session import tune

LOWERED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture(autouse=True)
def lowered(spark):
    tune(spark)
    before = {k: spark.conf.get(k, None) for k in LOWERED}
    for k, v in LOWERED.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def split(df):
    """Rows of a frame, and whether a join of its final plan was split."""
    rows = df.collect()
    return rows, "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_pages_of_one_payload(spark):
    pages = spark.range(6000).selectExpr("id AS page_id", "IF(id % 3 = 0, 'the same page', concat('page ', id % 2000)) AS html", "concat(sha2(cast(id AS string), 256), sha2(cast(-id AS string), 256)) AS url")
    rows, was_split = split(warc.repeated_payloads(pages.repartition(8), "page_id", "html"))
    assert was_split and len(rows) == 6000
    same = {r.first_id for r in rows if r.page_id % 3 == 0}
    assert len(same) == 1 and same == {max(r.page_id for r in rows if r.page_id % 3 == 0)}


def test_edges_of_one_node(spark):
    edges = spark.range(30_000).selectExpr("IF(id % 3 = 0, 7L, id) AS u", "id * 31 % 9973 AS v").where("u <> v").distinct()
    rows, was_split = split(components._neighbours_least(edges.repartition(8)))
    assert was_split and len(rows) == edges.count()
    assert {r.least for r in rows if r.u == 7} == {min([7, *[r.v for r in rows if r.u == 7]])}


def test_copies_of_one_text_with_recurring_lines(spark):
    notice = "all of this notice stands word for word in every text of the corpus, copies or not, whatever else it says"
    docs = spark.range(4500).select(
        F.col("id").alias("doc_id"),
        F.expr("concat(sha2(cast(id AS string), 256), sha2(cast(-id AS string), 256))").alias("url"),
        F.expr(f"concat(IF(id % 3 = 0, 'the copied one', concat('own line number ', translate(hex(id * 7919), '0123456789', 'ghijklmnop'))), '\\n{notice}')").alias("text"),
    )
    rows, was_split = split(line_templates.drop_recurring_lines(docs.repartition(8)))
    assert was_split and len(rows) == 4500
    # the text of the smallest key keeps the line, and so do its copies
    assert {r.doc_id % 3 for r in rows if r.dropped_lines == 0} == {0} and sum(r.dropped_lines for r in rows) == 3000
