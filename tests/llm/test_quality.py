from orepulse.llm.quality import keep_good, score_quality


def test_held_out_rows_are_scored_right(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    rows = score_quality(docs, labels).join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_held_out_labels_do_not_matter(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    key = lambda r: r.doc_id
    assert sorted(score_quality(docs, labels).collect(), key=key) == sorted(score_quality(docs, turned).collect(), key=key)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "some words", 0.5), (None, "A!! B!!", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (None, 0), (77, 0), (2, None)], "doc_id long, quality int")
    assert score_quality(docs, labels).count() == 4 and score_quality(docs, labels.limit(0)).where("predicted = 1").count() == 4
    assert score_quality(docs.limit(0), labels).count() == 0
    assert keep_good(docs, labels.limit(0)).count() == 4 and keep_good(docs, labels).columns == docs.columns
