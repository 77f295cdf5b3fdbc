from pyspark.sql import functions as F

from condensa.functions import text as T
from condensa.operators import chats, dedup, ranking, structure
from condensa.plans import rewrite
from condensa.sources import io
from condensa.streaming import sinks


def one(spark, f, *texts):
    names = "abc"[: len(texts)]
    return spark.createDataFrame([texts], ", ".join(f"{n} string" for n in names)).select(f(*[F.col(n) for n in names]).alias("x")).first()["x"]


def test_scalar_functions(spark):
    assert one(spark, T.plain_numbers, "1,234,567 and 12,3") == "1234567 and 12,3"
    assert one(spark, T.tight_punctuation, "a , b... c") == "a, b. c"
    assert one(spark, T.no_echo, "the the cat cat sat") == "the cat sat"
    assert one(spark, T.shortened, "in the event that it is due") == "if it's due"
    assert one(spark, T.paragraphs, "a\n\n b \n \nc") == ["a", "b", "c"]
    assert one(spark, T.content_class, '{"a": 1}') == "json"
    assert one(spark, T.content_class, "def f():\n    return {};\nimport os\n" * 5) == "code"
    assert one(spark, T.content_class, "   ") == "general_prose"
    assert one(spark, T.similarity, "a b c", "a b c") == 1.0
    assert one(spark, T.has_constraint, "You MUST go") is True


def test_chunks_and_budget(spark):
    docs = spark.createDataFrame([(1, "a b c. d e f. g h i. " + "w " * 12 + ".")], "doc_id long, text string")
    chunks = ranking.packed_chunks(docs, 6).orderBy("chunk").collect()
    assert [c["n_tokens"] for c in chunks] == [6, 3, 12]
    scored = spark.createDataFrame([(1, 0, 5, False, 0.9), (1, 1, 50, False, 0.8), (1, 2, 5, True, 0.1)], "doc_id long, pos int, n_tokens long, protected boolean, score double")
    ratios = spark.createDataFrame([(1, 3, 60, 0.5)], "doc_id long, n_sentences long, total long, ratio double")
    assert [r["pos"] for r in ranking.within_budget(scored, ratios).collect()] == [0, 2]  # the long one is skipped


def test_line_dedup_keeps_short_texts(spark):
    docs = spark.createDataFrame([(1, "a\na"), (2, "\n".join("a b c d e f g a".split())), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in dedup.lines(docs).collect()}
    assert got[1] == "a\na" and got[2] == "a\nb\nc\nd\ne\nf\ng"


def test_rewrite_keeps_constraints(spark):
    docs = spark.createDataFrame([(1, "You must  keep the  value 1,000 in the  big table of the house."), (2, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rewrite.rewrite(docs).collect()}
    assert "must" in got[1]["text"] and got[1]["tokens_after"] <= got[1]["tokens_before"]


def test_sources(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"In Order To": "to", " ": "x", "b": ""}')
    assert [tuple(r) for r in io.phrase_dictionary(spark, str(tmp_path / "d.json")).collect()] == [("in order to", "to")]
    (tmp_path / "s.json").write_text('{"name": "n", "samples": [{"text": "t", "expected_type": "code", "metadata": {}}]}')
    assert io.benchmark_samples(spark, str(tmp_path / "s.json")).first()["expected_type"] == "code"


def test_streams(spark, tmp_path):
    rows = spark.range(5).selectExpr("id % 2 as user_id", "timestamp_seconds(id) as ts")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = sinks.rate_limited(stream, "user_id", 2).writeStream.format("memory").queryName("limited").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("limited").where("accepted").count() == 4
    query = sinks.micro_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_protected_spans_come_back(spark):
    texts = ['see https://a.b/c?d=1 and "two words" or "two words", 3.14 [2]', "```x = 1```7⟦0⟧", "", None, "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = structure.protect(docs).withColumn("back", structure.restore(F.col("masked"), F.col("spans"))).orderBy("doc_id").collect()
    assert [r["back"] for r in rows] == texts
    assert rows[0]["masked"] == "see ⟦0⟧ and ⟦1⟧ or ⟦1⟧, ⟦2⟧ ⟦3⟧" and rows[1]["masked"] == "⟦0⟧⟦1⟧⟦2⟧"


def test_structure(spark):
    ranges = spark.createDataFrame([(1, 0, 5), (1, 5, 6), (1, 8, 9), (1, 1, 2), (2, 0, 1)], "k int, a int, z int")
    assert sorted(map(tuple, structure.merged_ranges(ranges, "k", "a", "z").collect())) == [(1, 0, 6), (1, 8, 9), (2, 0, 1)]
    assert one(spark, structure.minified, '{"a" : [1, 2] }') == '{"a":[1,2]}' and one(spark, structure.minified, "no {") == "no {"
    docs = spark.createDataFrame([(1, "Name: a\nName: b\nOther: c\n\nplain"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in structure.repeated_labels(docs).collect()] == [(1, "Name", 2)]
    assert [r["is_header"] for r in structure.sections(docs).orderBy("pos").collect()] == [True, False]


def test_ranking_of_sentences(spark):
    docs = spark.createDataFrame([(1, "a b. a b. c d.")], "doc_id long, text string")
    assert [round(r["score"], 6) for r in ranking.lexrank(docs).orderBy("pos").collect()] == [1.0, 1.0, 0.0]
    assert [r["entropy"] for r in ranking.sentence_entropy(docs).collect()] == [1.0] * 3
    turns = spark.createDataFrame([(1, "user", "a b")] * 10, "conv_id long, role string, text string")
    assert chats.keep_ratios(turns).first()["ratio"] == 0.8
