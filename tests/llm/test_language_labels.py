"""Every language that a label names has a model."""

from pyspark.sql import functions as F

from grainmill.llm import language_id


def table(spark, languages=40, rows=6):
    """Language k writes words of its own letters; rarer ones have fewer rows; spellings of the label differ."""
    data = []
    for k in range(languages):
        name = f"{chr(97 + k // 26)}{chr(97 + k % 26)}"
        word = "".join(chr(0x400 + 20 * k + j) for j in range(6))
        for r in range(rows if k < languages - 3 else 3):
            data.append((len(data), f"{word} {word[::-1]} {word[2:]} " * 12, (name, name.upper(), f"{name}-XX", f" {name}_yy ")[r % 4], f"h{k}"))
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string")


def test_no_language_is_left_out_and_spellings_are_one(spark):
    docs = table(spark)
    names, model = language_id.fit(language_id.sample(docs, "doc_id", "text", "lang"))
    assert len(names) == 40 == model.shape[1] and names == sorted({n[:2] for n in names})
    found = language_id.identify(docs, (names, model), "doc_id", F.col("text"), F.col("lang"), F.col("source")).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id")
    assert found.filter(F.substring(F.lower(F.trim("lang")), 1, 2) != F.col("language")).count() == 0 and found.filter("accepted").count() == docs.count()


def test_a_wrong_declaration_of_a_rare_language_is_rejected(spark):
    docs = table(spark)
    rare = docs.filter("lang = 'bn'").limit(1)  # the last of the 40
    assert rare.count() == 1
    wrong = docs.filter("lang = 'aa'").limit(1).select(F.lit(10**6).cast("long").alias("doc_id"), "text", F.lit("bn").alias("lang"), "source")
    kept = {r["doc_id"] for r in language_id.accepted_rows(docs.unionByName(wrong)).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()}


def test_one_id_with_two_labels_counts_for_both(spark):
    docs = spark.createDataFrame([(1, "foo bar", "aa"), (1, "qux", "bb"), (2, "x", "-"), (3, "y", None)], "doc_id long, text string, lang string")
    got = dict(language_id.sample(docs, "doc_id", "text", "lang"))
    assert sorted(got) == ["aa", "bb"]
    assert (got["aa"] == language_id.counts_of(["foo bar"])).all() and (got["bb"] == language_id.counts_of(["qux"])).all()
