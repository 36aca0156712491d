"""A document's text goes through the last shuffle of the line dedup once."""

from vitrine.llm.line_chunks import RULES, dedup_lines


def test_the_text_is_not_shuffled_twice(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd", "x"), (2, "a\nb\nc\nd", "x"), (3, None, "y"), (None, "a\nb\nc\nd", "z")], "doc_id long, text string, source string")
    out = dedup_lines(docs, rules=RULES)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__text_key#" in plan and "__text#" not in plan[plan.index("Join LeftOuter"):]
    got = {r["doc_id"]: (r["text"], r["lines_removed"], r["source"]) for r in out.collect()}
    assert got[3] == (None, 0, "y") and got[None] == ("a\nb\nc\nd", 0, "z")
    assert got[1] == ("", 4, "x") and got[2] == ("", 4, "x")
