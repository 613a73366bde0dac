"""Each pass over the texts cuts every line once and hashes every text once."""

from hirescope.llm import lines
from hirescope.operators.joins import rows_of_known_keys


def _plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def test_a_line_is_split_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h\nx")], "doc_id long, text string")
    known = spark.range(10).selectExpr("id as node")
    found = rows_of_known_keys(lines._line_rows(docs, lines.VARIABLE_TOKENS), known, "node")
    plan = _plan(found.select("node", "line", "words"))
    assert sum(x.count("split(trim(line") for x in plan) == 1
    assert not any("isnotnull" in x and "xxhash64" in x for x in plan if "Filter" in x and "split" in x)


def test_a_text_is_hashed_below_the_explode(spark):
    docs = spark.createDataFrame([(1, "a b c\nd e f")], "doc_id long, text string")
    plan = _plan(lines._line_rows(docs).select("row_key", "line"))
    explode = next(i for i, x in enumerate(plan) if "posexplode" in x)
    hashed = [i for i, x in enumerate(plan) if "xxhash64(doc_id" in x]
    assert hashed and all(i > explode for i in hashed)


def test_line_rows_of_a_least_length(spark):
    text = "one two three\nshort\n\n a  b c d 1 f g h \na b c d e f g"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.line_no: (r.n, r.words) for r in lines._line_rows(docs).collect()}
    assert rows == {0: (3, ["one", "two", "three"]), 3: (8, ["a", "b", "c", "d", "<*>", "f", "g", "h"]),
                    4: (7, ["a", "b", "c", "d", "e", "f", "g"])}
    assert [r.line_no for r in lines._line_rows(docs, 8).collect()] == [3]
