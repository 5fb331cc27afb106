"""What stays in the driver after an operator has been planned."""

from __future__ import annotations

from setwise.llm import common, pii


def learnt(spark) -> int:  # noqa: ANN001
    """States in both caches of the SQL parser: the one of all sessions, and the one that can be bounded."""
    jvm = spark.sparkContext._jvm
    parser, named = jvm.org.apache.spark.sql.catalyst.parser, jvm.java.lang.Class.forName
    each = named("org.antlr.v4.runtime.atn.ParserATNSimulator").getField("decisionToDFA").get(parser.SqlBaseParser(None).getInterpreter())
    states = named("org.antlr.v4.runtime.dfa.DFA").getField("states")
    return sum(states.get(x).size() for x in each) + parser.AbstractParser.getDFACacheNumStates()


def test_the_parser_forgets_the_long_expressions(spark) -> None:
    spark.sparkContext._jvm.org.apache.spark.sql.catalyst.parser.SqlBaseParser(None).getInterpreter().clearDFA()
    settings = ("spark.sql.parser.manageParserCaches", "spark.sql.parser.parserDfaCacheFlushThreshold")
    before = [spark.conf.get(x) for x in settings]
    docs = spark.createDataFrame([(1, "Mr Smith: a.b@c.org"), (2, None)], "doc_id long, text string")
    assert "Smith" not in pii.surrogates(docs, "k").filter("doc_id = 1").first().text
    assert learnt(spark) <= 2000
    assert [spark.conf.get(x) for x in settings] == before


def test_trim(spark) -> None:
    assert common.trim(spark)
