"""The gates before the rules' patterns: they hold wherever a pattern finds anything, and let most sentences go."""

from pyspark.sql import functions as F

from inkmill.operators import gates
from inkmill.operators.rule_table import RULES
from inkmill.operators.rules import _lit

PROSE = [r for r in RULES if not r.blocks]


def test_gates_hold_on_all_finds_and_nearly_all_rules_have_one(spark):
    texts = [x for r in PROSE for s in (r.yes, r.no) for x in (s, s.upper(), s.lower(), s.title())]
    df = spark.createDataFrame([(x,) for x in texts], "sentence string").withColumn("_lower", F.lower("sentence"))
    told = [(r, g) for r in PROSE if (g := gates.gate(r, "sentence", "_lower", _lit))]
    assert len(told) >= 0.9 * len(PROSE)
    wrong = [f"sum(CASE WHEN regexp_like(sentence, {_lit(r.pattern)}) AND NOT {g} THEN 1 ELSE 0 END) AS w{k}" for k, (r, g) in enumerate(told)]
    let_go = [f"sum(CASE WHEN {g} THEN 0 ELSE 1 END) AS g{k}" for k, (_, g) in enumerate(told)]
    row = df.selectExpr(*wrong, *let_go).first().asDict()
    assert not [told[k][0].check for k in range(len(told)) if row[f"w{k}"]]
    assert sum(row[f"g{k}"] for k in range(len(told))) > 0.9 * len(told) * len(texts)
