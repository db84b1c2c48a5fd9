"""Text queries that must take in every row of their tables, against their SQL or against the tables themselves."""

import pytest
from test_queries import FOLDER, duck, pytestmark, values  # noqa: F401

from webloom.llm.p3 import p3_found, p3_text
from webloom.llm.p5 import SQL, p5_text
from webloom.llm.queries import oracle_sql, queries
from webloom.plans.session import table


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, duck, name):  # noqa: F811
    got, want = queries()[name](spark, FOLDER), duck.execute(oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got.toPandas()) == values(want)


def test_texts_without_lines(spark, duck):  # noqa: F811
    want = dict(duck.execute(SQL["p5_cleaned"]).fetchall())
    assert {r[0]: len(r[1] or "") for r in p5_text(spark, FOLDER).collect()} == want
    pages = {r[0]: (r[1] or "").split("\n") for r in table(spark, FOLDER, "index_docs").select("page_id", "content").collect()}
    gone = {tuple(r) for r in p3_found(spark, FOLDER).collect()}
    assert gone and {r[0]: r[1] or "" for r in p3_text(spark, FOLDER).collect()} == {p: "\n".join(x for n, x in enumerate(lines, 1) if (p, n) not in gone) for p, lines in pages.items()}
