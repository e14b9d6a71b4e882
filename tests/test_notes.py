from lexloom.operators import notes
from lexloom.plans import queries


def test_excerpts_are_joined_in_volumes(spark):
    rows = [(1, i, None if i == 600 else f"e{i}") for i in range(1300)] + [(2, 5, "b"), (2, 3, "a")]
    got = notes.append_excerpts(spark.createDataFrame(rows, "doc_id bigint, ord int, excerpt string"))
    notes_of = {r.doc_id: (r.n, r.note) for r in got.collect()}
    assert notes_of[1] == (1300, "\n---\n\n".join(f"e{i}" for i in range(1300) if i != 600))
    assert notes_of[2] == (2, "a\n---\n\nb")
    # No document is gathered row by row: volumes are joined before documents.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2


def test_excerpts_of_every_kind(spark):
    import oracle_tools

    from lexloom.operators import bilinguals
    from lexloom.session import table

    every = bilinguals.newest(table(spark, oracle_tools.DATA, "bilingual_segments"))
    assert queries.QUERIES["segment_excerpts"](spark, oracle_tools.DATA).selectExpr("sum(n)").first()[0] == every.count()
